"""Markdown of small aggregate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, title: str = "", most: int = 200) -> str:
    """A Markdown table of an aggregate; ``most`` bounds what a report may show."""
    rows = df.limit(most).collect()
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"
