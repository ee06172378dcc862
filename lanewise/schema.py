"""Ladders, record kinds and table schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ladders (ascending), domains and tiers.
COMPLEXITY = ("trivial", "standard", "hard", "frontier")
SENSITIVITY = ("public", "internal", "confidential", "regulated")
DOMAINS = ("code", "writing", "analysis", "chat", "data-extraction")
TIERS = ("local", "cheap", "strong")

SCHEMA_VERSION = "1"
#: Prefix of record kinds in logs; logs of other writers are read by naming theirs.
KIND_PREFIX = "lanewise"
DECISION, REFUSAL, OUTCOME, DEMOTION = (f"{KIND_PREFIX}.{k}" for k in ("decision", "gate_block", "outcome", "demotion"))

MESSAGE = "struct<role:string,content:string>"
CHOICE = "struct<choice:string,probabilities:map<string,double>,confidence:double,confidence_reported:boolean>"
FINDING = "struct<detector:string,category:string,sensitivity_floor:string,force_local:boolean,span_hash:string,count:int>"
GATE = (
    f"struct<fired:boolean,findings:array<{FINDING}>,sensitivity_floor:string,pii_floor:double,"
    "force_local:boolean,blocks_backend:boolean,advisory_topics:array<string>>"
)
DECISION_SCHEMA = (
    "kind string, schema_version string, request_id string, timestamp string, excerpt_hash string, excerpt string, backend string, "
    "policy_version int, tier string, model string, rule_id string, complexity string, sensitivity string, "
    f"complexity_confidence double, sensitivity_confidence double, pii double, domain string, gate {GATE}, "
    "escalations array<string>, latency_ms double, degraded boolean, classified boolean, cached boolean"
)
REFUSAL_SCHEMA = "kind string, schema_version string, request_id string, timestamp string, detectors map<string,int>, sensitivity_floor string"
OUTCOME_SCHEMA = "kind string, request_id string, ts double, model_served string, completed_p double"
WINDOW_SCHEMA = "seq long, ts double, decision_fired boolean, shadow_score double, threshold double, backend string"


def ladder(levels: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in levels])


def level_index(level: Column, levels: tuple[str, ...]) -> Column:
    """Position on a ladder; -1 for an unknown or null level."""
    return F.coalesce(F.array_position(ladder(levels), level).cast("int"), F.lit(0)) - 1


def level_at(index: Column, levels: tuple[str, ...]) -> Column:
    return F.try_element_at(ladder(levels), index.cast("int") + 1)


def bump(level: Column, by, levels: tuple[str, ...]) -> Column:
    """Move along a ladder, stopping at its ends; unknown levels stay."""
    by = by if isinstance(by, Column) else F.lit(by)
    at = level_index(level, levels)
    moved = F.least(F.greatest(at + by, F.lit(0)), F.lit(len(levels) - 1))
    return F.when(at < 0, level).otherwise(level_at(moved, levels))
