"""Log, trace and dataset sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import schema


def read_kind(spark: SparkSession, path: str, table_schema: str, kind: str) -> DataFrame:
    """JSON lines of one kind: blank, malformed and other lines are passed over; no file, no rows."""
    full = f"{table_schema}, _corrupt string"
    try:
        rows = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], table_schema)
    return rows.where(F.col("_corrupt").isNull() & (F.col("kind") == kind)).drop("_corrupt")


def read_decisions(spark: SparkSession, path: str, kind: str = schema.DECISION) -> DataFrame:
    return read_kind(spark, path, schema.DECISION_SCHEMA, kind)


def read_refusals(spark: SparkSession, path: str, kind: str = schema.REFUSAL) -> DataFrame:
    return read_kind(spark, path, schema.REFUSAL_SCHEMA, kind)


def read_outcomes(spark: SparkSession, path: str, kind: str = schema.OUTCOME) -> DataFrame:
    return read_kind(spark, path, schema.OUTCOME_SCHEMA, kind)


def read_rotated(spark: SparkSession, directory: str, pattern: str = "decisions*.jsonl") -> DataFrame:
    """All rotated decision logs of a folder, with the file's time for oldest-first order."""
    rows = spark.read.schema(schema.DECISION_SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").json(directory)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("file_time")).where(F.col("kind") == schema.DECISION)


def read_strict(spark: SparkSession, path: str, table_schema: str, split: str | None = None) -> DataFrame:
    """JSON lines that must all be well formed; an empty table is an error of the caller's."""
    rows = spark.read.schema(table_schema).option("mode", "FAILFAST").json(path)
    return rows if split is None else rows.where(F.col("split") == split)


def source(spark: SparkSession, where: str | DataFrame) -> DataFrame:
    """Decisions from a table, a file or a folder of rotated logs."""
    if isinstance(where, DataFrame):
        return where
    return read_decisions(spark, where) if where.endswith((".json", ".jsonl")) else read_rotated(spark, where).drop("file_time")


def read_corpus(spark: SparkSession, path: str, licence: str, text_field: str = "text", **fields: str) -> DataFrame:
    """A public corpus with its own field names; refused where its licence is not stated."""
    if not licence.strip():
        raise ValueError("a corpus needs a stated licence")
    rows = spark.read.json(path)
    named = [F.col(text_field).alias("text"), *(F.col(v).alias(k) for k, v in fields.items())]
    return rows.select(*named, F.lit(licence).alias("licence")).where(F.trim(F.coalesce("text", F.lit(""))) != "")


def write_log(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Append JSON lines; files are cut by rows, so no task writes an endless one."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def fan_out(sinks: Sequence[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that feeds every sink; a failing sink does not keep the others from it, and all failures are raised together."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        errors = []
        try:
            for sink in sinks:
                try:
                    sink(batch, epoch)
                except Exception as error:
                    errors.append(error)
        finally:
            batch.unpersist()
        if errors:
            raise ExceptionGroup("sinks failed", errors)

    return write


def write_epoch(df: DataFrame, path: str, epoch: int, rows_per_file: int = 1_000_000) -> None:
    """JSON lines of one micro-batch in a folder of its own, so that writing it again replaces it."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(f"{path.rstrip('/')}/epoch={epoch}")


def two_streams(decision_path: str, refusal_path: str) -> Callable[[DataFrame, int], None]:
    """Decisions and refusals of one micro-batch, to places of their own.

    The batch is routed once, and a repeated epoch replaces what it wrote before.
    """
    from lanewise.plans.route import decision_records, refusal_records

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            write_epoch(decision_records(batch), decision_path, epoch)
            write_epoch(refusal_records(batch), refusal_path, epoch)
        finally:
            batch.unpersist()

    return write


def sink(config: dict | None) -> Callable[[DataFrame, int], None]:
    """The sink that a configuration names: none, a log, or one log among several."""
    config = dict(config or {})
    if not config.get("enabled", True) or not config.get("path"):
        return lambda batch, epoch: discard(batch)
    return lambda batch, epoch: write_epoch(batch, config["path"], epoch, int(config.get("rows_per_file", 1_000_000)))


def dataset_file(folder: str) -> str:
    """The data file of a dataset folder: dataset.jsonl, train.jsonl, or the first JSON lines by name."""
    from pathlib import Path

    path = Path(folder)
    if path.is_file():
        return str(path)
    names = [path / "dataset.jsonl", path / "train.jsonl", *sorted(path.glob("*.jsonl"))]
    found = next((n for n in names if n.exists()), None)
    if found is None:
        raise FileNotFoundError(f"no JSON lines in {folder}")
    return str(found)


def read_window(spark: SparkSession, path: str, table_schema: str, order: str, most: int = 5000) -> DataFrame:
    """The newest ``most`` rows of a stored window; a malformed line is an error."""
    return spark.read.schema(table_schema).option("mode", "FAILFAST").json(path).orderBy(F.desc(order)).limit(most)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Injection cases as JSON lines: id, category, text, expect."""
    return spark.read.schema("id string, category string, text string, expect string").json(path)


# ------------------------------------------------------------ payloads

PART = "struct<type:string,text:string>"
ITEM = "struct<role:string,content:string,text:string,output:string,parts:array<struct<text:string>>>"
PAYLOAD = f"struct<system:string,instructions:string,messages:array<{ITEM}>,input:string,prompt:string,contents:array<{ITEM}>,metadata:map<string,string>>"
ROLE_NAMES = {"model": "assistant", "bot": "assistant", "human": "user"}


def role_of(role: Column) -> Column:
    out = F.coalesce(role, F.lit("user"))
    for other, name in ROLE_NAMES.items():
        out = F.when(role == other, name).otherwise(out)
    return out


def content_of(value: Column) -> Column:
    """Text of a content string that may hold a JSON list of typed parts."""
    parts = F.from_json(value, f"array<{PART}>")
    flat = F.transform(parts, lambda p: F.when((p["type"] == "text") & p["text"].isNotNull(), p["text"]).otherwise(F.concat(F.lit("["), F.coalesce(p["type"], F.lit("non-text")), F.lit("]"))))
    listed = F.array_join(F.filter(flat, lambda s: s != ""), "\n")
    return F.coalesce(F.when(value.rlike(r"^\s*\[\s*\{"), listed), value, F.lit(""))


def extract_messages(payload: Column) -> Column:
    """array<struct<role,content>> of a request body (JSON text): system and instructions first, then the
    first of messages, input, prompt and contents that has turns."""
    body = F.from_json(payload, PAYLOAD)
    turn = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    items = lambda a: F.transform(a, lambda m: turn(role_of(m["role"]), content_of(F.coalesce(m["content"], m["text"], m["output"]))))
    parts = F.transform(body["contents"], lambda m: turn(role_of(m["role"]), F.array_join(F.transform(m["parts"], lambda p: p["text"]), "\n")))
    listed = F.from_json(F.when(body["input"].rlike(r"^\s*\["), body["input"]), f"array<{ITEM}>")
    prompts = F.from_json(F.when(body["prompt"].rlike(r"^\s*\["), body["prompt"]), "array<string>")
    plain = lambda c: F.when(F.trim(c) != "", F.array(turn(F.lit("user"), c)))
    said = lambda a: F.when(F.size(a) > 0, a)
    turns = F.coalesce(
        said(items(body["messages"])),
        said(items(listed)),
        plain(F.when(~body["input"].rlike(r"^\s*\["), body["input"])),
        said(F.transform(F.filter(prompts, lambda p: ~p.rlike(r"^\d+$")), lambda p: turn(F.lit("user"), p))),
        plain(F.when(~body["prompt"].rlike(r"^\s*\["), body["prompt"])),
        said(parts),
        F.expr("cast(array() as array<struct<role:string,content:string>>)"),
    )
    head = F.array_compact(F.array(*[F.when(F.trim(body[c]) != "", turn(F.lit("system"), body[c])) for c in ("system", "instructions")]))
    return F.when(F.size(turns) > 0, F.concat(head, turns)).otherwise(turns)


UNSAFE_KEYS = ("messages", "prompt", "content", "input", "raw", "body")


def safe_metadata(metadata: Column, allow: Sequence[str] | None = None, most: int = 256) -> Column:
    """Metadata without text-carrying keys; with ``allow`` only those keys, trimmed and cut."""
    kept = F.map_filter(metadata, lambda k, v: ~k.isin(*UNSAFE_KEYS) & v.isNotNull() & (F.trim(v) != ""))
    if allow is not None:
        kept = F.map_filter(kept, lambda k, v: k.isin(*allow))
    return F.transform_values(kept, lambda k, v: F.substring(F.trim(v), 1, most))


def decision_signals(decisions: DataFrame) -> DataFrame:
    """A small text-free summary of each decision."""
    return decisions.select(
        "request_id", "tier", "model", "rule_id", F.col("gate.fired").alias("gate_fired"),
        (F.col("uncertain") if "uncertain" in decisions.columns else F.lit(False)).alias("uncertain"), "complexity", "sensitivity",
    )


def narrowed(candidates: Column, tier: Column, tier_models: dict[str, Sequence[str]], safest: str = "local") -> Column:
    """Candidate models of the decided tier; where there is none, of the safest tier, else all."""
    pool = F.lit(None).cast("array<string>")
    for name, models in tier_models.items():
        pool = F.when(tier == name, F.array(*[F.lit(m) for m in models])).otherwise(pool)
    mine = F.array_intersect(candidates, pool)
    safe = F.array_intersect(candidates, F.array(*[F.lit(m) for m in tier_models.get(safest, ())]).cast("array<string>"))
    return F.when(F.size(mine) > 0, mine).when(F.size(safe) > 0, safe).otherwise(candidates)


def production_negatives(decisions: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows fit as negatives: supported, not blocked, not degraded, with text."""
    reason = (
        F.when(F.col("schema_version") != schema.SCHEMA_VERSION, "unsupported_schema_version")
        .when(F.col("gate.blocks_backend"), "gate_blocked")
        .when(F.col("degraded"), "degraded")
        .when(F.coalesce("excerpt", F.lit("")) == "", "no_text")
    )
    kept = decisions.withColumn("refusal", reason).where("refusal is null").drop("refusal")
    return kept if limit is None else kept.orderBy("timestamp", "request_id").limit(limit)
