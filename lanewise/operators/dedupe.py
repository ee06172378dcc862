"""Duplicates: judgement caches, near-duplicate requests, first-seen flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lanewise.functions import text

# Fixed values of the request cache.
JACCARD, SEMANTIC, OVERLAP_FLOOR, TOP_K = 0.9, 0.7, 0.3, 5

# Near duplicates: frequent tokens that go last in the order; tokens of a set for each further one that a pair must share.
COMMON, SHARED = 4096, 16


def judgement_key(redacted: Column, topics: Column, backend: str, version: int) -> Column:
    """32 hex digits over policy version, backend, redacted text and topics."""
    body = F.concat_ws("\x00", F.lit(f"v{version}"), F.lit(backend), redacted, F.array_join(topics, ","))
    return F.substring(F.sha2(body, 256), 1, 32)


def score_once(requests: DataFrame, key: str, scorer) -> DataFrame:
    """Score each distinct key once and join the answers back.

    The rows of a key are equal for the scorer, so any one stands for them.
    """
    answers = scorer(requests.dropDuplicates([key]))
    new = [c for c in answers.columns if c not in requests.columns]
    return requests.join(answers.select(key, *new), key)


def cache_hits(events: DataFrame, key: str, order: str, ttl_seconds: float | None = None, ts: str | None = None) -> DataFrame:
    """Adds ``hit``: whether the key was stored before (within the time to live since its last miss).

    With a time to live a key's rows are walked in order as they stream by, and only the time of its last miss is kept.
    """
    if ttl_seconds is None:
        return events.withColumn("hit", F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1)
    rows = events.drop("hit").select("*", F.col(key).alias("_key"), F.col(ts).cast("double").alias("_t"))
    fields = rows.schema.fields[:-2]

    def run(batches):
        import pyarrow as pa

        nothing = float("nan")  # no time is within a time to live of it
        now, stored = object(), nothing
        for batch in batches:
            hits = []
            at = batch.column(len(fields) + 1).cast(pa.float64()).fill_null(nothing).to_pylist()
            for who, t in zip(batch.column(len(fields)).to_pylist(), at, strict=True):
                if who != now:
                    now, stored = who, nothing
                hit = t - stored < ttl_seconds
                if not hit:
                    stored = t
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(hits, pa.bool_())], [*batch.schema.names[: len(fields)], "hit"])

    # a store lives ttl seconds from the miss that made it
    dealt = rows.repartition("_key").sortWithinPartitions("_key", order, "_t")
    return dealt.mapInArrow(run, StructType([*fields, StructField("hit", BooleanType())]))


def duplicate_flags(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in arrival order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")


def near_duplicates(left: DataFrame, right: DataFrame, threshold: float = JACCARD, id_col: str = "id", text_col: str = "text", normal: Column | None = None) -> DataFrame:
    """(left_id, right_id, similarity) of token-set pairs at or above the threshold.

    Prefix filter: with tokens in one order (the COMMON most frequent last), two sets of overlap o share at least
    min(m, o) tokens among the first n - ceil(t n) + m of either, for any m.  Only those tokens are joined, with the
    size filter and an m that grows with the set; pairs that share fewer are no candidates.  Then the sets are
    compared exactly.  Any order of tokens gives the same pairs, so COMMON bounds the work and not the result.
    """

    def sets(df: DataFrame, side: str) -> DataFrame:
        source = text.normalized(F.col(text_col)) if normal is None else normal
        return df.select(F.col(id_col).alias(f"{side}_id"), text.token_set(source).alias(f"{side}_set")).where(F.size(f"{side}_set") > 0)

    def hashes(side: str) -> Column:
        return F.transform(f"{side}_set", lambda t: F.xxhash64(t))

    def prefix(df: DataFrame, side: str) -> DataFrame:
        n, m = F.size(f"{side}_set"), F.floor(F.size(f"{side}_set") / SHARED).cast("int") + 1
        rare_first = F.concat(F.array_sort(F.array_except(hashes(side), F.col("common"))), F.array_intersect(F.col("common"), hashes(side)))
        keep = n - F.ceil(n * threshold - 1e-9).cast("int") + m
        return df.crossJoin(F.broadcast(common)).select(f"{side}_id", n.alias(f"{side}_n"), m.alias(f"{side}_m"), F.explode(F.slice(rare_first, F.lit(1), keep)).alias("token"))

    a, b = sets(left, "left"), sets(right, "right")
    tokens = a.select(F.explode(hashes("left")).alias("token"))
    if left is not right:
        tokens = tokens.unionAll(b.select(F.explode(hashes("right")).alias("token")))
    most = tokens.groupBy("token").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "token").limit(COMMON)
    common = most.agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("common"))
    fits = (F.col("left_n") >= threshold * F.col("right_n") - 1e-9) & (F.col("right_n") >= threshold * F.col("left_n") - 1e-9)
    least = F.ceil((F.col("left_n") + F.col("right_n")) * (threshold / (1 + threshold)) - 1e-9)
    shared = prefix(a, "left").join(prefix(b, "right"), "token").where(fits)
    shared = shared.groupBy("left_id", "right_id").agg(F.count("*").alias("shared"), F.min(F.least("left_m", "right_m", least)).alias("enough"))
    pairs = shared.where("shared >= enough").select("left_id", "right_id")
    scored = pairs.join(a, "left_id").join(b, "right_id").withColumn("similarity", text.jaccard(F.col("left_set"), F.col("right_set")))
    return scored.where(F.col("similarity") >= threshold).select("left_id", "right_id", "similarity")


def top_similar(pairs: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` best partners of each left row, ties to the smaller id."""
    order = Window.partitionBy("left_id").orderBy(F.desc("similarity"), F.asc("right_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def conflicting_labels(rows: DataFrame, key: str, label: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count_distinct(label).alias("labels")).where("labels > 1")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; must be empty for disjoint sets."""
    return a.select(key).intersect(b.select(key))
