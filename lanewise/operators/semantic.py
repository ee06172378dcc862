"""The second gate layer and the request cache in front of the router."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import decision, text
from lanewise.operators import dedupe, distill

THRESHOLD = 0.5


def assess(rows: DataFrame, weights: DataFrame | None, bias: float = 0.0, threshold: float = THRESHOLD, mode: str = "shadow", id_col: str = "request_id", text_col: str = "redacted") -> DataFrame:
    """Adds ``semantic``: score, whether it fired, whether it is enforced, and how it disagrees with the gate.

    Without weights the layer is inert.  Only ``enforce`` mode may raise a floor.
    """
    if mode not in ("off", "shadow", "enforce"):
        raise ValueError(f"unknown mode {mode!r}")
    if weights is None or mode == "off":
        scored = rows.withColumn("_score", F.lit(None).cast("double"))
    else:
        found = distill.lexicon_score(rows.withColumnRenamed(id_col, "id"), weights, text.tokens(F.coalesce(F.col(text_col), F.lit(""))), bias)
        scored = rows.join(found.select(F.col("id").alias(id_col), F.col("score").alias("_score")), id_col, "left")
    score = F.when(F.col("_score").isNotNull(), F.least(F.greatest(F.col("_score"), F.lit(0.0)), F.lit(1.0)))
    fired = F.coalesce(score >= threshold, F.lit(False))
    layer1 = F.col("gate.sensitivity_floor").isNotNull()
    enforced = fired & F.lit(mode == "enforce")
    kind = F.when(score.isNull(), None).when(fired & ~layer1, "semantic_only").when(~fired & layer1, "semantic_miss")
    return scored.withColumn(
        "semantic",
        F.struct(
            score.alias("score"), fired.alias("fired"), enforced.alias("enforced"), kind.alias("disagreement"),
            F.when(enforced, "confidential").alias("sensitivity_floor"), F.lit(mode).alias("mode"),
        ),
    ).drop("_score")


def assess_stats(rows: DataFrame) -> DataFrame:
    s = F.col("semantic")
    ran = s["score"].isNotNull()
    rate = lambda hit: F.try_divide(F.count_if(hit).cast("double"), F.count_if(ran).cast("double"))
    return rows.agg(F.count_if(ran).alias("n"), rate(s["fired"]).alias("fire_rate"), rate(s["disagreement"].isNotNull()).alias("disagreement_rate"))


def prefer_shadow(offline: DataFrame, shadow: DataFrame | None, version: str) -> DataFrame:
    """Promotion metrics of the offline evaluation, with the shadow log's where its version is the same."""
    if shadow is None:
        return offline
    same = shadow.where(F.col("model_version") == version).drop("model_version")
    names = [c for c in same.columns if c in offline.columns]
    # one row: the first by its values, and nulls where the version was not shadowed
    one = same.agg(*[F.min_by(c, F.struct(*same.columns)).alias(f"_{c}") for c in same.columns])
    joined = offline.crossJoin(F.broadcast(one))
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in names}).drop(*[f"_{c}" for c in same.columns])


def request_cache(requests: DataFrame, ttl_seconds: float = 3600.0, threshold: float = dedupe.JACCARD, id_col: str = "id", text_col: str = "text", ts: str = "ts", fired: str | None = None) -> DataFrame:
    """(id, served_from, how): the earlier request whose decision each one could replay.

    Requests on which the gate fires are neither served nor stored.  An equal normalised text wins over
    the most similar one at or above the threshold; both must lie within the time to live.
    """
    open_rows = requests if fired is None else requests.where(~F.col(fired))
    rows = open_rows.select(F.col(id_col).alias("id"), F.col(ts).cast("double").alias("t"), text.normalized(F.col(text_col)).alias("norm"))
    last = Window.partitionBy("norm").orderBy("t", "id")
    exact = rows.select("id", F.lag("id").over(last).alias("from"), (F.col("t") - F.lag("t").over(last)).alias("age"))
    exact = exact.where(F.col("age") < ttl_seconds).select("id", F.col("from").alias("served_from"), F.lit("exact").alias("how"))
    pairs = dedupe.near_duplicates(rows, rows, threshold, text_col="norm", normal=F.col("norm"))
    times = rows.select("id", "t")
    pairs = pairs.join(times.select(F.col("id").alias("left_id"), F.col("t").alias("lt")), "left_id").join(times.select(F.col("id").alias("right_id"), F.col("t").alias("rt")), "right_id")
    earlier = pairs.where((F.col("rt") < F.col("lt")) & (F.col("lt") - F.col("rt") < ttl_seconds))
    best = earlier.groupBy(F.col("left_id").alias("id")).agg(F.max_by("right_id", F.struct("similarity", "rt", "right_id")).alias("served_from"), F.lit("near").alias("how"))
    return exact.unionByName(best.join(exact.select("id"), "id", "left_anti"))


def calibrated(rows: DataFrame, breaks: dict[str, tuple], temperature: float | None = None) -> DataFrame:
    """Confidences of the heads through their isotonic maps; distributions through a temperature."""
    for head, (xs, ys) in breaks.items():
        rows = rows.withColumn(f"{head}_confidence", decision.isotonic(F.col(f"{head}_confidence"), xs, ys))
    if temperature is not None:
        for head in ("complexity", "sensitivity", "domain"):
            rows = rows.withColumn(f"{head}_p", decision.with_temperature(F.col(f"{head}_p"), temperature))
    return rows


def outcomes(decisions: DataFrame, response: Column, rate: float = 1.0) -> DataFrame:
    """Completion checks of served requests: never of blocked ones, sampled by request id."""
    rows = decisions.where(~F.col("gate.blocks_backend") & text.sample_hit(F.col("request_id"), rate))
    done = F.when(F.trim(F.coalesce(F.substring(response, 1, 2000), F.lit(""))) != "", 0.9).otherwise(0.1)
    return rows.select("request_id", F.col("model").alias("model_served"), done.alias("completed_p"))
