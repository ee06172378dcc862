"""Decision caches as batch simulations: bounded least-recently-used entries with a time to live, and the semantic seam."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import text
from lanewise.operators import dedupe

# Fixed values of the judgement cache.
TTL_SECONDS, ENTRIES = 900.0, 8192


class Lru:
    """Keys in the order of their last use, each with the time it was stored."""

    def __init__(self, entries: int = ENTRIES, ttl: float | None = None, held=()):
        self.entries, self.ttl, self.held = max(1, entries), ttl, OrderedDict(held)

    def use(self, key, t: float, keep: bool = True) -> tuple[bool, bool]:
        """(hit, evicted another) of one access; ``keep`` is false for answers that must not be stored."""
        stored = self.held.get(key)
        if stored is not None and (self.ttl is None or stored + self.ttl > t):
            self.held.move_to_end(key)
            return True, False
        self.held.pop(key, None)
        if not keep or self.ttl == 0:
            return False, False
        self.held[key] = t
        if len(self.held) <= self.entries:
            return False, False
        self.held.popitem(last=False)
        return False, True


def lru_hits(events: DataFrame, worker: str, key: str, order: str, entries: int = ENTRIES, ttl: float | None = None, ts: str | None = None, degraded: str | None = None) -> DataFrame:
    """(worker, order, hit, evicts) of every access: each worker has a cache of its own.

    Rows come sorted to one task per worker, batch by batch, and only the cache itself (``entries`` keys) is kept.
    Degraded answers are not stored.
    """
    key_type, worker_type, order_type = (events.schema[c].dataType.simpleString() for c in (key, worker, order))
    t = F.col(ts).cast("double") if ts else F.lit(0.0)
    bad = F.coalesce(F.col(degraded), F.lit(False)) if degraded else F.lit(False)
    rows = events.select(F.col(worker).alias("worker"), F.col(key).alias("key"), F.col(order).alias("order"), t.alias("t"), bad.alias("bad"))

    def run(frames):
        now, cache = object(), Lru(entries, ttl)
        for frame in frames:
            hits, evicts = [], []
            for who, item, at, skip in zip(frame["worker"], frame["key"], frame["t"], frame["bad"], strict=True):
                if who != now:
                    now, cache = who, Lru(entries, ttl)
                hit, evicted = cache.use(item, at, not skip)
                hits.append(hit)
                evicts.append(evicted)
            yield frame[["worker", "key", "order"]].assign(hit=hits, evicts=evicts)

    dealt = rows.repartition("worker").sortWithinPartitions("worker", "order")
    out = dealt.mapInPandas(run, f"worker {worker_type}, key {key_type}, `order` {order_type}, hit boolean, evicts boolean")
    return out.select(F.col("worker").alias(worker), F.col("key").alias(key), F.col("order").alias(order), "hit", "evicts")


def cache_stats(hits: DataFrame) -> DataFrame:
    """hits, misses, evictions and the hit rate (0 without lookups)."""
    out = hits.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if("evicts").alias("evictions"))
    return out.withColumn("hit_rate", F.round(F.coalesce(F.try_divide(F.col("hits").cast("double"), (F.col("hits") + F.col("misses")).cast("double")), F.lit(0.0)), 4))


def semantic_replays(missed: DataFrame, stored: DataFrame, noul: Callable[[Column], Column], threshold: float = dedupe.SEMANTIC, least: float = dedupe.OVERLAP_FLOOR / 2, k: int = dedupe.TOP_K, id_col: str = "id", norm: str = "norm") -> DataFrame:
    """(id, served_from, similarity, suspicious): misses that a yes-no question about the nearest stored texts replays.

    The nearest of at most ``k`` candidates is served where ``noul`` of its similarity (the seam of a model) reaches the threshold; candidates
    overlap by ``least`` at least.  A replay of texts that hardly overlap is served, and counted as suspicious.
    """
    a, b = (df.select(F.col(id_col).alias("id"), F.col(norm).alias("norm")) for df in (missed, stored))
    pairs = dedupe.top_similar(dedupe.near_duplicates(a, b, least, text_col="norm", normal=F.col("norm")), min(k, dedupe.TOP_K))
    best = pairs.where("rank = 1").withColumn("p", noul(F.col("similarity")))
    said = best.where(~F.isnan("p") & (F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)) >= threshold))
    return said.select(F.col("left_id").alias("id"), F.col("right_id").alias("served_from"), "similarity", (F.col("similarity") < dedupe.OVERLAP_FLOOR).alias("suspicious"))


def shared_cache(requests: DataFrame, cache: DataFrame, key: str, now: float, ttl: float = TTL_SECONDS) -> DataFrame:
    """Requests beside the stored answer of their key, where it lives still: a persisted table in place of a cache server."""
    live = cache.where(F.col("stored_at") + ttl > now).drop("stored_at")
    return requests.join(live, key, "left")


def stored_answers(answers: DataFrame, key: str, data: str, now: float, degraded: str = "degraded") -> DataFrame:
    """Rows to append to the shared table: one per key, never of degraded answers."""
    return answers.where(~F.col(degraded)).groupBy(key).agg(F.any_value(data).alias(data)).withColumn("stored_at", F.lit(float(now)))


def normalized_key(column: Column) -> Column:
    return F.sha2(text.normalized(column), 256)
