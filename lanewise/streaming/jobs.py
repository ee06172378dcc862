"""Structured Streaming jobs: routing, TTL caches, drift demotion and the circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.operators import analytics
from lanewise.plans.policy import Policy
from lanewise.plans.route import route
from lanewise.sources.logs import two_streams


def route_stream(requests: DataFrame, policy: Policy = Policy(), **settings) -> DataFrame:
    """The batch plan over a stream: every column is row-wise, so nothing is kept between batches."""
    return route(requests, policy, **settings)


def start_log(requests: DataFrame, decision_path: str, refusal_path: str, checkpoint: str, policy: Policy = Policy(), available_now: bool = True):
    """Route a stream of requests into the two logs."""
    writer = route_stream(requests, policy).writeStream.foreachBatch(two_streams(decision_path, refusal_path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tier_counts(decisions: DataFrame, ts: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Decisions per tier and event-time window; windows are final once the watermark has passed."""
    return decisions.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), "tier").agg(F.count("*").alias("n"))


def exact_cache(requests: DataFrame, key: str, ts: str, ttl: str = "15 minutes") -> DataFrame:
    """The first request of each key within the time to live; the others are served from the cache."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def ttl_cache(requests: DataFrame, key: str = "key", ts: str = "ts", ttl_seconds: float = 900.0, late: str = "10 minutes") -> DataFrame:
    """(key, t, hit) of every request against a per-key cache whose entries live ``ttl_seconds``.

    ``ts`` is a timestamp or seconds.  A key's state goes when the watermark has passed its time to live, so state is
    bounded by the keys of that span.
    """
    import pandas as pd

    def run(name, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("t")
        hits = []
        for t in rows["t"]:
            hit = stored is not None and t - stored < ttl_seconds
            stored = stored if hit else t
            hits.append(hit)
        state.update((stored,))
        gone = int(1000 * (stored + ttl_seconds)) + 1
        if gone > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(gone)
        yield pd.DataFrame({"key": name[0], "t": rows["t"].to_numpy(), "hit": hits})

    timed = requests.schema[ts].dataType.simpleString() == "timestamp"
    at = F.col(ts) if timed else F.timestamp_seconds(F.col(ts).cast("double"))
    slim = requests.select(F.col(key).cast("string").alias("key"), (F.unix_micros(at) / 1e6 if timed else F.col(ts).cast("double")).alias("t"), (at + F.expr("INTERVAL 1 MILLISECOND")).alias("_ts"))
    # a row at the watermark counts as late: the first watermark is 0, which a row may have
    slim = slim.withWatermark("_ts", late)
    return slim.groupBy("key").applyInPandasWithState(run, "key string, t double, hit boolean", "stored double", "append", "EventTimeTimeout")


def drift_monitor(records: DataFrame, baseline: int = analytics.BASELINE_SIZE, factor: float = analytics.DRIFT_FACTOR) -> DataFrame:
    """Demotion events per backend: the first time its disagreement passes ``factor`` times the baseline.

    State per backend is six numbers, however long the stream runs.
    """
    import pandas as pd

    def run(name, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        base_n, base_d, now_n, now_d, demoted = state.get if state.exists else (0, 0, 0, 0, False)
        out = []
        rows = pd.concat(list(frames)).sort_values("seq")
        for differs in rows["differs"]:
            if base_n < baseline:
                base_n, base_d = base_n + 1, base_d + bool(differs)
            else:
                now_n, now_d = now_n + 1, now_d + bool(differs)
        if now_n and not demoted and now_d / now_n > factor * base_d / base_n:
            demoted = True
            out.append((name[0], base_d / base_n, now_d / now_n, base_n + now_n))
        state.update((base_n, base_d, now_n, now_d, demoted))
        yield pd.DataFrame(out, columns=["backend", "baseline_disagreement", "current_disagreement", "n_decisions"])

    differs = F.col("decision_fired") != (F.col("shadow_score") >= F.col("threshold"))
    rows = records.select(F.coalesce("backend", F.lit("default")).alias("backend"), "seq", differs.alias("differs"))
    return rows.groupBy("backend").applyInPandasWithState(
        run,
        "backend string, baseline_disagreement double, current_disagreement double, n_decisions long",
        "base_n long, base_d long, now_n long, now_d long, demoted boolean",
        "append",
        "NoTimeout",
    )


class Breaker:
    """closed -> open after ``failures`` in a row -> half open after ``recovery`` seconds, for one probe."""

    def __init__(self, failures: int = 5, recovery: float = 30.0, state=("closed", 0, 0.0)):
        self.failures, self.recovery = failures, recovery
        self.mode, self.count, self.since = state

    def call(self, t: float, ok: bool) -> str:
        """State in which a call at ``t`` is met; ``rejected`` if it does not go through."""
        if self.mode == "open":
            if t - self.since < self.recovery:
                return "rejected"
            self.mode = "half_open"
        met = self.mode
        if ok:
            self.mode, self.count = "closed", 0
        else:
            self.count += 1
            if met == "half_open" or self.count >= self.failures:
                self.mode, self.since = "open", t
        return met


def breaker_states(calls: DataFrame, by: str = "backend", ts: str = "ts", ok: str = "ok", failures: int = 5, recovery: float = 30.0) -> DataFrame:
    """(backend, ts, state) of every call; works on a batch and on a stream alike."""
    import pandas as pd

    def walk(name, rows: pd.DataFrame, state) -> tuple[pd.DataFrame, tuple]:
        breaker = Breaker(failures, recovery, state)
        rows = rows.sort_values("t")
        met = [breaker.call(t, bool(k)) for t, k in zip(rows["t"], rows["ok"], strict=True)]
        return pd.DataFrame({"backend": name[0], "t": rows["t"].to_numpy(), "state": met}), (breaker.mode, breaker.count, breaker.since)

    slim = calls.select(F.col(by).alias("backend"), F.col(ts).cast("double").alias("t"), F.col(ok).alias("ok"))
    schema = "backend string, t double, state string"
    if not calls.isStreaming:
        return slim.groupBy("backend").applyInPandas(lambda key, rows: walk(key, rows, ("closed", 0, 0.0))[0], schema)

    def run(name, frames, state):
        out, now = walk(name, pd.concat(list(frames)), state.get if state.exists else ("closed", 0, 0.0))
        state.update(now)
        yield out

    return slim.groupBy("backend").applyInPandasWithState(run, schema, "mode string, count int, since double", "append", "NoTimeout")
