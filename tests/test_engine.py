"""Sources, streams, duplicates, distillation and generators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise import generators, schema
from lanewise.functions import text
from lanewise.operators import analytics, dedupe, distill
from lanewise.plans.route import decision_records, route
from lanewise.sources import logs
from lanewise.streaming import jobs


def test_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "my ssn is 123-45-6789"), ("2", "hello")], "request_id string, text string")
    records = decision_records(route(df))
    logs.write_log(records, str(tmp_path / "log"))
    with open(tmp_path / "log" / "part-extra.json", "w") as f:
        f.write("not json\n\n" + json.dumps({"kind": "other"}) + "\n")
    back = logs.read_decisions(spark, str(tmp_path / "log"))
    assert {r.request_id: r.excerpt for r in back.collect()} == {"1": None, "2": "hello"}
    assert logs.read_decisions(spark, str(tmp_path / "missing")).count() == 0
    assert back.where("gate.blocks_backend").count() == 1


def test_payloads(spark):
    bodies = [
        {"messages": [{"role": "human", "content": "hi"}, {"role": "model", "content": "yo"}], "system": "be kind"},
        {"input": "just this"},
        {"prompt": "old style"},
        {"contents": [{"role": "user", "parts": [{"text": "a"}, {"text": "b"}]}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "look"}, {"type": "image_url"}]}]},
        {},
    ]
    df = spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")
    got = [[tuple(m) for m in r[0]] for r in df.select(logs.extract_messages(F.col("body"))).collect()]
    assert got[0] == [("system", "be kind"), ("user", "hi"), ("assistant", "yo")]
    assert got[1:4] == [[("user", "just this")], [("user", "old style")], [("user", "a\nb")]]
    assert got[4] == [("user", "look\n[image_url]")]
    assert got[5] == []


def test_metadata(spark):
    df = spark.createDataFrame([({"team": " red ", "prompt": "secret", "note": "x" * 300},)], "m map<string,string>")
    assert df.select(logs.safe_metadata(F.col("m"), ["team", "note"])).first()[0] == {"team": "red", "note": "x" * 256}


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 12)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string")
    sets = {i: set(t.split()) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = {(r.left_id, r.right_id) for r in dedupe.near_duplicates(df, df, 0.6).where("left_id < right_id").collect()}
    assert got == want


def test_ttl_cache(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 11.0), ("a", 12.0), ("b", 3.0)], "key string, t double")
    got = {(r.key, r.t): r.hit for r in dedupe.cache_hits(df, "key", "t", ttl_seconds=10, ts="t").collect()}
    assert got == {("a", 0.0): False, ("a", 5.0): True, ("a", 11.0): False, ("a", 12.0): True, ("b", 3.0): False}


def test_breaker(spark):
    rows = [("x", float(t), ok) for t, ok in [(0, False), (1, False), (2, True), (5, True), (6, False), (7, False), (20, False), (21, True), (40, True)]]
    df = spark.createDataFrame(rows, "backend string, ts double, ok boolean")
    got = [r.state for r in jobs.breaker_states(df, failures=2, recovery=10).orderBy("t").collect()]
    assert got == ["closed", "closed", "rejected", "rejected", "rejected", "rejected", "half_open", "rejected", "half_open"]


def _stream(spark, tmp_path, df):
    df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def _drain(query_df, name, mode="append"):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_cache_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 11.0), ("b", 3.0)], "key string, ts double")
    _drain(jobs.ttl_cache(_stream(spark, tmp_path, df), ttl_seconds=10), "ttl_out")
    got = {(r.key, r.t, r.hit) for r in spark.table("ttl_out").collect()}
    want = {(r.key, r.ts, r.hit) for r in dedupe.cache_hits(df, "key", "ts", ttl_seconds=10, ts="ts").collect()}
    assert got == want


def test_stream_drift(spark, tmp_path):
    rows = [(i, float(i), False, 0.1 if i < 20 or i % 2 else 0.9, 0.5, "m") for i in range(60)]
    df = spark.createDataFrame(rows, schema.WINDOW_SCHEMA)
    _drain(jobs.drift_monitor(_stream(spark, tmp_path, df), baseline=20), "drift_out")
    events = spark.table("drift_out").collect()
    assert len(events) == 1 and events[0].backend == "m" and events[0].baseline_disagreement == 0
    status = analytics.window_status(df, baseline=20)
    assert analytics.demotions(status).count() == 1


def test_stream_log(spark, tmp_path):
    df = spark.createDataFrame([("1", "my ssn is 123-45-6789"), ("2", "hello")], "request_id string, text string")
    q = jobs.start_log(_stream(spark, tmp_path, df), str(tmp_path / "d"), str(tmp_path / "r"), str(tmp_path / "c"))
    q.awaitTermination()
    assert logs.read_decisions(spark, str(tmp_path / "d")).count() == 2
    assert [r.detectors for r in logs.read_refusals(spark, str(tmp_path / "r")).collect()] == [{"us_ssn": 1}]


def test_isotonic_and_temperature(spark):
    x, y = np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0])
    assert distill.pool_adjacent(x, y) == ([0.1, 0.3, 0.4], [0.0, 0.5, 1.0])
    assert distill.pool_adjacent(np.array([0.5, 0.5]), y[:2]) == ([], [])
    df = spark.createDataFrame([("h", float(a), float(b)) for a, b in zip(x, y, strict=True)], "head string, x double, y double")
    assert [tuple(r) for r in distill.fit_isotonic(df).collect()] == [("h", [0.1, 0.3, 0.4], [0.0, 0.5, 1.0])]
    rows = [([0.9, 0.1], [0.6, 0.4])] * 10
    t = distill.fit_temperature(spark.createDataFrame(rows, "p array<double>, t array<double>"), "p", "t")
    assert t == pytest.approx(np.log(9) / np.log(1.5), rel=0.02)


def test_student(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    label = (x[:, 0] > 0).astype(int)
    soft = np.where(label[:, None] == np.arange(2), 0.95, 0.05)
    model = distill.train_student(x, {"a": soft}, {"a": np.ones(400, bool)}, {"a": ("no", "yes")}, hidden=4, epochs=60)
    assert (model.predict(x)["a"].argmax(1) == label).mean() > 0.95
    df = spark.createDataFrame([(str(i), *map(float, r)) for i, r in enumerate(x[:5])], "request_id string, f0 double, f1 double, f2 double")
    got = {r.request_id: r.a_p for r in distill.predictions(df, model, ["f0", "f1", "f2"]).collect()}
    assert np.allclose([got[str(i)] for i in range(5)], model.predict(x[:5])["a"])
    with pytest.raises(ValueError):
        distill.train_student(x, {"a": soft}, {"a": np.zeros(400, bool)}, {"a": ("no", "yes")})


def test_lexicon(spark):
    rows = [(i, "red apple" if i % 2 else "green pear", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string, y int")
    tokens = text.tokens(F.col("t"), bigrams=False)
    weights, bias = distill.train_lexicon(df, tokens, "y", distill.document_frequency(df, tokens))
    table = spark.createDataFrame(list(weights.items()), "token string, weight double")
    score = {r.id: r.score for r in distill.lexicon_score(df, table, tokens, bias).collect()}
    assert score[1] > 0.8 > 0.2 > score[0]


def test_generated_evaluations(spark):
    report = {r.category: r for r in generators.injection_report(generators.injection_cases(spark)).collect()}
    assert sum(r.n for r in report.values()) == 264
    assert sum(r.leaks for r in report.values()) == 0 and sum(r.false_positives for r in report.values()) == 0
    flips = {(r.domain, r.kind): r.flip_accuracy for r in generators.flip_report(generators.contrastive_pairs(spark)).collect()}
    assert flips[(None, None)] == pytest.approx(0.85) and flips[(None, "ssn")] == 0
    caught = generators.check_identifiers(generators.synthetic_identifiers(spark, 3)).collect()
    assert all(r.caught == r.n for r in caught), caught


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    got = {r.q: r.value for r in analytics.nearest_rank_of(df, "v", (0.5, 0.95, 1.0)).collect()}
    assert got == {0.5: 6.0, 0.95: 10.0, 1.0: 10.0}
    assert df.agg(analytics.nearest_rank(F.col("v"), 0.5)).first()[0] == 6.0


def test_plans_stay_native(spark):
    """The flagship query has no Python in its plan and reads only the columns it needs."""
    from lanewise.queries import QUERIES

    plan = QUERIES["tier_distribution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "html" not in plan and "n_chars" not in plan.split("ReadSchema")[-1]
