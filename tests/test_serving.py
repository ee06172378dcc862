"""Providers, pre-filter and second layer in the router, caches, criteria, artifacts, sinks and reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions import answers, detectors, text
from lanewise.operators import caches, dedupe, evaluation, semantic, synthesis
from lanewise.plans import providers
from lanewise.plans.policy import Policy
from lanewise.plans.route import decision_records, route
from lanewise.sources import logs
from lanewise.streaming import jobs

PROMPTS = [("a", "hello there"), ("b", "my ssn is 123-45-6789"), ("c", "prove the consensus proof and design the distributed architecture, compare and contrast the trade-offs " * 3), ("d", "confidential nda about the unreleased salary layoff and patient health")]


def _requests(spark):
    return spark.createDataFrame(PROMPTS, "request_id string, text string")


def test_prefilter_in_the_router(spark):
    plain = {r.request_id: r for r in route(_requests(spark)).collect()}
    only = {r.request_id: r for r in route(_requests(spark), Policy(prefilter={"allow_tiers": ("strong",)})).collect()}
    none = {r.request_id: r for r in route(_requests(spark), Policy(prefilter={"deny_tiers": schema.TIERS})).collect()}
    for k in ("a", "c", "d"):
        assert (only[k].tier, only[k].rule_id, only[k].classified) == ("strong", "prefilter.single_candidate", False)
        assert (none[k].tier, none[k].model) == ("local", "local-model") and "failed closed" in none[k].reason
    # what the gate holds back keeps the gate's own rule
    assert only["b"].rule_id == none["b"].rule_id == plain["b"].rule_id == "gate.force-local"
    free = {r.request_id: r for r in route(_requests(spark), Policy(prefilter={"deny_tiers": ("strong",)})).collect()}
    assert free["a"].rule_id == plain["a"].rule_id


def test_second_layer_in_the_router(spark):
    weights = spark.createDataFrame([("hello", 9.0)], "token string, weight double")
    shadow = {r.request_id: r for r in route(_requests(spark), semantic={"weights": weights, "mode": "shadow"}).collect()}
    enforced = {r.request_id: r for r in route(_requests(spark), semantic={"weights": weights, "mode": "enforce", "bias": -5.0}).collect()}
    assert shadow["a"].semantic.fired and shadow["a"].rule_id != "gate.force-local"
    assert enforced["a"].rule_id == "gate.force-local" and not enforced["c"].semantic.fired


def test_client_retries_and_degrades():
    said, slept = [(503, ""), (200, "{}")], []
    client = providers.Client("http://here", attempts=3, post=lambda *a: said.pop(0), sleep=slept.append)
    assert client.ask({"a": 1}) == "{}" and slept == [0.2]
    with pytest.raises(providers.Unavailable, match="HTTP 400"):
        client.with_provider(post=lambda *a: (400, "")).ask({})

    def down(*a):
        raise TimeoutError("slow")

    with pytest.raises(providers.Unavailable, match="TimeoutError"):
        client.with_provider(post=down).ask({})
    assert [providers.retry_delay(n) for n in (0, 1, 2, 3, 4, 9)] == [0.2, 0.4, 0.8, 1.6, 2.0, 2.0]


def test_service_calls_flip_providers(spark):
    full = json.dumps({"answers": {"complexity": {"choice": "hard", "probabilities": {"hard": 3, "trivial": 1}}}})
    drained = providers.Client("http://one", attempts=1, post=lambda u, body, h, t: (429, "") if b"flip" in body else (200, full) if b"fine" in body else (400, ""))
    other = drained.with_provider(url="http://two", post=lambda *a: (200, full))
    rows = spark.createDataFrame([("a", '{"x": "fine"}'), ("b", '{"x": "flip"}'), ("c", '{"x": "bad"}')], "id string, state string")
    got = answers.parsed_answers(providers.asked(rows, drained, "state", answers.questions(), other), "raw")
    got = {r.id: r for r in got.collect()}
    assert [got[k].degraded for k in "abc"] == [False, False, True] and got["c"].degrade_reason == "HTTP 400"
    assert got["b"].complexity.choice == "hard" and got["b"].complexity.probabilities == [0.25, 0.0, 0.75, 0.0]
    assert got["c"].complexity.choice == "hard" and got["c"].complexity.confidence == 0 and got["c"].pii == 0.5


def test_questions_keep_their_schema():
    base = answers.questions()
    changed = answers.with_wording(base, {"complexity": {"instructions": "short", "type": "score", "criteria": {"trivial": "easy", "new": "x", "hard": 7}}, "other": {"instructions": "x"}})
    assert set(changed) == set(base) and changed["complexity"]["type"] == "choice" and changed["complexity"]["instructions"] == "short"
    assert changed["complexity"]["criteria"]["trivial"] == "easy" and set(changed["complexity"]["criteria"]) == set(schema.COMPLEXITY)
    assert "domain" not in answers.questions(domain=False)
    assert answers.option_texts({"type": "score", "criteria": ["low", "high"]}) == ["level 0: low", "level 1: high"]
    assert answers.option_texts({"type": "noul", "criteria": {"true": "there is"}})[1] == "true: there is"
    count = lambda s: len(s.split())
    assert answers.head_tokens({"type": "choice", "instructions": "a b", "criteria": {"x": "one two", "y": None}}, count, 100) == 3 + 4 + 4 + 2
    long = {"type": "choice", "instructions": "w " * 500, "criteria": {k: "w " * 100 for k in "abcd"}}
    assert answers.head_tokens(long, count, 96) <= 3 + 96


def test_lru_equals_a_plain_walk(spark):
    rng = np.random.default_rng(0)
    rows = [(f"w{rng.integers(3)}", int(rng.zipf(1.5)) % 30, i, float(i), bool(rng.random() < 0.1)) for i in range(600)]
    df = spark.createDataFrame(rows, "worker string, item int, k int, t double, bad boolean").repartition(3)
    got = {(r.worker, r.k): (r.hit, r.evicts) for r in caches.lru_hits(df, "worker", "item", "k", 4, ttl=40.0, ts="t", degraded="bad").collect()}
    held: dict = {}
    for who, item, k, t, bad in rows:
        mine = held.setdefault(who, [])
        found = next((e for e in mine if e[0] == item), None)
        alive = found is not None and found[1] + 40 > t
        if found is not None:
            mine.remove(found)
        evicts = False
        if alive:
            mine.append(found)
        elif not bad:
            mine.append((item, t))
            evicts = len(mine) > 4
            if evicts:
                mine.pop(0)
        assert got[who, k] == (alive, evicts)
    stats = caches.cache_stats(caches.lru_hits(df, "worker", "item", "k", 4)).first()
    assert stats.hits + stats.misses == 600 and 0 < stats.hit_rate < 1


def test_semantic_seam(spark):
    stored = spark.createDataFrame([(1, "plan the summer launch"), (2, "write a poem on rain")], "id long, norm string")
    missed = spark.createDataFrame([(10, "plan the winter launch"), (11, "poem on snow please now"), (12, "unrelated words only")], "id long, norm string")
    got = {r.id: r for r in caches.semantic_replays(missed, stored, lambda s: F.when(s > 0.2, 0.8).otherwise(float("nan"))).collect()}
    assert set(got) == {10, 11} and (got[10].served_from, got[10].similarity, got[10].suspicious) == (1, 0.6, False)
    assert got[11].suspicious and got[11].served_from == 2


def test_shared_cache(spark):
    made = spark.createDataFrame([("k1", "{}", False), ("k1", "{}", False), ("k2", "x", True)], "key string, data string, degraded boolean")
    table = caches.stored_answers(made, "key", "data", 100.0)
    asked = spark.createDataFrame([("k1",), ("k2",)], "key string")
    assert sorted((r.key, r.data) for r in caches.shared_cache(asked, table, "key", 200.0).collect()) == [("k1", "{}"), ("k2", None)]
    assert caches.shared_cache(asked, table, "key", 1100.0).where("data is not null").count() == 0


def test_judgement_keys_and_scoring_once(spark):
    rows = spark.createDataFrame([(1, "x", ["a"]), (2, "x", ["a"]), (3, "y", [])], "id int, redacted string, topics array<string>")
    keyed = rows.withColumn("key", dedupe.judgement_key(F.col("redacted"), F.col("topics"), "keyless", 1))
    seen = []
    out = dedupe.score_once(keyed, "key", lambda df: seen.append(df.count()) or df.withColumn("score", F.length("redacted")))
    assert seen == [2] and out.count() == 3 and {r.score for r in out.collect()} == {1}


def test_criteria():
    assert evaluation.Criteria.parse(None).min_recall == 0.99
    for bad in ({"min_recal": 0.95}, {"min_recall": 0.8}, {"max_disagreement_rate": 2}, {"min_shadow_examples": 1.5}, {"min_recall": True}):
        with pytest.raises(evaluation.CriteriaError):
            evaluation.Criteria.parse(bad)
    assert evaluation.Criteria.for_evaluation(160, 104).min_shadow_examples == 0
    assert evaluation.relaxed_gates({"min_tier_agreement": 0.4, "max_ece": 0.05, "max_latency_ms": 80}) == ["min_tier_agreement: 0.4 instead of 0.95 (floor lowered)", "max_latency_ms: 80 instead of 50 (ceiling raised)"]
    swapped = evaluation.switched_backend({"version": 3, "backend": {"name": "keyless"}}, "m.zip", "v1")
    assert swapped["backend"]["replaced"] == {"name": "keyless"} and swapped["version"] == 3


def test_missing_numbers_fail_their_gates(spark):
    one = spark.sql("SELECT cast(null as double) AS tier_agreement, double('NaN') AS worst_ece, 1.0 AS p50_ms, 600 AS n_rows")
    assert {r.name: r.ok for r in evaluation.graduation_checks(one).collect()} == {"min_tier_agreement": False, "max_ece": False, "max_latency_ms": True, "min_samples": True}


def test_artifacts(spark, tmp_path):
    texts = [(f"secret plan number {i} for the merger", True) for i in range(30)] + [(f"public recipe number {i} with soup", False) for i in range(30)]
    made = synthesis.fit_scorer(spark.createDataFrame(texts, "text string, sensitive boolean"), epochs=60)
    assert made["metrics"]["recall"] == 1.0 and made["metrics"]["false_positive_rate"] == 0.0
    back = synthesis.load_semantic(synthesis.save_semantic(made, tmp_path / "layer").parent)
    assert back == json.loads(json.dumps(made))
    with pytest.raises(synthesis.ArtifactError):
        synthesis.check_semantic({**made, "provenance": {"trained_on_blocked_content": True}})
    with pytest.raises(synthesis.FitError):
        synthesis.fit_scorer(spark.createDataFrame([*texts, (texts[0][0], False)], "text string, sensitive boolean"))
    digest = synthesis.save_calibration({"pii": {"breaks": [0.1], "values": [0.2]}}, tmp_path / "c.json")
    assert len(digest) == 64 and synthesis.load_calibration(tmp_path / "c.json")["pii"]["values"] == [0.2]
    (tmp_path / "c.json").write_text((tmp_path / "c.json").read_text().replace("0.2", "0.9"))
    with pytest.raises(synthesis.ArtifactError):
        synthesis.load_calibration(tmp_path / "c.json")


def test_sinks_and_files(spark, tmp_path):
    df = spark.range(3)
    failing = lambda batch, epoch: 1 / 0
    kept = []
    with pytest.raises(ExceptionGroup):
        logs.fan_out([failing, lambda batch, epoch: kept.append(batch.count())])(df, 0)
    assert kept == [3]
    logs.sink(None)(df, 0)
    write = logs.sink({"path": str(tmp_path / "log")})
    write(df, 7)
    write(df, 7)  # the same epoch again
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    with pytest.raises(FileNotFoundError):
        logs.dataset_file(str(tmp_path))
    for name in ("b.jsonl", "train.jsonl", "dataset.jsonl"):
        (tmp_path / name).write_text('{"id": "x", "category": "c", "text": "t", "expect": "blocked"}\n')
        assert logs.dataset_file(str(tmp_path)) == str(tmp_path / name)
    assert logs.read_cases(spark, str(tmp_path / "b.jsonl")).first().expect == "blocked"
    assert logs.read_window(spark, str(tmp_path / "b.jsonl"), "id string, category string", "id", 1).count() == 1


def test_two_streams_repeat_an_epoch(spark, tmp_path):
    routed = route(_requests(spark))
    write = logs.two_streams(str(tmp_path / "d"), str(tmp_path / "r"))
    write(routed, 1)
    write(routed, 1)
    assert logs.read_decisions(spark, str(tmp_path / "d")).count() == 4
    assert logs.read_refusals(spark, str(tmp_path / "r")).count() == 1


def test_logs_read_back(spark, tmp_path):
    records = decision_records(route(_requests(spark)))
    logs.write_log(records, str(tmp_path / "decisions.jsonl"))
    assert logs.source(spark, str(tmp_path / "decisions.jsonl")).count() == 4
    assert logs.read_strict(spark, str(tmp_path / "decisions.jsonl"), schema.DECISION_SCHEMA).count() == 4
    assert {r.gate_fired for r in logs.decision_signals(logs.read_decisions(spark, str(tmp_path / "decisions.jsonl"))).collect()} == {True, False}
    kept = logs.production_negatives(logs.read_decisions(spark, str(tmp_path / "decisions.jsonl")), limit=2)
    assert kept.count() == 2 and kept.where("gate.blocks_backend").count() == 0
    assert logs.read_outcomes(spark, str(tmp_path / "none.jsonl")).count() == 0
    logs.discard(records)
    (tmp_path / "corpus.jsonl").write_text('{"body": "a text", "url": "u"}\n{"body": " "}\n')
    assert logs.read_corpus(spark, str(tmp_path / "corpus.jsonl"), "CC0", "body", origin="url").count() == 1
    with pytest.raises(ValueError, match="licence"):
        logs.read_corpus(spark, str(tmp_path / "corpus.jsonl"), " ")


def test_eval_rows(spark, tmp_path):
    row = ("row-1", "an easy question", ("trivial", "public", "chat", False), "cheap", "clear", "a note that is long enough")
    bad = ("Row 2", "x", ("trivial", "regulated", "chat", False), "cheap", "clear", "short")
    rows = spark.createDataFrame([row, bad, row], evaluation.EVAL_ROW)
    evaluation.write_eval(rows, str(tmp_path / "e"))
    faults = {(r.id, r.fault) for r in evaluation.row_faults(evaluation.read_eval(spark, str(tmp_path / "e"))).collect()}
    assert {f for i, f in faults if i == "Row 2"} == {"id is not a lower-case slug", "notes too short", "text too short", "tier is not the policy's"}
    assert {f for i, f in faults if i == "row-1"} == {"id occurs twice", "text occurs twice"}


def test_reports():
    assert evaluation.wrapped("aa bb cc", 5) == "aa bb\ncc"
    out = evaluation.render("Run", {"what": "a word " * 30, "tiers": [{"tier": "local", "share": 0.25}, {"tier": "cheap", "share": None}], "bars": {"ece": 0.1}})
    assert "| local | 0.25 |" in out and "| cheap | – |" in out and "* ece: 0.1" in out
    said = evaluation.export_warnings({"no_text": 2, "duplicate_excerpts": 1, "holdout_rows": 0, "usable": {"pii": 0, "domain": 3}})
    assert len(said) == 5 and "['pii']" in said[3]
    assert set(evaluation.latency_of(lambda x: x, [1, 2, 3])) == {"p50", "p95", "p99"}


def test_export_tally(spark):
    rows = spark.createDataFrame([("h", "a", "hard", None), ("t", "a", "hard", True)], "s string, excerpt_hash string, complexity string, pii boolean")
    rows = rows.select(F.when(F.col("s") == "h", "holdout").otherwise("train").alias("split"), "excerpt_hash", "complexity", "pii", F.lit(None).cast("string").alias("domain"), F.lit("x").alias("sensitivity"))
    tally = evaluation.export_tally(rows, spark.createDataFrame([("no_text", 4)], "reason string, n long"))
    assert tally == {"holdout_rows": 1, "duplicate_excerpts": 1, "no_text": 4, "usable": {"complexity": 2, "sensitivity": 2, "domain": 0, "pii": 1}}


def test_layers_and_shadows(spark):
    offline = spark.createDataFrame([(0.9, 10)], "recall double, n_live long")
    shadow = spark.createDataFrame([("v1", 50), ("v1", 70), ("v2", 9)], "model_version string, n_live long")
    assert [r.n_live for r in semantic.prefer_shadow(offline, shadow, "v1").collect()] == [50]
    assert [r.n_live for r in semantic.prefer_shadow(offline, shadow, "v9").collect()] == [10]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, tier string")
    both = providers.with_shadow(rows, lambda df: df, lambda df: df.withColumn("tier", F.lit("a")), ["tier"], "id")
    assert sorted((r.tier, r.shadow_tier) for r in both.collect()) == [("a", "a"), ("b", "a")]
    cal = semantic.calibrated(spark.createDataFrame([(0.4,)], "complexity_confidence double"), {"complexity": ((0.1, 0.5), (0.2, 0.8))})
    assert cal.first().complexity_confidence == 0.2


def test_text_helpers(spark):
    rows = spark.createDataFrame([([("text", "a"), ("image", None), ("text", "")], "one two three four five")], "parts array<struct<type:string,text:string>>, t string")
    got = rows.select(text.flatten_parts(F.col("parts")).alias("flat"), text.head_tail(F.col("t"), 3).alias("cut")).first()
    assert (got.flat, got.cut) == ("a\n[image]", "one two ... five")
    found = spark.createDataFrame([("write to a@corp.dev, ssn 123-45-6789",)], "t string").select(detectors.detector_counts(F.col("t")).alias("c")).first().c
    assert found["us_ssn"] == 1 and found["email_address"] == 1
    assert spark.range(1).select(F.round(__import__("lanewise.functions.decision", fromlist=["x"]).binary_confidence(F.lit(0.8)), 6)).first()[0] == 0.6


def test_stream_counts_and_exact_cache(spark, tmp_path):
    rows = [("a", "local", 0), ("b", "cheap", 30), ("a", "local", 60), ("c", "local", 4000)]
    df = spark.createDataFrame(rows, "key string, tier string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, plan in (("counted", jobs.tier_counts(stream(), "ts")), ("served", jobs.exact_cache(stream(), "key", "ts"))):
        mode = "update" if name == "counted" else "append"
        plan.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.tier, r.n) for r in spark.table("counted").collect()) == [("cheap", 1), ("local", 1), ("local", 2)]
    assert sorted(r.key for r in spark.table("served").collect()) == ["a", "b", "c"]
