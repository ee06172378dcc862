import pytest
from pyspark.sql import functions as F

from lanewise.plans.policy import Failure, Policy, PolicyError, Rule, compile_expression, compile_names
from lanewise.plans.route import route


@pytest.mark.parametrize("source", ["__import__('os')", "complexity.upper()", "[x for x in y]", "lambda: 1", "pii ** 2", "unknown == 1", "f'{pii}'", "complexity ==", "1 if pii else 2"])
def test_refused(source):
    with pytest.raises(PolicyError):
        compile_names(source)


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ('complexity in ["hard", "frontier"] and not pii_present', [True, False, False]),
        ("pii >= 0.2 or char_len > 90", [False, True, True]),
        ("0.1 < pii < 0.6", [False, True, False]),
        ("pii * 2 + 0.1 > 1", [False, False, False]),
        ('"x" in advisory_topics', [False, True, False]),
        ('metadata["team"] == "red"', [True, False, False]),
    ],
)
def test_compiled(spark, source, expected):
    rows = [("hard", False, 0.05, 10, [], {"team": "red"}), ("hard", True, 0.4, 10, ["x"], {}), ("trivial", True, None, 100, None, None)]
    df = spark.createDataFrame(rows, "complexity string, pii_present boolean, pii double, char_len int, advisory_topics array<string>, metadata map<string,string>")
    names = {c: F.col(c) for c in df.columns}
    assert [r[0] for r in df.select(compile_expression(source, names)).collect()] == expected


def test_validation():
    with pytest.raises(PolicyError):
        Policy(rules=(Rule("a", "local", "pii > 1"),))
    with pytest.raises(PolicyError):
        Policy(rules=(Rule("a", "nowhere"),))
    with pytest.raises(PolicyError):
        Policy(tier_order=("cheap", "huge"))
    with pytest.raises(PolicyError):
        Policy(failure=Failure(mode="fail_maybe"))
    with pytest.raises(PolicyError):
        Policy(confidence_factor=float("inf"))


def test_from_yaml():
    policy = Policy.from_yaml(
        "tiers: {local: [a], cheap: [b, c], strong: [d]}\n"
        "rules:\n- {id: r1, if: 'pii > 0.9', then: {tier: local}}\n- {id: default, then: {model: d}}\n"
        "on_uncertain: {sensitivity_confidence_below: 0.6}\non_failure: {mode: fail_open}\n"
    )
    assert [r.tier for r in policy.rules] == ["local", "strong"] and policy.uncertainty.sensitivity_below == 0.6 and policy.failure.mode == "fail_open"


def test_route(spark):
    rows = [("1", "my ssn is 123-45-6789"), ("2", "hello"), ("3", "prove the consensus proof, design the distributed architecture, debug the race condition and research the literature"), ("4", None)]
    out = {r.request_id: r for r in route(spark.createDataFrame(rows, "request_id string, text string")).collect()}
    assert (out["1"].tier, out["1"].rule_id, out["1"].sensitivity, out["1"].pii) == ("local", "gate.force-local", "regulated", 1.0)
    assert "123-45-6789" not in out["1"].redacted
    assert out["3"].complexity in ("hard", "frontier")
    assert out["4"].excerpt == ""


def test_degraded_and_blocked(spark):
    from lanewise.plans.route import keyless, prepare, resolve

    df = spark.createDataFrame([("1", "my ssn is 123-45-6789"), ("2", "hello there")], "request_id string, text string")
    scored = keyless(prepare(df)).withColumn("degraded", F.lit(True))
    policy = Policy(failure=Failure(mode="fail_open"))
    got = {r.request_id: (r.tier, r.rule_id) for r in resolve(scored, policy).collect()}
    assert got == {"1": ("local", "backend.down"), "2": ("strong", "backend.down")}
    skipped = resolve(keyless(prepare(df)), still_classify=False).where("request_id = '1'").first()
    assert (skipped.classified, skipped.sensitivity, skipped.tier) == (False, "regulated", "local")


def test_round_robin_and_fallback(spark):
    policy = Policy(tiers={"local": ("a",), "cheap": ("b", "c"), "strong": ("d",)}, uncertain_fallback="frontier")
    df = spark.range(4).select(policy.round_robin(F.lit("cheap"), F.col("id")).alias("m"))
    assert [r.m for r in df.collect()] == ["b", "c", "b", "c"]
    assert spark.range(1).select(policy.fallback(F.lit("cheap"), F.lit("b")).alias("x")).first().x == ("strong", "d")
