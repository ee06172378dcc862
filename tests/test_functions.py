import math

import pytest
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions import decision, detectors, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_excerpt_of_messages(spark):
    said = [("system", "be brief"), ("user", "one"), ("assistant", " two "), ("user", "three"), ("tool", "big output"), ("user", "four"), ("user", "five")]
    df = spark.createDataFrame([([{"role": r, "content": c} for r, c in said],)], f"m array<{schema.MESSAGE}>")
    assert df.select(text.excerpt_messages(F.col("m"))).first()[0] == "two\n\nthree\n\nfour\n\nfive"
    assert df.select(text.excerpt_messages(F.col("m"), prior_turns=9, system=True)).first()[0].startswith("be brief\n\none\n\ntwo")
    assert df.select(text.excerpt_messages(F.col("m"), max_chars=6)).first()[0] == "fo\n\nfi"


def test_features(spark):
    t = "Why?  See https://x.dev/a and `code`.\n```\nx\n```\nFile \"a.py\", line 3"
    f = one(spark, text.features(F.col("t")), t=t)
    assert (f.urls, f.inline_code_spans, f.code_blocks, f.question_marks, f.has_stack_trace, f.line_count) == (1, 1, 1, 1, True, 5)
    empty = one(spark, text.features(F.col("t")), t="")
    assert (empty.char_len, empty.word_count, empty.line_count, empty.lang, empty.n_messages) == (0, 0, 0, "und", 0)


def test_language_and_tokens(spark):
    assert one(spark, text.detect_language(F.col("t")), t="der Hund und die Katze ist nicht mit uns") == "de"
    assert one(spark, text.detect_language(F.col("t")), t="the a b") == "und"
    assert one(spark, text.tokens(F.col("t")), t="A big-ish 7 x") == ["big", "ish", "7", "big_ish", "ish_7"]
    assert one(spark, text.normalized(F.col("t")), t="  Ｆull  ﬁne ") == "full fine"
    assert one(spark, text.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5


@pytest.mark.parametrize(
    ("value", "ok"),
    [("4111 1111 1111 1111", True), ("4111 1111 1111 1112", False), ("1234", False)],
)
def test_luhn(spark, value, ok):
    assert one(spark, detectors.luhn_ok(F.col("v")), v=value) is ok
    assert detectors._py_luhn(value) is ok


def test_validators_agree(spark):
    values = ["GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "943 476 5919", "943 476 5918", "AB123456C", "GB123456A", "a@example.com", "a@mail.example.com", "a@real.dev"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for name in ("iban", "nhs", "nino", "email", "luhn", "phone"):
        got = [r[0] for r in df.select(detectors.CHECKS[name](F.col("v"))).collect()]
        assert got == [detectors._PY_CHECKS[name](v) for v in values], name


def test_verdict():
    v = detectors.verdict("card 4111 1111 1111 1111 and HIPAA")
    assert [f["detector"] for f in v["findings"]] == ["payment_card", "kw_health_regulation"]
    assert (v["sensitivity_floor"], v["pii_floor"], v["blocks_backend"], v["advisory_topics"]) == ("regulated", 1.0, True, ["kw_health_regulation"])
    assert not detectors.verdict("write to sales@example.com")["fired"]
    assert detectors.verdict("bXkgc3NuIGlzIDEyMy00NS02Nzg5IQ==")["blocks_backend"], "base64 is decoded"
    assert detectors.verdict("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1")["blocks_backend"], "spaced digits collapse"
    assert detectors.verdict("token = abcdef0123456789")["fired"] is False
    assert detectors.verdict(None)["fired"] is False


def test_gate_column_equals_python(spark):
    texts = ["my ssn is 123-45-6789", "nothing here", "", None, "mail bob@corp.dev or call +44 2071 1234 56", "api_key=abcdefghij"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["g"].asDict(recursive=True) for r in df.select(detectors.gate(F.col("t")).alias("g")).collect()]
    assert got == [detectors.verdict(t) for t in texts]


def test_redaction():
    assert detectors.redacted("ssn 123-45-6789, mail bob@corp.dev") == ("ssn [us_ssn], mail [email_address]", 2)
    assert detectors.redacted("plain") == ("plain", 0)
    with pytest.raises(ValueError):
        detectors.active(["no_such_detector"])
    assert len(detectors.active(["us_ssn"])) == 21


def test_decision_math(spark):
    p = F.array(*[F.lit(x) for x in (0.7, 0.2, 0.1, 0.0)])
    entropy = -sum(x * math.log(x) for x in (0.7, 0.2, 0.1))
    assert one(spark, decision.certainty(p)) == pytest.approx(1 - entropy / math.log(4))
    assert one(spark, decision.margin(p)) == 0.5
    assert one(spark, decision.argmax(F.array(F.lit(0.5), F.lit(0.5)), ("a", "b"))) == "a"
    assert sum(one(spark, decision.softmax(p))) == pytest.approx(1, abs=1e-5)
    assert one(spark, decision.isotonic(F.lit(0.5), (0.1, 0.4, 0.9), (0.0, 0.3, 1.0))) == 0.3
    assert one(spark, decision.isotonic(F.lit(0.05), (0.1, 0.4), (0.2, 0.3))) == 0.2
    assert one(spark, schema.bump(F.lit("hard"), 5, schema.COMPLEXITY)) == "frontier"
    assert one(spark, schema.bump(F.lit("odd"), 1, schema.COMPLEXITY)) == "odd"
    assert one(spark, decision.merged_sensitivity(F.lit("public"), F.lit(None).cast("string"))) == "public"
    assert one(spark, decision.merged_sensitivity(F.lit("internal"), F.lit("regulated"))) == "regulated"
    kinds = [("local", "local", "correct"), ("local", "cheap", "unsafe"), ("cheap", "local", "expensive"), ("cheap", "strong", "overspend"), ("strong", "cheap", "underpowered")]
    for expected, predicted, kind in kinds:
        assert one(spark, decision.classify_error(F.lit(expected), F.lit(predicted))) == kind


def test_sampling(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    share = df.select(F.avg(text.sample_hit(F.col("k"), 0.25).cast("int"))).first()[0]
    assert 0.2 < share < 0.3
    lo, hi = df.select(F.min(text.split_bucket(F.col("k"))), F.max(text.split_bucket(F.col("k")))).first()
    assert 0 <= lo < 0.01 and 0.99 < hi < 1
