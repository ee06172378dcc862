"""Registered queries of evaluations: metrics, replay, graduation, dataset checks, comparisons; each beside its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions import decision
from lanewise.operators import analytics, evaluation
from lanewise.plans.policy import Policy
from lanewise.queries import _CLEAN, _LADDER, ROUTED, _routed, query, table

# ------------------------------------------------------------ a run over orders: gold labels, answers and tiers by fixed functions

_FIELDS = {
    "expected_tier": "CASE o_orderkey % 5 WHEN 0 THEN 'local' WHEN 1 THEN 'strong' WHEN 2 THEN 'strong' ELSE 'cheap' END",
    "tier": "CASE o_custkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'strong' WHEN 2 THEN 'cheap' END",
    "other_tier": "CASE o_custkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'strong' ELSE 'cheap' END",
    "error": "CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' END",
    "degraded": "o_custkey % 11 = 0",
    "difficulty": "CASE WHEN o_orderkey % 4 = 0 THEN 'ambiguous' ELSE 'clear' END",
    "gold_pii": "o_orderkey % 6 = 0",
    "pii": "o_custkey % 100 / 100.0",
    "answered": "o_orderkey % 13 <> 0",
    "reported": "o_custkey % 2 = 0",
    "said": "o_orderkey % 100 / 100.0",
    "fires": "o_custkey % 7 = 0",
}
_WEIGHTS = {"complexity": ("1 + id % 3", "1 + k % 5", "1 + (id + k) % 7", "1"), "sensitivity": ("2", "1 + k % 4", "1 + id % 5", "1 + (id + k) % 3"), "domain": ("1 + id % 2", "1 + k % 3", "2", "1 + id % 7", "1 + k % 6")}
_GOLD = {"complexity": ("id", 4), "sensitivity": ("k", 4), "domain": ("id + k", 5)}


def _ladder_sql(levels, at: str) -> str:
    return f"{_LADDER(levels)}[{at} + 1]"


RUN = (
    "run0 AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderpriority AS category, " + ", ".join(f"{v} AS {n}" for n, v in _FIELDS.items()) + " FROM orders), "
    + "run1 AS (SELECT *, " + ", ".join(f"[{', '.join(w)}]::DOUBLE[] AS w_{h}" for h, w in _WEIGHTS.items()) + ", " + ", ".join(f"{_ladder_sql(evaluation.HEADS[h], f'(({e}) % {n})')} AS gold_{h}" for h, (e, n) in _GOLD.items()) + " FROM run0), "
    + "run AS (SELECT *, " + ", ".join(f"list_transform(w_{h}, lambda x: x / list_sum(w_{h})) AS p_{h}, {_LADDER(evaluation.HEADS[h])}[list_position(w_{h}, list_max(w_{h}))] AS choice_{h}" for h in _WEIGHTS) + " FROM run1)"
)


def _run(spark, sf_dir) -> DataFrame:
    spark_sql = {n: v for n, v in _FIELDS.items()}
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS k", "o_orderpriority AS category", *[f"{v} AS {n}" for n, v in spark_sql.items()])
    rows = rows.withColumns({"pii": F.col("pii").cast("double"), "said": F.col("said").cast("double")})
    for head, weights in _WEIGHTS.items():
        ladder, (at, n) = evaluation.HEADS[head], _GOLD[head]
        w = [F.expr(x).cast("double") for x in weights]
        total = sum(w[1:], w[0])
        rows = rows.withColumn(f"p_{head}", F.array(*[x / total for x in w]))
        rows = rows.withColumn(f"gold_{head}", F.element_at(F.array(*[F.lit(x) for x in ladder]), F.expr(f"cast(({at}) % {n} + 1 as int)")))
        answer = F.struct(
            decision.argmax(F.col(f"p_{head}"), ladder).alias("choice"), F.col(f"p_{head}").alias("probabilities"), F.col("said").alias("confidence"), F.col("reported").alias("confidence_reported")
        )
        rows = rows.withColumn(head, F.when(F.col("answered"), answer))
    return rows


_SCORED = "(error IS NULL AND tier IS NOT NULL AND NOT degraded)"
_KIND = (
    "CASE WHEN expected_tier = tier THEN 'correct' WHEN expected_tier = 'local' THEN 'unsafe' WHEN tier = 'local' THEN 'expensive' "
    "WHEN list_position(['local', 'cheap', 'strong'], tier) > list_position(['local', 'cheap', 'strong'], expected_tier) THEN 'overspend' ELSE 'underpowered' END"
)
_METRICS = (
    f"count(*) AS n_rows, count(*) FILTER (WHERE {_SCORED}) AS n_scored, count(*) FILTER (WHERE error IS NOT NULL) AS excluded_error, "
    "count(*) FILTER (WHERE degraded AND error IS NULL) AS excluded_degraded, count(*) FILTER (WHERE error IS NULL AND tier IS NULL) AS excluded_tier, "
    f"round(count(*) FILTER (WHERE {_SCORED} AND kind = 'correct') / nullif(count(*) FILTER (WHERE {_SCORED}), 0)::DOUBLE, 6) AS accuracy, "
    f"round(count(*) FILTER (WHERE {_SCORED} AND kind = 'unsafe') / nullif(count(*) FILTER (WHERE {_SCORED}), 0)::DOUBLE, 6) AS unsafe_rate, "
    + ", ".join(f"count(*) FILTER (WHERE {_SCORED} AND kind = '{k}') AS {'unsafe_errors' if k == 'unsafe' else k + '_errors' if k != 'correct' else k}" for k in analytics.ERROR_KINDS)
)


@query(f"WITH {RUN}, j AS (SELECT *, {_KIND} AS kind FROM run) SELECT difficulty, {_METRICS} FROM j GROUP BY difficulty")
def tier_metrics(spark, sf_dir):
    """Tier accuracy and kinds of errors by difficulty; failed and degraded rows are left out and counted."""
    return evaluation.tier_metrics(_run(spark, sf_dir), ["difficulty"])


@query(f"WITH {RUN}, u AS (SELECT 'default' AS run, * REPLACE (tier AS tier) FROM run UNION ALL SELECT 'other', * REPLACE (other_tier AS tier) FROM run), j AS (SELECT *, {_KIND} AS kind FROM u) SELECT run, {_METRICS} FROM j GROUP BY run")
def compared_runs(spark, sf_dir):
    """Two configurations' metrics in one pass."""
    rows = _run(spark, sf_dir)
    return evaluation.compared_runs({"default": rows, "other": rows.withColumn("tier", F.col("other_tier"))})


@query(f"""
WITH {RUN}, a AS (SELECT {_METRICS} FROM (SELECT *, {_KIND} AS kind FROM run)), b AS (SELECT {_METRICS} FROM (SELECT *, {_KIND} AS kind FROM (SELECT * REPLACE (other_tier AS tier) FROM run)))
SELECT round(a.accuracy - b.accuracy, 6) AS accuracy_delta, a.unsafe_errors - b.unsafe_errors AS unsafe_delta, a.expensive_errors - b.expensive_errors AS expensive_delta FROM a, b
""")
def escalation_deltas(spark, sf_dir):
    """One configuration's metrics less another's."""
    rows = _run(spark, sf_dir)
    return evaluation.deltas(evaluation.tier_metrics(rows), evaluation.tier_metrics(rows.withColumn("tier", F.col("other_tier"))))


def _component_sql(head: str) -> str:
    ladder, g, c = evaluation.HEADS[head], f"gold_{head}", f"choice_{head}"
    f1 = [f"coalesce(2.0 * count(*) FILTER (WHERE answered AND {g} = '{x}' AND {c} = '{x}') / nullif(2 * count(*) FILTER (WHERE answered AND {g} = '{x}' AND {c} = '{x}') + count(*) FILTER (WHERE answered AND {g} <> '{x}' AND {c} = '{x}') + count(*) FILTER (WHERE answered AND {g} = '{x}' AND {c} <> '{x}'), 0)::DOUBLE, 0)" for x in ladder]
    return (
        f"SELECT '{head}' AS head, count(*) FILTER (WHERE answered) AS n_scored, count(*) FILTER (WHERE NOT answered) AS n_unclassified, 0::BIGINT AS argmax_mismatch_rows, "
        f"round(count(*) FILTER (WHERE answered AND {g} = {c}) / count(*) FILTER (WHERE answered)::DOUBLE, 6) AS accuracy, round(({' + '.join(f1)}) / {len(ladder)}, 6) AS macro_f1 FROM run"
    )


@query(f"WITH {RUN} " + " UNION ALL ".join(_component_sql(h) for h in _WEIGHTS))
def component_metrics(spark, sf_dir):
    """Accuracy and macro F1 of each head's own choices."""
    rows, out = _run(spark, sf_dir), None
    for head in _WEIGHTS:
        one = evaluation.component_metrics(rows, head, F.col(f"gold_{head}"), F.col(head))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""
WITH {RUN}, l AS (SELECT unnest(['local', 'cheap', 'strong', 'edge']) AS label), c AS (SELECT label, count(*) FILTER (WHERE expected_tier = label) AS support, count(*) FILTER (WHERE other_tier = label) AS predicted,
  count(*) FILTER (WHERE expected_tier = label AND other_tier = label) AS tp FROM l, run GROUP BY label),
r AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS r FROM c), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM r)
SELECT label, support, predicted, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(avg(f) FILTER (WHERE support > 0 OR predicted > 0) OVER (), 6) AS macro_f1 FROM f
""")
def classification_metrics(spark, sf_dir):
    """Per class metrics; the macro F1 leaves out a class that occurs on neither side."""
    pairs = _run(spark, sf_dir).select(F.col("expected_tier").alias("gold"), F.col("other_tier").alias("pred"))
    rows = evaluation.class_report(pairs, ("local", "cheap", "strong", "edge"))
    return rows.select("label", "support", "predicted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "macro_f1")])


def _samples(spark, sf_dir) -> DataFrame:
    return evaluation.calibration_samples(_run(spark, sf_dir), {h: F.col(f"gold_{h}") for h in _WEIGHTS}, {h: F.col(h) for h in _WEIGHTS})


def _heads_sql(columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT id, '{h}' AS head, gold_{h} AS gold, choice_{h} AS prediction, p_{h} AS p, CASE WHEN reported THEN said END AS confidence, list_position({_LADDER(evaluation.HEADS[h])}, gold_{h}) AS pos FROM run WHERE answered" for h in _WEIGHTS
    ).replace("SELECT id", f"SELECT {columns}")


@query(f"WITH {RUN}, s AS ({_heads_sql('id')}) SELECT head, gold, prediction, count(*) AS n, count(confidence) AS with_confidence, round(avg(list_max(p)), 6) AS mean_top FROM s GROUP BY ALL")
def calibration_samples(spark, sf_dir):
    """Samples of all heads in long form."""
    rows = _samples(spark, sf_dir)
    return rows.groupBy("head", "gold", "prediction").agg(F.count("*").alias("n"), F.count("confidence").alias("with_confidence"), F.round(F.avg(F.array_max("probabilities")), 6).alias("mean_top"))


_BLOCK = f"""{RUN}, s AS ({_heads_sql('id')}), t AS (SELECT *, coalesce(confidence, list_max(p)) AS c, (gold = prediction)::INT AS ok, list_sum(list_transform(p, lambda x: x * x)) - 2 * p[pos] + 1 AS b FROM s),
cells AS (SELECT head, least(floor(c * 15), 14) AS bin, count(*) AS n, avg(c) AS mc, avg(ok) AS acc, sum(b) AS b, sum(c) AS cs FROM t GROUP BY 1, 2),
block AS (SELECT head, sum(n)::BIGINT AS n, count(*) AS populated_bins, sum(n * abs(mc - acc)) / sum(n) AS ece, max(abs(mc - acc)) AS mce, sum(b) / sum(n) AS brier, sum(cs) / sum(n) AS mean_confidence FROM cells GROUP BY head)"""


@query(f"WITH {_BLOCK} SELECT head, n, populated_bins, round(ece, 6) AS ece, round(mce, 6) AS mce, round(brier, 6) AS brier, round(mean_confidence, 6) AS mean_confidence FROM block")
def calibration_block(spark, sf_dir):
    """Calibration of every head in one grouping."""
    return evaluation.calibration_block(_samples(spark, sf_dir)).select("head", "n", "populated_bins", *[F.round(c, 6).alias(c) for c in ("ece", "mce", "brier", "mean_confidence")])


@query(f"WITH {_BLOCK} SELECT arg_max(head, ece) AS worst_head, round(max(ece), 6) AS worst_ece FROM block")
def worst_calibrated_head(spark, sf_dir):
    rows = evaluation.worst_head(evaluation.calibration_block(_samples(spark, sf_dir)))
    return rows.select("worst_head", F.round("worst_ece", 6).alias("worst_ece"))


@query(f"""
WITH {RUN}, c AS (SELECT 'raw' AS view, gold_pii, pii >= 0.5 AS said FROM run WHERE answered UNION ALL SELECT 'effective', gold_pii, pii >= 0.35 FROM run),
t AS (SELECT view, count(*) FILTER (WHERE gold_pii AND said) AS tp, count(*) FILTER (WHERE NOT gold_pii AND NOT said) AS tn, count(*) FILTER (WHERE NOT gold_pii AND said) AS fp, count(*) FILTER (WHERE gold_pii AND NOT said) AS fn FROM c GROUP BY view)
SELECT view, tp, tn, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy FROM t
""")
def pii_views(spark, sf_dir):
    """Personal data as the scorer says it, and as the policy acts on it."""
    rows = _run(spark, sf_dir)
    raw = analytics.binary(rows.where("answered"), F.col("gold_pii"), F.col("pii") >= 0.5).withColumn("view", F.lit("raw"))
    both = raw.unionByName(analytics.binary(rows, F.col("gold_pii"), F.col("pii") >= 0.35).withColumn("view", F.lit("effective")))
    return both.select("view", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")])


@query(f"WITH {RUN} SELECT count(*) AS pii_rows, count(*) FILTER (WHERE fires) AS pii_fires, count(*) FILTER (WHERE NOT fires) AS missed, count(DISTINCT category) AS categories FROM run WHERE gold_pii")
def pii_coverage(spark, sf_dir):
    return evaluation.pii_coverage(_run(spark, sf_dir), "category", F.col("fires"), F.col("gold_pii"))


@query(f"""
WITH {RUN}, r AS (SELECT CASE id % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' ELSE 'e' END AS category, CASE id % 6 WHEN 0 THEN 'local' WHEN 1 THEN 'local' WHEN 2 THEN 'strong' WHEN 3 THEN 'cheap' ELSE coalesce(tier, 'cheap') END AS tier,
  CASE id % 6 WHEN 0 THEN true WHEN 1 THEN false ELSE fires END AS fires FROM run),
g AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE fires) AS fires, count(*) FILTER (WHERE tier = 'local') AS l, count(*) FILTER (WHERE tier = 'cheap') AS c, count(*) FILTER (WHERE tier = 'strong') AS s FROM r GROUP BY category)
SELECT category, n, CASE WHEN l = n AND fires = n THEN 'gate forces local on every row (see Gate)' WHEN l = n THEN 'policy routes the category to local' WHEN s = n THEN 'hard complexity maps to the strong tier'
  WHEN c = n THEN 'default rule: no sensitivity signal, non-hard complexity'
  ELSE concat_ws('; ', CASE WHEN least(fires, l) > 0 THEN least(fires, l) || ' gate-forced local' END, CASE WHEN l > least(fires, l) THEN (l - least(fires, l)) || ' local by policy' END,
    CASE WHEN c >= s AND c > 0 THEN c || ' to `cheap` by policy' WHEN s > c THEN s || ' to `strong` by policy' END, CASE WHEN c >= s AND s > 0 THEN s || ' to `strong` by policy' WHEN s > c AND c > 0 THEN c || ' to `cheap` by policy' END) || CASE WHEN fires > 0 THEN ' (see Gate)' ELSE '' END END AS reason FROM g
""")
def tier_reasons(spark, sf_dir):
    """Why categories land on their tiers, in words."""
    rows = _run(spark, sf_dir).selectExpr(
        "CASE id % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' ELSE 'e' END AS category",
        "CASE id % 6 WHEN 0 THEN 'local' WHEN 1 THEN 'local' WHEN 2 THEN 'strong' WHEN 3 THEN 'cheap' ELSE coalesce(tier, 'cheap') END AS tier", "CASE id % 6 WHEN 0 THEN true WHEN 1 THEN false ELSE fires END AS fires",
    )
    return evaluation.tier_reasons(rows, "category", F.col("fires"))


# ------------------------------------------------------------ replay and graduation


@query(f"""
WITH {ROUTED}, e AS (SELECT *, CASE WHEN s_conf < 0.8 THEN least(list_position({_LADDER(schema.SENSITIVITY)}, sensitivity) + 1, 4) ELSE list_position({_LADDER(schema.SENSITIVITY)}, sensitivity) END AS ri FROM routed)
SELECT doc_id, {_LADDER(schema.SENSITIVITY)}[ri] AS sensitivity, CASE WHEN ri >= 3 OR pii >= 0.35 THEN 'local' WHEN ci >= 3 THEN 'strong' ELSE 'cheap' END AS tier FROM e
""")
def policy_replay(spark, sf_dir):
    """Logged answers through the policy again; the very unsure are not forced to the local tier."""
    from lanewise.queries import _scored

    rows = evaluation.replayed(_scored(spark, sf_dir).withColumn("gate", F.expr(_CLEAN)), Policy())
    return rows.select("doc_id", "sensitivity", "tier")


@query(f"""
WITH {RUN}, a AS (SELECT count(*) FILTER (WHERE NOT fires) AS compared, count(*) FILTER (WHERE NOT fires AND other_tier = expected_tier) AS agreed FROM run),
m AS (SELECT agreed / compared::DOUBLE AS t, compared AS n FROM a), c AS (SELECT unnest(['min_tier_agreement', 'max_ece', 'max_latency_ms', 'min_samples']) AS name, unnest([t, 0.08, 12.5, n::DOUBLE]) AS measured, unnest([0.2, 0.1, 10.0, 500.0])::DOUBLE AS bar FROM m)
SELECT name, round(measured, 6) AS measured, bar, CASE WHEN name LIKE 'min%' THEN measured >= bar ELSE measured <= bar END AS ok FROM c
""")
def graduate_gates(spark, sf_dir):
    """The four gates of a graduation, with two bars relaxed."""
    one = evaluation.agreement(_run(spark, sf_dir), "other_tier", "expected_tier", F.col("fires"))
    metrics = one.select("tier_agreement", F.lit(0.08).alias("worst_ece"), F.lit(12.5).alias("p50_ms"), F.col("compared").alias("n_rows"))
    rows = evaluation.graduation_checks(metrics, {"min_tier_agreement": 0.2, "max_latency_ms": 10.0})
    return rows.select("name", F.round("measured", 6).alias("measured"), "bar", "ok")


@query(f"""
WITH {RUN}, r AS (SELECT *, id % 3 <> 0 AS logged FROM run WHERE tier IS NOT NULL)
SELECT count(*) AS rows, count(*) FILTER (WHERE NOT degraded) AS compared, count(*) FILTER (WHERE NOT degraded AND other_tier = tier) AS agreed, count(*) FILTER (WHERE logged AND tier <> expected_tier) AS teacher_drift_rows,
  round(count(*) FILTER (WHERE NOT degraded AND other_tier = tier) / count(*) FILTER (WHERE NOT degraded)::DOUBLE, 6) AS tier_agreement, round(count(*) FILTER (WHERE logged AND tier <> expected_tier) / count(*)::DOUBLE, 6) AS teacher_drift_rate FROM r
""")
def replay_drift(spark, sf_dir):
    """A student beside the live teacher, and the teacher beside its own log."""
    rows = _run(spark, sf_dir).where("tier is not null").withColumn("request_id", F.col("id"))
    logged = rows.where("id % 3 <> 0").select("request_id", F.col("expected_tier").alias("tier"))
    out = evaluation.replay_drift(logged, rows.select("request_id", "tier", "degraded"), rows.select("request_id", F.col("other_tier").alias("tier")))
    return out.select("rows", "compared", "agreed", "teacher_drift_rows", F.round("tier_agreement", 6).alias("tier_agreement"), F.round("teacher_drift_rate", 6).alias("teacher_drift_rate"))


# ------------------------------------------------------------ datasets

_EVAL = f"""{RUN}, ds AS (SELECT CASE id % 40 WHEN 0 THEN 'neg-' WHEN 1 THEN 'inj-' WHEN 2 THEN 'hu-' WHEN 3 THEN 'de-' ELSE 'row-' END || id AS id, id AS k0, gold_complexity AS cpx, gold_sensitivity AS sens, gold_domain AS dom, gold_pii AS pii, difficulty,
  CASE WHEN id % 50 = 7 THEN 'local' WHEN gold_sensitivity IN ('confidential', 'regulated') OR gold_pii THEN 'local' WHEN gold_complexity IN ('hard', 'frontier') THEN 'strong' ELSE 'cheap' END AS expected_tier,
  repeat('word ', (id % 300)::INT) || id AS text, CASE WHEN id % 60 = 9 THEN 'short' ELSE 'a note that is long enough' END AS notes FROM run)"""


def _dataset(spark, sf_dir) -> DataFrame:
    rows = _run(spark, sf_dir)
    from lanewise.functions.answers import intended_tier

    prefix = F.expr("CASE id % 40 WHEN 0 THEN 'neg-' WHEN 1 THEN 'inj-' WHEN 2 THEN 'hu-' WHEN 3 THEN 'de-' ELSE 'row-' END")
    want = intended_tier(F.col("gold_complexity"), F.col("gold_sensitivity"), F.col("gold_pii"))
    return rows.select(
        F.concat(prefix, F.col("id").cast("string")).alias("id"), F.concat(F.repeat(F.lit("word "), (F.col("id") % 300).cast("int")), F.col("id").cast("string")).alias("text"),
        F.struct(F.col("gold_complexity").alias("complexity"), F.col("gold_sensitivity").alias("sensitivity"), F.col("gold_domain").alias("domain"), F.col("gold_pii").alias("pii")).alias("labels"),
        F.when(F.col("id") % 50 == 7, "local").otherwise(want).alias("expected_tier"), "difficulty", F.when(F.col("id") % 60 == 9, "short").otherwise("a note that is long enough").alias("notes"),
    )


_STATS = f"""{_EVAL}, x AS (SELECT unnest(['complexity', 'sensitivity', 'domain', 'tier', 'difficulty']) AS dim, unnest([cpx, sens, dom, expected_tier, difficulty]) AS value FROM ds
  UNION ALL SELECT 'total', NULL FROM ds UNION ALL SELECT 'pii_true', NULL FROM ds WHERE pii UNION ALL SELECT 'pii_false_sensitive', NULL FROM ds WHERE NOT pii AND sens IN ('confidential', 'regulated')
  UNION ALL SELECT 'negative_controls', NULL FROM ds WHERE id LIKE 'neg-%' UNION ALL SELECT 'injection', NULL FROM ds WHERE id LIKE 'inj-%' UNION ALL SELECT 'hungarian', NULL FROM ds WHERE id LIKE 'hu-%'
  UNION ALL SELECT 'german', NULL FROM ds WHERE id LIKE 'de-%' UNION ALL SELECT 'long', NULL FROM ds WHERE length(text) >= 800), stats AS (SELECT dim, value, count(*) AS n FROM x GROUP BY ALL)"""


@query(f"WITH {_STATS} SELECT dim, value, n FROM stats")
def coverage_stats(spark, sf_dir):
    """Rows per level of every label, and the counts a dataset needs."""
    return evaluation.coverage_stats(_dataset(spark, sf_dir))


@query(f"""
WITH {_STATS}, w AS (SELECT 'german' AS dim, NULL AS value, 1000000 AS least UNION ALL SELECT 'total', NULL, 1 UNION ALL SELECT 'complexity', unnest({_LADDER(schema.COMPLEXITY)}), 2000000)
SELECT w.dim, w.value, coalesce(s.n, 0) AS n, w.least::BIGINT AS least FROM w LEFT JOIN stats s ON s.dim = w.dim AND s.value IS NOT DISTINCT FROM w.value WHERE coalesce(s.n, 0) < w.least
""")
def coverage_minimums(spark, sf_dir):
    """Counts below what is asked for."""
    return evaluation.minimum_faults(evaluation.coverage_stats(_dataset(spark, sf_dir)), {"german": 1_000_000, "total": 1, "complexity": 2_000_000})


@query(f"""
WITH {_EVAL} SELECT fault, count(*) AS n FROM (
  SELECT 'notes too short' AS fault FROM ds WHERE notes = 'short' UNION ALL SELECT 'text too short' FROM ds WHERE length(trim(text)) < 8
  UNION ALL SELECT 'tier is not the policy''s' FROM ds WHERE k0 % 50 = 7 AND NOT (sens IN ('confidential', 'regulated') OR pii)) GROUP BY fault
""")
def dataset_faults(spark, sf_dir):
    """Faults of dataset rows by kind."""
    return evaluation.row_faults(_dataset(spark, sf_dir)).groupBy("fault").agg(F.count("*").alias("n"))


@query(f"WITH {_EVAL} SELECT round(avg((difficulty = 'ambiguous')::INT), 6) AS share, avg((difficulty = 'ambiguous')::INT) BETWEEN 0.1 AND 0.4 AS ok FROM ds")
def ambiguous_share(spark, sf_dir):
    return evaluation.ambiguous_share(evaluation.coverage_stats(_dataset(spark, sf_dir))).select(F.round("share", 6).alias("share"), "ok")


@query("SELECT CASE event_id % 5 WHEN 0 THEN 'blank line' WHEN 1 THEN 'malformed JSON' ELSE 'not an object' END AS fault, count(*) AS n FROM events WHERE event_id % 5 IN (0, 1, 2) GROUP BY 1")
def line_faults(spark, sf_dir):
    """Raw lines that are no JSON object."""
    body = "CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN concat('{', event_type) WHEN 2 THEN '[1]' ELSE concat('{\"id\": ', cast(event_id as string), '}') END AS value"
    return evaluation.line_faults(table(spark, sf_dir, "events").selectExpr(body)).groupBy("fault").agg(F.count("*").alias("n"))


# ------------------------------------------------------------ shadows, questions, joins of records


@query(f"""
WITH {RUN}, c AS (SELECT *, id % 9 <> 0 AS completed, tier IS NOT NULL AND id % 9 <> 0 AND NOT degraded AND tier <> other_tier AS d1, id % 9 <> 0 AND NOT degraded AND gold_complexity <> choice_complexity AS d2 FROM run)
SELECT count(*) AS calls, count(*) FILTER (WHERE completed) AS completed, count(*) FILTER (WHERE completed AND degraded) AS degraded, count(*) FILTER (WHERE d1 OR d2) AS disagreements, count(*) FILTER (WHERE d1) AS differs_tier, count(*) FILTER (WHERE d2) AS differs_complexity,
  round(count(*) FILTER (WHERE d1 OR d2) / count(*) FILTER (WHERE completed)::DOUBLE, 6) AS disagreement_rate FROM c
""")
def shadow_backend_stats(spark, sf_dir):
    """Counters of a shadowed scorer, with disagreements by field."""
    rows = _run(spark, sf_dir).withColumns({"shadow_tier": F.col("other_tier"), "shadow_complexity": decision.argmax(F.col("p_complexity"), schema.COMPLEXITY), "complexity": F.col("gold_complexity")})
    return evaluation.shadow_stats(rows.withColumn("tier", F.coalesce("tier", "other_tier")), ("tier", "complexity"), F.col("id") % 9 != 0, F.col("degraded"))


@query("SELECT event_type, count(*) AS n, min(event_id) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 256 GROUP BY event_type")
def recent_reports(spark, sf_dir):
    """The last 256 reports of each kind."""
    return evaluation.recent_reports(table(spark, sf_dir, "events"), "event_type", "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("oldest"))


@query(f"""
WITH {RUN}, r AS (SELECT *, NOT gold_pii AS counted, greatest(1, (id % 5000) // 4) AS tok FROM run), s AS (SELECT
  count(*) FILTER (WHERE counted AND other_tier = expected_tier) / count(*)::DOUBLE AS accuracy,
  greatest(0, 1 - sum(CASE WHEN counted THEN (tok + 400) / 1000.0 * CASE other_tier WHEN 'local' THEN 0.0 WHEN 'cheap' THEN 0.0003 ELSE 0.003 END END) / sum(CASE WHEN counted THEN (tok + 400) / 1000.0 * 0.015 END)) AS savings FROM r),
m AS (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) AS misses FROM (SELECT id FROM r WHERE counted AND other_tier <> expected_tier ORDER BY id LIMIT 12))
SELECT round(accuracy, 6) AS accuracy, round(savings, 6) AS savings, round(accuracy + 0.25 * savings, 6) AS score, misses FROM s, m
""")
def question_score(spark, sf_dir):
    """Accuracy, saving and score of a wording, and its first misses."""
    rows = _run(spark, sf_dir).withColumn("chars", F.col("id") % 5000)
    out = evaluation.question_score(rows, "expected_tier", "other_tier", "chars", ~F.col("gold_pii"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "savings", "score")], F.array_join("misses", ",").alias("misses"))


@query(f"WITH {RUN} SELECT r.id, r.tier, CASE WHEN r.fires THEN 'regulated' END AS refused_floor FROM run r")
def decision_refusal_join(spark, sf_dir):
    """Decisions beside the refusals of the same requests."""
    rows = _run(spark, sf_dir).withColumns({"request_id": F.col("id").cast("string"), "timestamp": F.col("k").cast("string")})
    refusals = rows.where("fires").select("request_id", "timestamp", F.create_map(F.lit("us_ssn"), F.lit(1)).alias("detectors"), F.lit("regulated").alias("sensitivity_floor"))
    return evaluation.with_refusals(rows, refusals).select("id", "tier", "refused_floor")


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1")
def fresh_texts(spark, sf_dir):
    """Candidates that are not among excluded texts."""
    rows = table(spark, sf_dir, "customer").withColumn("text", F.col("c_name"))
    return evaluation.fresh(rows, rows.where("c_custkey % 3 = 0")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT pass, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM (SELECT pass, row_number() OVER (PARTITION BY user_id ORDER BY pass, event_id) > 1 AS hit FROM events, (SELECT unnest([1, 2]) AS pass)) GROUP BY pass")
def cache_passes(spark, sf_dir):
    """A cold and a warm pass over one cache."""
    from lanewise.operators.dedupe import cache_hits

    rows = evaluation.eval_passes(table(spark, sf_dir, "events").select("user_id", "event_id")).withColumn("at", F.struct("pass", "event_id"))
    return cache_hits(rows, "user_id", "at").groupBy("pass").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query(f"WITH {ROUTED} SELECT CASE WHEN doc_id % 4 = 0 THEN 'b' ELSE 'a' END AS run, count(*) FILTER (WHERE tier = 'local') AS local, count(*) AS n FROM routed GROUP BY 1")
def backend_gap(spark, sf_dir):
    """How two scorers' tiers are shared out, side by side."""
    rows = _routed(spark, sf_dir).withColumn("run", F.when(F.col("doc_id") % 4 == 0, "b").otherwise("a"))
    return rows.groupBy("run").agg(F.count_if(F.col("tier") == "local").alias("local"), F.count("*").alias("n"))
