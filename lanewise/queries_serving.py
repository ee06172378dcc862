"""Registered queries of the serving side: answers, states, quota, pre-filter, masking; each beside its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions import answers, decision, detectors, text
from lanewise.plans import providers
from lanewise.plans.policy import Policy
from lanewise.queries import _CLEAN, _LADDER, DOCS, P, _prompts, _requests, query, table

# ------------------------------------------------------------ raw answers


def _raw_sql(dialect: str) -> str:
    """Response bodies of eight kinds, by customer: whole, under other names, with wrong types, broken."""
    s = lambda expr: f"cast({expr} as {'string' if dialect == 'spark' else 'varchar'})"
    k = "c_custkey"

    def choice(name: str, said: str, shares: dict[str, str], confidence: str = "") -> str:
        listed = " || ',' || ".join(f"'\"{level}\":' || {v}" for level, v in shares.items())
        return f"'\"{name}\":{{\"choice\":{said},\"probabilities\":{{' || {listed} || '}}{confidence}}}'"

    full = {x: s(f"{k} % {m}") for x, m in zip(schema.COMPLEXITY, (5, 7, 11, 3), strict=True)}
    sens = {x: s(f"{k} % {m}") for x, m in zip(schema.SENSITIVITY, (3, 4, 6, 9), strict=True)}
    dom = {x: s(f"{k} % {m}") for x, m in zip(schema.DOMAINS, (4, 3, 5, 2, 6), strict=True)}
    odd = {"trivial": "'\"0.9\"'", "standard": "'-1'", "hard": s(f"{k} % 2"), "frontier": "'true'", "other": "'5'"}
    conf = ",\"confidence\":0.' || lpad(" + s(f"{k} % 90 + 10") + ", 2, '0') || '"
    body = lambda *parts: "'{\"answers\":{' || " + " || ',' || ".join(parts) + " || '}}'"
    cases = (
        body(choice("complexity", '"hard"', full, conf), choice("sensitivity", '"public"', sens), choice("domain", '"chat"', dom, conf), "'\"pii_present\":{\"noul\":0.25}'"),
        body(choice("complexity", '"impossible"', full), choice("data_sensitivity", '""', sens, conf), choice("task_domain", "null", dom), "'\"has_pii\":{\"noul\":0.75}'"),
        body(choice("complexity", '"trivial"', odd), "'\"sensitivity\":\"regulated\"'", choice("sensitivity_level", '"internal"', sens), "'\"pii\":{\"noul\":\"0.9\"}'"),
        "'{\"ok\":true}'",
        "'[1,2]'",
        "'oops{'",
        body(choice("complexity", '"standard"', full), "'\"pii_present\":{\"noul\":true}'"),
        body(choice("complexity", "7", {x: "'0'" for x in schema.COMPLEXITY}), "'\"pii_present\":{\"noul\":7}'"),
    )
    return f"CASE {k} % 8 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


def _num(j: str, path: str) -> str:
    kind, value = f"json_type({j}, '{path}')", f"json_extract_string({j}, '{path}')"
    return f"CASE WHEN {kind} = 'BOOLEAN' THEN ({value}::BOOLEAN)::INT::DOUBLE WHEN {kind} IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN {value}::DOUBLE END"


def _object(paths: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(j, '{p}') = 'OBJECT' THEN json_extract(j, '{p}') END" for p in paths) + ")"


def _choice_sql(head: str) -> str:
    """SQL of one head: p (shares), choice, confidence, reported; over the object column o_<head>."""
    ladder, o = answers.LADDERS[head], f"o_{head}"
    known = [f"CASE WHEN ({_num(o, f'$.probabilities.\"{x}\"')}) >= 0 THEN {_num(o, f'$.probabilities.\"{x}\"')} END" for x in ladder]
    return f"[{', '.join(known)}]::DOUBLE[] AS k_{head}, json_extract_string({o}, '$.choice') AS c_{head}, json_type({o}, '$.choice') AS t_{head}, {_num(o, '$.confidence')} AS n_{head}"


def _picked_sql(head: str) -> str:
    ladder, fallback = answers.LADDERS[head], answers.FALLBACK[head]
    n, names = len(ladder), _LADDER(ladder)
    none = f"(o_{head} IS NULL OR len(list_filter(k_{head}, lambda x: x IS NOT NULL)) = 0)"
    total = f"list_sum(list_transform(k_{head}, lambda x: coalesce(x, 0)))"
    p = f"list_transform(k_{head}, lambda x: CASE WHEN {total} > 0 THEN coalesce(x, 0) / {total} ELSE coalesce(x, 0) END)"
    said = f"CASE WHEN t_{head} = 'VARCHAR' AND c_{head} <> '' THEN c_{head} ELSE '{fallback}' END"
    certain = f"greatest(0, least(1, 1 - coalesce(list_sum(list_transform(list_filter({p}, lambda x: x > 0), lambda x: -x * ln(x))), 0) / ln({n}.0)))"
    return (
        f"CASE WHEN {none} THEN '{ladder[n // 2]}' WHEN list_contains({names}, {said}) THEN {said} ELSE {names}[list_position({p}, list_max({p}))] END AS {head}, "
        f"round(CASE WHEN {none} THEN {1 / n} ELSE ({p})[1] END, 6) AS {head}_first, "
        f"round(CASE WHEN {none} THEN 0 ELSE coalesce(n_{head}, {certain}) END, 4)::DOUBLE AS {head}_confidence, "
        f"NOT {none} AND n_{head} IS NOT NULL AS {head}_reported"
    )


_PATHS = {h: [f"$.answers.{n}" for n in names] for h, names in answers.ALIASES.items()}
PARSED = (
    f"raw AS (SELECT c_custkey AS id, {_raw_sql('duckdb')} AS r FROM customer), jj AS (SELECT id, CASE WHEN json_valid(r) THEN r::JSON END AS j FROM raw), "
    + "oo AS (SELECT id, " + ", ".join(f"{_object(p)} AS o_{h}" for h, p in _PATHS.items()) + " FROM jj), "
    + "kk AS (SELECT *, " + ", ".join(_choice_sql(h) for h in answers.LADDERS) + f", {_num('o_pii', '$.noul')} AS n_pii FROM oo)"
)


def _parsed(spark, sf_dir) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_raw_sql("spark")).alias("raw"))
    return answers.parsed_answers(raw, "raw")


@query(f"WITH {PARSED} SELECT id, {', '.join(_picked_sql(h) for h in answers.LADDERS)}, CASE WHEN n_pii IS NULL THEN 0.5 ELSE least(1, greatest(0, n_pii)) END::DOUBLE AS pii FROM kk")
def parsed_answers(spark, sf_dir):
    """Response bodies, whole and broken, as choices, shares and confidences."""
    rows = _parsed(spark, sf_dir)
    out = [c for h in answers.LADDERS for c in (F.col(f"{h}.choice").alias(h), F.round(F.col(f"{h}.probabilities")[0], 6).alias(f"{h}_first"), F.round(F.col(f"{h}.confidence"), 4).alias(f"{h}_confidence"), F.col(f"{h}.confidence_reported").alias(f"{h}_reported"))]
    return rows.select("id", *out, "pii")


@query(f"WITH {PARSED}, s AS (SELECT {', '.join(_picked_sql(h) for h in answers.LADDERS)}, CASE WHEN n_pii IS NULL THEN 0.5 ELSE least(1, greatest(0, n_pii)) END AS pii FROM kk) SELECT complexity, sensitivity, domain, count(*) AS n, round(avg(pii), 6) AS pii FROM s GROUP BY ALL")
def cached_results(spark, sf_dir):
    """Results written as text for a shared cache and read back, with whole distributions."""
    rows = _parsed(spark, sf_dir).withColumns({"model_version": F.lit("v1"), "latency_ms": F.lit(1.5), "degraded": F.lit(False), "degrade_reason": F.lit(None).cast("string")})
    names = ("complexity", "sensitivity", "domain", "pii", "model_version", "latency_ms", "degraded", "degrade_reason")
    back = rows.select(answers.from_cached(answers.to_cached(F.struct(*names))).alias("r"))
    return back.groupBy(F.col("r.complexity.choice").alias("complexity"), F.col("r.sensitivity.choice").alias("sensitivity"), F.col("r.domain.choice").alias("domain")).agg(F.count("*").alias("n"), F.round(F.avg("r.pii"), 6).alias("pii"))


@query(f"""
WITH {PARSED}, q AS (SELECT id, list_transform(k_complexity, lambda x: coalesce(x, 0) / nullif(list_sum(list_transform(k_complexity, lambda y: coalesce(y, 0))), 0)) AS p FROM kk WHERE id % 8 = 0)
SELECT id, CASE WHEN p[1] IS NOT NULL THEN round(greatest(0, least(1, 1 - coalesce(list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: -x * ln(x))), 0) / ln(4.0))), 4)::DOUBLE END AS confidence, false AS reported FROM q
""")
def derived_confidence(spark, sf_dir):
    """Reported confidences replaced by the certainty of the shares; null where no share is positive."""
    rows = _parsed(spark, sf_dir).where("id % 8 = 0").select("id", answers.with_derived_confidence(F.col("complexity")).alias("c"))
    return rows.select("id", F.when(F.array_max("c.probabilities") > 0, F.round("c.confidence", 4)).alias("confidence"), F.col("c.confidence_reported").alias("reported"))


# ------------------------------------------------------------ states and budgets


@query("SELECT c_custkey AS id, 'segment,team' AS keys, 2 AS hints, length(c_name) AS excerpt_chars, c_mktsegment AS segment FROM customer")
def decision_states(spark, sf_dir):
    """What a service is shown: no metadata key that may carry text."""
    rows = table(spark, sf_dir, "customer")
    meta = F.create_map(*[x for k, v in (("segment", F.col("c_mktsegment")), ("team", F.lit("a")), ("messages", F.col("c_name")), ("raw", F.col("c_name")), ("body", F.lit("b"))) for x in (F.lit(k), v)])
    s = answers.state(F.col("c_name"), F.struct(F.length("c_name").alias("char_len")), meta, F.array(F.lit("kw_a"), F.lit("kw_b")))
    rows = rows.select(F.col("c_custkey").alias("id"), s.alias("s"))
    return rows.select(
        "id", F.array_join(F.array_sort(F.map_keys("s.caller_metadata")), ",").alias("keys"), F.size("s.local_gate_topic_hints").alias("hints"),
        F.col("s.request_features.char_len").alias("excerpt_chars"), F.col("s.caller_metadata")["segment"].alias("segment"),
    )


#: Room of an encoder and of its question heads, in words.
ENCODER, HEAD = 160, 96


def _room() -> int:
    asked = answers.questions()["sensitivity"]
    return ENCODER - answers.head_tokens(asked, lambda s: len(s.split()), HEAD) - 1


@query(f"""
WITH {DOCS}, w AS (SELECT doc_id, string_split_regex(regexp_replace(t, '\\s+$', ''), '\\s+') AS w FROM docs)
SELECT doc_id, CASE WHEN len(w) <= {_room()} THEN len(w) ELSE {_room()} + 1 END AS kept, CASE WHEN len(w) <= {_room()} THEN 'none' ELSE 'head+tail' END AS strategy, w[1] AS first, w[len(w)] AS last FROM w
""")
def excerpt_budget(spark, sf_dir):
    """Excerpts cut to the room that a question leaves, head and tail, by words."""
    rows = _requests(spark, sf_dir).withColumn("cut", text.head_tail(F.col("excerpt"), _room())).withColumn("n", F.size(F.split(text.strip(F.col("excerpt")), r"\s+")))
    parts = F.split("cut", r"\s+")
    return rows.select("doc_id", F.size(parts).alias("kept"), F.when(F.col("n") <= _room(), "none").otherwise("head+tail").alias("strategy"), parts[0].alias("first"), F.element_at(parts, -1).alias("last"))


# ------------------------------------------------------------ masking

MASKED = ("us_ssn", "medical_record_number")
_PLAIN = {"us_ssn": r"\b\d{3}-\d{2}-\d{4}\b", "medical_record_number": detectors.BY_NAME["medical_record_number"].pattern}


@query(f"WITH {P} SELECT id, regexp_replace(regexp_replace(t, '{_PLAIN['us_ssn']}', '[masked-us_ssn]', 'g'), '(?i){_PLAIN['medical_record_number']}', '[masked-medical_record_number]', 'g') AS masked FROM p")
def masked_secrets(spark, sf_dir):
    """Examples with their identifiers masked, by two detectors."""
    some = detectors.active([d.name for d in detectors.DETECTORS if d.name not in MASKED])
    return _prompts(spark, sf_dir).select("id", detectors.mask_secrets(F.col("text"), some).alias("masked"))


@query(f"""
WITH {P}, m AS (SELECT id, t, 'us_ssn' AS detector, regexp_extract(t, '{_PLAIN['us_ssn']}') AS m FROM p UNION ALL SELECT id, t, 'medical_record_number', regexp_extract(t, '(?i){_PLAIN['medical_record_number']}') FROM p)
SELECT id, detector, (instr(t, m) - 1)::INTEGER AS start, (instr(t, m) - 1 + length(m))::INTEGER AS "end" FROM m WHERE m <> ''
""")
def redaction_spans(spark, sf_dir):
    """Where each identifier stands in a text (the text alone, without decoded variants)."""
    some = detectors.active([d.name for d in detectors.DETECTORS if d.name not in MASKED])
    rows = _prompts(spark, sf_dir).select("id", F.explode(detectors.redaction_map(F.col("text"), some)).alias("s"))
    return rows.select("id", "s.detector", "s.start", "s.end")


@query(f"""
WITH {P}, s AS (SELECT id, t, regexp_matches(t, '{_PLAIN['us_ssn']}') AS ssn, regexp_matches(t, '(?i){_PLAIN['medical_record_number']}') AS mrn FROM p)
SELECT id, CASE WHEN ssn THEN 'blocks:us_ssn' WHEN mrn THEN {"'" + ("blocks" if detectors.BY_NAME["medical_record_number"].blocks else "local") + ":medical_record_number'"} ELSE 'clean' END AS label,
  CASE WHEN ssn THEN 'blocks' WHEN mrn THEN '{"blocks" if detectors.BY_NAME["medical_record_number"].blocks else "fires"}' ELSE 'none' END AS expectation,
  CASE WHEN ssn THEN '{detectors.BY_NAME["us_ssn"].floor}' WHEN mrn THEN '{detectors.BY_NAME["medical_record_number"].floor}' END AS floor, (ssn::INT + mrn::INT)::INTEGER AS findings,
  CASE WHEN ssn THEN substr(sha256(regexp_extract(t, '{_PLAIN['us_ssn']}')), 1, 16) WHEN mrn THEN substr(sha256(regexp_extract(t, '(?i){_PLAIN['medical_record_number']}')), 1, 16) END AS span_hash
FROM s
""")
def gate_scan(spark, sf_dir):
    """The exact gate with two detectors: verdict, floor, findings and span hashes."""
    some = detectors.active([d.name for d in detectors.DETECTORS if d.name not in MASKED])
    rows = _prompts(spark, sf_dir).withColumn("g", detectors.gate(F.col("text"), some))
    return rows.select(
        "id", decision.gate_label(F.col("g")).alias("label"), answers.gate_expectation(F.col("g")).alias("expectation"), F.col("g.sensitivity_floor").alias("floor"),
        F.size("g.findings").alias("findings"), F.try_element_at("g.findings", F.lit(1))["span_hash"].alias("span_hash"),
    )


# ------------------------------------------------------------ quota, pre-filter, pass-through

_REASON = "CASE event_id % 7 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'Quota exceeded' WHEN 2 THEN 'timeout' WHEN 3 THEN 'HTTP 503' END"
_MODEL = "CASE event_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'cheap-model' WHEN 2 THEN '' END"


def _calls(spark, sf_dir) -> DataFrame:
    tier = "CASE user_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'cheap' ELSE 'strong' END"
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_REASON} AS degrade_reason", f"{_MODEL} AS requested_model", f"{tier} AS tier", "user_id % 5 = 0 AS elsewhere")


@query(f"SELECT event_id, coalesce(({_REASON}) IN ('HTTP 429', 'Quota exceeded'), false) AS quota, coalesce(({_MODEL}) = 'cheap-model', false) AS bypass, coalesce(({_MODEL}) IN ('auto', 'cheap-model'), false) AS managed FROM events")
def quota_and_bypass(spark, sf_dir):
    """Quota errors, pinned models and models that an integration may rewrite."""
    managed = providers.managed_models(" auto, cheap-model ,")
    rows = _calls(spark, sf_dir)
    return rows.select(
        "event_id", providers.is_quota_error(F.col("degrade_reason")).alias("quota"), providers.is_bypass(F.col("requested_model"), Policy(), pinned=True).alias("bypass"),
        providers.is_managed(F.col("requested_model"), managed).alias("managed"),
    )


@query(f"""
WITH c AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'cheap' ELSE 'strong' END AS tier, coalesce(({_REASON}) IN ('HTTP 429', 'Quota exceeded'), false) AS q, user_id % 5 = 0 AS elsewhere FROM events),
m AS (SELECT tier, min(event_id) AS since FROM c WHERE q GROUP BY tier)
SELECT event_id, coalesce((SELECT string_agg(m.tier, ',' ORDER BY m.tier) FROM m WHERE m.since < c.event_id), '') AS spent,
  CASE WHEN q AND elsewhere THEN 'provider flip' WHEN q AND tier = 'strong' THEN 'tandem' WHEN q THEN 'no tandem' END AS quota_served, CASE WHEN q AND NOT elsewhere AND tier = 'strong' THEN 'strong-b' ELSE tier || '-model' END AS model FROM c
""")
def quota_tandem(spark, sf_dir):
    """Calls with quota errors served by another provider or a tandem model, and the tiers spent before each call."""
    rows = providers.with_quota(_calls(spark, sf_dir), Policy(), {"strong": "strong-b"}, "event_id", alternate="elsewhere")
    return rows.select("event_id", F.array_join("spent", ",").alias("spent"), "quota_served", "model")


@query(f"""
WITH {P}, s AS (SELECT id, regexp_matches(t, '{_PLAIN['us_ssn']}') AS held, greatest(1, length(t) // 4 + 1) AS tokens FROM p),
x AS (SELECT *, tokens <= 12 AND NOT held AS cheap, tokens <= 9 AS local FROM s)
SELECT id, concat_ws(',', CASE WHEN local THEN 'local' END, CASE WHEN cheap THEN 'cheap' END) AS surviving, NOT held AND NOT (local AND cheap) AS single,
  CASE WHEN held OR (local AND cheap) THEN NULL WHEN local OR NOT cheap THEN 'local' ELSE 'cheap' END AS tier FROM x
""")
def prefilter_override(spark, sf_dir):
    """Rows that the tier pre-filter decides: one tier left, or none, which falls back."""
    policy = Policy(prefilter={"deny_tiers": ("strong",), "tier_limits": {"local": {"max_tokens": 9}, "cheap": {"max_tokens": 12}}})
    held = detectors.fires(F.col("excerpt"), "us_ssn")
    rows = _prompts(spark, sf_dir).withColumnRenamed("text", "excerpt").withColumn("gate", F.expr(_CLEAN).withField("blocks_backend", held))
    rows = providers.with_prefilter(rows, policy)
    return rows.select("id", F.array_join("surviving", ",").alias("surviving"), "single", F.when(F.col("single"), providers.prefilter_outcome(policy)["tier"]).alias("tier"))


@query("SELECT * FROM (VALUES (0, 'local', 'local'), (1, 'cheap', 'strong'), (2, 'strong', 'strong'), (3, 'edge', 'edge')) t(rank, tier, bumped)")
def safety_ranking(spark, sf_dir):
    """Tiers from the safest on, and each one's next tier up."""
    names = providers.safety_ranking(Policy(), ("edge", "cheap"))
    rows = spark.createDataFrame(list(enumerate(names)), "rank int, tier string")
    return rows.withColumn("bumped", providers.bumped_tier(F.col("tier"), Policy()))


# ------------------------------------------------------------ labels that follow

_GATE_FLAGS = {"fired": "c_custkey % 3 = 0", "force_local": "c_custkey % 6 = 0", "blocks_backend": "c_custkey % 12 = 0"}
_CPX, _SENS = "[c_custkey % 4 + 1]", "[c_nationkey % 4 + 1]"


@query(f"""
WITH c AS (SELECT c_custkey AS id, {_LADDER(schema.COMPLEXITY)}{_CPX} AS cpx, {_LADDER(schema.SENSITIVITY)}{_SENS} AS sens, c_custkey % 5 = 0 AS pii, {", ".join(f"{v} AS {k}" for k, v in _GATE_FLAGS.items())} FROM customer)
SELECT id, CASE WHEN sens IN ('confidential', 'regulated') OR pii THEN 'local' WHEN cpx IN ('hard', 'frontier') THEN 'strong' ELSE 'cheap' END AS intended,
  CASE WHEN force_local OR blocks_backend THEN 'local' ELSE 'cheap' END AS gate_only, CASE WHEN fired THEN 'local' WHEN cpx IN ('hard', 'frontier') THEN 'strong' ELSE 'cheap' END AS keyless,
  CASE WHEN blocks_backend THEN 'blocks' WHEN fired THEN 'fires' ELSE 'none' END AS expectation, CASE WHEN id % 10 <> 0 THEN cpx END AS summary_tier, fired AS summary_fired,
  CASE WHEN id % 2 = 0 OR sens = 'regulated' THEN 'regulated' WHEN sens <> 'public' THEN sens WHEN id % 3 = 0 THEN 'internal' ELSE 'public' END AS floor,
  0.5 AS uniform_p, 'chat' AS uniform_choice FROM c
""")
def label_tiers(spark, sf_dir):
    """Tiers and floors that follow from labels and gate flags alone."""
    ladder = lambda levels, at: F.element_at(F.array(*[F.lit(x) for x in levels]), (F.expr(at) % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey")).withColumn("cpx", ladder(schema.COMPLEXITY, "c_custkey")).withColumn("sens", ladder(schema.SENSITIVITY, "c_nationkey"))
    gate = F.struct(*[F.expr(v).alias(k) for k, v in _GATE_FLAGS.items()])
    rows = rows.withColumn("gate", gate)
    summary = answers.decision_summary(F.when(F.col("id") % 10 == 0, "").otherwise(F.col("cpx")), F.lit("m"), F.col("gate"), F.lit(False))
    floor = answers.strictest_floor(F.when(F.col("id") % 2 == 0, "regulated"), F.col("sens"), F.when(F.col("id") % 3 == 0, "internal"))
    nothing = answers.uniform(("a", "chat"))
    return rows.select(
        "id", answers.intended_tier(F.col("cpx"), F.col("sens"), F.col("id") % 5 == 0).alias("intended"), answers.gate_only_tier(F.col("gate")).alias("gate_only"),
        answers.keyless_tier(F.col("gate"), F.col("cpx")).alias("keyless"), answers.gate_expectation(F.col("gate")).alias("expectation"), summary["tier"].alias("summary_tier"),
        summary["gate_fired"].alias("summary_fired"), floor.alias("floor"), nothing["probabilities"][0].alias("uniform_p"), nothing["choice"].alias("uniform_choice"),
    )


@query("SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) <> '' THEN 0.9 ELSE 0.1 END::DOUBLE AS completed_p FROM conversations WHERE role = 'assistant'")
def verified_responses(spark, sf_dir):
    """The keyless completion check of every assistant turn."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", answers.response_noul(F.col("text")).alias("completed_p"))


@query(f"""
WITH {P}, k AS (SELECT id, substr(sha256(substr(t, 1, 12) || chr(0) || 'kw_a,kw_b'), 1, 32) AS memo_key FROM p)
SELECT id, memo_key, row_number() OVER (PARTITION BY memo_key ORDER BY id) > 1 AS memo_hit FROM k
""")
def eval_memo(spark, sf_dir):
    """Rows that an evaluation scores once for all their equals."""
    from lanewise.operators.evaluation import memo

    rows = _prompts(spark, sf_dir).withColumn("head", F.substring("text", 1, 12))
    return memo(rows, F.col("head"), F.array(F.lit("kw_a"), F.lit("kw_b")), "id").select("id", "memo_key", "memo_hit")


@query("""
WITH RECURSIVE e AS (SELECT event_type AS key, event_id AS k, epoch(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
w AS (SELECT key, k, t, rn, false AS hit, t AS stored FROM e WHERE rn = 1
  UNION ALL SELECT e.key, e.k, e.t, e.rn, e.t - w.stored < 3600.0, CASE WHEN e.t - w.stored < 3600.0 THEN w.stored ELSE e.t END FROM w JOIN e ON e.key = w.key AND e.rn = w.rn + 1)
SELECT key, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM w GROUP BY key
""")
def ttl_cache_by_type(spark, sf_dir):
    """Hits of a cache whose entries live an hour from their store, against a walk in SQL."""
    from lanewise.operators.dedupe import cache_hits

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return cache_hits(e, "key", "k", 3600.0, "t").groupBy("key").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("""
WITH RECURSIVE e AS (SELECT event_type AS backend, event_id::DOUBLE AS t, value < 40 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
s AS (
  SELECT backend, rn, 'closed' AS met, CASE WHEN ok THEN 0 ELSE 1 END AS count, 'closed' AS mode, 0.0::DOUBLE AS since FROM e WHERE rn = 1
  UNION ALL
  SELECT e.backend, e.rn,
    CASE WHEN s.mode = 'open' AND e.t - s.since < 20 THEN 'rejected' WHEN s.mode = 'open' THEN 'half_open' ELSE s.mode END,
    CASE WHEN s.mode = 'open' AND e.t - s.since < 20 THEN s.count WHEN e.ok THEN 0 ELSE s.count + 1 END,
    CASE WHEN s.mode = 'open' AND e.t - s.since < 20 THEN 'open' WHEN e.ok THEN 'closed' WHEN s.mode = 'open' OR s.mode = 'half_open' OR s.count + 1 >= 3 THEN 'open' ELSE s.mode END,
    CASE WHEN s.mode = 'open' AND e.t - s.since < 20 THEN s.since WHEN NOT e.ok AND (s.mode = 'open' OR s.mode = 'half_open' OR s.count + 1 >= 3) THEN e.t ELSE s.since END
  FROM s JOIN e ON e.backend = s.backend AND e.rn = s.rn + 1)
SELECT backend, met AS state, count(*) AS n FROM s GROUP BY ALL
""")
def breaker_by_type(spark, sf_dir):
    """States in which calls meet a circuit breaker, against a walk in SQL."""
    from lanewise.streaming.jobs import breaker_states

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("backend"), F.col("event_id").cast("double").alias("ts"), (F.col("value") < 40).alias("ok"))
    return breaker_states(e, failures=3, recovery=20.0).groupBy("backend", "state").agg(F.count("*").alias("n"))


@query()
def lru_cache(spark, sf_dir):
    """Hits of a cache of 20 entries per worker that forgets what was used longest ago."""
    from lanewise.operators.caches import lru_hits

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("worker"), F.col("user_id").alias("item"), F.col("event_id").alias("k"))
    return lru_hits(e, "worker", "item", "k", entries=20).groupBy("worker").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if("evicts").alias("evictions"))


@query()
def request_cache_seam(spark, sf_dir):
    """Missed prompts that a yes-no question replays: the nearest earlier one of up to five, with suspicious replays counted."""
    from lanewise.operators.caches import semantic_replays

    rows = _prompts(spark, sf_dir).withColumn("norm", text.normalized(F.col("text")))
    stored, missed = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    found = semantic_replays(missed, stored, lambda similarity: F.when(similarity >= 0.5, 0.9).otherwise(0.4))
    return found.agg(F.count("*").alias("replayed"), F.count_if("suspicious").alias("suspicious"), F.round(F.avg("similarity"), 4).alias("similarity"))
