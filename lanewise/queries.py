"""Registered queries over the driver's tables, each beside its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions import decision, detectors, text
from lanewise.operators import analytics, dedupe, distill, similar
from lanewise.plans.policy import Policy
from lanewise.plans.route import decision_records, keyless, resolve, route, spread, trace_oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------ SQL fragments (DuckDB)

EX = r"substr(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', ''), 1, 4000)"
DOCS = f"docs AS (SELECT doc_id, lang AS doc_lang, source, {EX} AS t FROM documents)"


def _count(pattern: str, column: str = "t") -> str:
    return f"len(regexp_extract_all({column}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def _share(pattern: str, column: str = "t") -> str:
    return f"(length({column}) - length(regexp_replace({column}, '{pattern}', '', 'g')))"


def _ratio(a: str, b: str, places: int = 4) -> str:
    # half up on the exact quotient of two counts
    return f"coalesce((({a})::BIGINT * {2 * 10**places} + ({b})) // nullif(2 * ({b}), 0) / {10.0**places}, 0.0)"


def _stops(words) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(w, lambda x: x IN ({listed})))"


LANGUAGE = (
    "lng AS (SELECT *, list_position(c, list_max(c)) AS pos, list_max(c) AS best FROM (SELECT *, ["
    + ", ".join(_stops(w) for w in text.STOP_WORDS.values())
    + r"] AS c FROM (SELECT *, regexp_extract_all(lower(t), '[\p{L}]+') AS w FROM docs)))"
)
LANGUAGE_NAME = "CASE WHEN len(w) >= 4 AND best >= greatest(2, len(w) // 40) THEN [" + ", ".join(f"'{x}'" for x in text.STOP_WORDS) + "][pos] ELSE 'und' END"
FEATURES = {
    "char_len": "length(t)",
    "word_count": _count(r"\S+"),
    "line_count": r"CASE WHEN length(t) > 0 THEN " + _count("\n") + " + 1 ELSE 0 END",
    "sentence_count": r"len(list_filter(string_split_regex(t, '[.!?]+\s'), lambda s: trim(s, E' \n\t\r') <> ''))",
    "mean_word_len": _ratio(_share(r"\S"), _count(r"\S+"), 3),
    "digit_ratio": _ratio(_share(r"\p{Nd}"), "length(t)"),
    "upper_ratio": _ratio(_share(r"\p{Lu}"), "greatest(" + _share(r"\p{L}") + ", 1)"),
    "punct_ratio": _ratio(_share(r"[^\p{L}\p{N}\s]"), "length(t)"),
    "non_ascii_ratio": _ratio(_share(r"[^\x00-\x7F]"), "length(t)"),
    "code_blocks": _count(text.CODE_FENCE) + " // 2",
    "inline_code_spans": _count(text.INLINE_CODE),
    "urls": _count(r"(?i)\b[a-z][a-z0-9+.\-]*://[^\s<>\"']+"),
    "question_marks": _count(r"\?"),
    "exclamations": _count("!"),
    "has_stack_trace": "regexp_matches(t, '" + text.STACK_FRAME + "')",
    "has_diff": r"regexp_matches(t, '(?m)^(?:[+-]{3}\s|@@\s|[-+]$|[+][^+]|[+]\+[^+]|[-][^-]|[-]-[^-])')",
    "has_json": r"regexp_matches(t, '(?s)^\s*[\[{].*[\]}]\s*$')",
}


def _requests(spark, sf_dir) -> DataFrame:
    # what follows computes much per row: a small table, read in few splits, is dealt to all cores first
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return docs.select("doc_id", "lang", "source", text.excerpt_text(F.col("text")).alias("excerpt"))


# ------------------------------------------------------------ text


@query(f"WITH {DOCS} SELECT doc_id, length(t) AS n, sha256(t) AS digest FROM docs")
def excerpt_text(spark, sf_dir):
    return _requests(spark, sf_dir).select("doc_id", F.length("excerpt").alias("n"), F.sha2("excerpt", 256).alias("digest"))


@query(
    f"WITH {DOCS} SELECT doc_id, "
    + ", ".join(f"({sql})::{'DOUBLE' if name.endswith(('ratio', 'len')) and name != 'char_len' else 'BOOLEAN' if name.startswith('has') else 'INTEGER'} AS {name}" for name, sql in FEATURES.items())
    + " FROM docs"
)
def text_features(spark, sf_dir):
    return text.with_features(_requests(spark, sf_dir), "excerpt", "f").select("doc_id", *[F.col(f"f.{c}") for c in FEATURES])


@query(f"WITH {DOCS}, {LANGUAGE} SELECT doc_id, {LANGUAGE_NAME} AS lang FROM lng")
def language_guess(spark, sf_dir):
    return text.with_language(_requests(spark, sf_dir).select("doc_id", "excerpt"), "excerpt", "lang").select("doc_id", "lang")


@query("""
WITH m AS (
  SELECT conv_id, turn, role, regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '') AS t FROM conversations WHERE role IN ('user', 'assistant')
), k AS (
  SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS users FROM m WHERE t <> ''
), b AS (
  SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM k WHERE users <= 3
), p AS (SELECT conv_id, turn, substr(t, 1, (4000 - used)::INT) AS piece FROM b WHERE used < 4000),
e AS (SELECT conv_id, substr(string_agg(piece, E'\\n\\n' ORDER BY turn), 1, 4000) AS excerpt FROM p GROUP BY conv_id)
SELECT c.conv_id, substr(sha256('salt' || chr(0) || coalesce(excerpt, '')), 1, 16) AS excerpt_hash, length(coalesce(excerpt, '')) AS n
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e USING (conv_id)
""")
def excerpt_messages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    said = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    ex = said.withColumn("excerpt", text.excerpt_messages(F.col("messages")))
    return ex.select("conv_id", text.hash_text(F.col("excerpt"), "salt").alias("excerpt_hash"), F.length("excerpt").alias("n"))


@query(f"WITH {DOCS} SELECT substr(sha256(chr(0) || t), 1, 16) AS excerpt_hash, count(*) AS n FROM docs GROUP BY 1")
def excerpt_hash(spark, sf_dir):
    return _requests(spark, sf_dir).groupBy(text.hash_text(F.col("excerpt")).alias("excerpt_hash")).agg(F.count("*").alias("n"))


TOKENS = r"list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2 OR regexp_matches(x, '^\p{Nd}$'))"


@query(f"""
WITH {DOCS}, w AS (SELECT doc_id, {TOKENS} AS w FROM docs),
b AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS token FROM w)
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM b GROUP BY token HAVING count(*) >= 5
""")
def token_bigrams(spark, sf_dir):
    rows = _requests(spark, sf_dir).select("doc_id", F.explode(text.tokens(F.col("excerpt"))).alias("token")).where(F.col("token").contains("_"))
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("n >= 5")


@query(f"""
WITH {DOCS}, w AS (SELECT doc_id, unnest(list_distinct({TOKENS})) AS token FROM docs),
d AS (SELECT token, count(*) AS df FROM w GROUP BY token HAVING count(*) >= 2)
SELECT token, df, row_number() OVER (ORDER BY df DESC, token) - 1 AS col FROM d ORDER BY df DESC, token LIMIT 200
""")
def document_frequency_topk(spark, sf_dir):
    vocab = distill.document_frequency(_requests(spark, sf_dir), text.tokens(F.col("excerpt"), bigrams=False), most=200)
    return vocab.select("token", "df", F.col("col").cast("long").alias("col"))


@query(f"""
WITH {DOCS}, w AS (SELECT doc_id, unnest({TOKENS}) AS token FROM docs),
d AS (SELECT token, count(DISTINCT doc_id) AS df FROM w GROUP BY token HAVING count(DISTINCT doc_id) >= 2 ORDER BY df DESC, token LIMIT 100),
n AS (SELECT count(*) AS n FROM docs),
x AS (SELECT doc_id, w.token, (1 + ln(count(*))) * any_value(ln((1.0 + n) / (1.0 + df)) + 1) AS v FROM w JOIN d USING (token), n GROUP BY doc_id, w.token)
SELECT doc_id, token, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM x
""")
def tfidf_weights(spark, sf_dir):
    """Weights of the 100 words that the SQL is made for; ``tfidf_weights_whole`` has the vectorizer's own settings."""
    return _tfidf_weights(_requests(spark, sf_dir), text.tokens(F.col("excerpt"), bigrams=False), 100)


@query()
def tfidf_weights_whole(spark, sf_dir):
    """Weights of words and bigrams with the vectorizer's own vocabulary size."""
    return _tfidf_weights(_requests(spark, sf_dir), text.tokens(F.col("excerpt")), distill.MAX_VOCAB)


def _tfidf_weights(requests: DataFrame, tokens: Column, most: int) -> DataFrame:
    docs = requests.withColumnRenamed("doc_id", "id")
    vocab = distill.idf(distill.document_frequency(docs, tokens, most=most), docs.count())
    rows = distill.tfidf(docs, vocab, tokens).join(F.broadcast(vocab.select("col", "token")), "col")
    return rows.select(F.col("id").alias("doc_id"), "token", F.round("value", 6).alias("value"))


# ------------------------------------------------------------ the gate

#: Prompts with synthetic identifiers, one kind per customer.
PROMPTS = (
    "concat('My SSN is ', lpad(cast(c_custkey % 900 + 100 as string), 3, '0'), '-', lpad(cast(c_custkey % 90 + 10 as string), 2, '0'), '-', lpad(cast(c_custkey % 9000 + 1000 as string), 4, '0'))",
    "concat('Write to user', cast(c_custkey as string), '@mail', cast(c_custkey % 7 as string), '.lanewise.dev today')",
    "concat('Ask sales', cast(c_custkey as string), '@example.com about it')",
    "concat('patient id: MRN', cast(c_custkey as string), ' shows a diagnosis')",
    "concat('export API_KEY=abc', cast(c_custkey as string), 'defgh now')",
    "concat('IBAN GB82 WEST 1234 5698 7654 ', lpad(cast(cast(floor(c_custkey / 10) as int) % 40 as string), 2, '0'), ' please')",
    "concat('Code AB', lpad(cast(c_custkey as string), 6, '0'), 'C and GB', lpad(cast(c_custkey as string), 6, '0'), 'A')",
    "concat('Explain how HIPAA works for customer ', cast(c_custkey as string))",
    "concat('NHS 943 476 ', lpad(cast(5900 + c_custkey % 100 as string), 4, '0'), ' or dob: 12/03/', cast(1950 + c_custkey % 50 as string))",
    "concat('Plan the ', c_mktsegment, ' launch, version ', cast(c_custkey as string), '?')",
)


def _prompt_sql(dialect: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(PROMPTS))
    sql = f"CASE c_custkey % {len(PROMPTS)} {cases} END"
    return sql if dialect == "spark" else sql.replace("as string", "AS VARCHAR")


P = f"p AS (SELECT c_custkey AS id, {_prompt_sql('duckdb')} AS t FROM customer)"


def _prompts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_prompt_sql("spark")).alias("text"))


def _detector_oracle(names, column="t") -> str:
    plain = {"us_ssn": r"\b\d{3}-\d{2}-\d{4}\b"}
    return ", ".join(
        f"len(list_distinct(regexp_extract_all({column}, '{'' if detectors.BY_NAME[n].cased else '(?i)'}{plain.get(n, detectors.BY_NAME[n].pattern).replace(chr(39), chr(39) * 2)}')))::INTEGER AS {n}" for n in names
    )


SIMPLE = ("us_ssn", "private_key_block", "provider_api_key", "inline_credential", "basic_auth_url", "medical_record_number", "date_of_birth", "street_address", "named_individual")
TOPICS = tuple(x.name for x in detectors.DETECTORS if x.advisory)


@query(f"WITH {P} SELECT id, {_detector_oracle(SIMPLE)} FROM p")
def detect_identifiers(spark, sf_dir):
    return _prompts(spark, sf_dir).select("id", *[F.size(detectors.matches(F.col("text"), n)).alias(n) for n in SIMPLE])


@query(f"WITH {DOCS} SELECT doc_id, {_detector_oracle(SIMPLE)} FROM docs")
def detect_identifiers_documents(spark, sf_dir):
    return _requests(spark, sf_dir).select("doc_id", *[F.size(detectors.matches(F.col("excerpt"), n)).alias(n) for n in SIMPLE])


@query()
def detect_identifiers_whole(spark, sf_dir):
    """Identifiers anywhere in a document; ``detect_identifiers_documents`` reads the router's excerpt, as its SQL does."""
    return table(spark, sf_dir, "documents").select("doc_id", *[F.size(detectors.matches(F.coalesce("text", F.lit("")), n)).alias(n) for n in SIMPLE])


@query(f"WITH {P} SELECT id, {_detector_oracle(TOPICS)} FROM p UNION ALL SELECT -1 - doc_id, {_detector_oracle(TOPICS)} FROM (SELECT doc_id, {EX} AS t FROM documents)")
def detect_advisory_topics(spark, sf_dir):
    both = _prompts(spark, sf_dir).unionByName(_requests(spark, sf_dir).select((-1 - F.col("doc_id")).alias("id"), F.col("excerpt").alias("text")))
    return both.select("id", *[F.size(detectors.matches(F.col("text"), n)).alias(n) for n in TOPICS])


@query()
def detect_advisory_topics_whole(spark, sf_dir):
    """Topics anywhere in a prompt or document; ``detect_advisory_topics`` reads the router's excerpt, as its SQL does."""
    docs = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return _prompts(spark, sf_dir).unionByName(docs).select("id", *[F.size(detectors.matches(F.col("text"), n)).alias(n) for n in TOPICS])


_DOMAIN = "regexp_replace(lower(string_split(m, '@')[-1]), '^[.]+|[.]+$', '', 'g')"
_PLACEHOLDER = " OR ".join(f"{_DOMAIN} = '{x}' OR suffix({_DOMAIN}, '.{x}')" for x in detectors.PLACEHOLDER_DOMAINS)


@query(f"""
WITH {P}, u AS (SELECT id, t FROM p UNION ALL SELECT -1 - doc_id, text FROM documents),
e AS (SELECT id, unnest(list_distinct(regexp_extract_all(t, '(?i){detectors.BY_NAME["email_address"].pattern}'))) AS m FROM u)
SELECT id, count(*) AS addresses, count(*) FILTER (WHERE NOT ({_PLACEHOLDER})) AS real_addresses FROM e GROUP BY id
""")
def detect_email_real(spark, sf_dir):
    both = _prompts(spark, sf_dir).unionByName(table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("id"), "text"))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(detectors.BY_NAME["email_address"].java), F.lit(0)))
    rows = both.select("id", F.explode(found).alias("m"))
    return rows.groupBy("id").agg(F.count("*").alias("addresses"), F.count_if(detectors.real_email(F.col("m"))).alias("real_addresses"))


_DIGITS = "list_reverse(list_transform(string_split(d, ''), lambda c: c::INT))"


@query(f"""
WITH o AS (SELECT o_orderkey AS id, lpad((4000000000000000 + o_orderkey * 7919 + o_custkey)::VARCHAR, 16, '0') AS d FROM orders),
x AS (SELECT id, d, {_DIGITS} AS r FROM o)
SELECT id, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN r[i] WHEN r[i] * 2 > 9 THEN r[i] * 2 - 9 ELSE r[i] * 2 END)) % 10 = 0 AS is_card FROM x
""")
def detect_card_luhn(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("card "), F.lpad((F.lit(4000000000000000) + F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 16, "0"), F.lit(" ok")).alias("text")
    )
    return rows.select("id", detectors.fires(F.col("text"), "payment_card").alias("is_card"))


@query(f"""
WITH {P}, i AS (SELECT id, unnest(list_distinct(regexp_extract_all(t, '{detectors.BY_NAME["iban"].pattern}'))) AS m FROM p),
f AS (SELECT id, upper(replace(m, ' ', '')) AS c FROM i),
n AS (SELECT id, c, (list_aggregate(list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''),
  lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE (ascii(x) - 55)::VARCHAR END), 'string_agg', ''))::HUGEINT % 97 AS r FROM f)
SELECT id, count(*) AS candidates, count(*) FILTER (WHERE r = 1 AND regexp_full_match(c, '[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{11,30}}')) AS valid FROM n GROUP BY id
""")
def detect_iban_mod97(spark, sf_dir):
    rows = _prompts(spark, sf_dir).select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(detectors.BY_NAME["iban"].java), F.lit(0)))).alias("m"))
    return rows.groupBy("id").agg(F.count("*").alias("candidates"), F.count_if(detectors.iban_ok(F.col("m"))).alias("valid"))


@query(f"""
WITH {P}, i AS (SELECT id, unnest(list_distinct(regexp_extract_all(t, '{detectors.BY_NAME["uk_national_insurance"].pattern}'))) AS m FROM p)
SELECT id, m, NOT (upper(m)[1:2] IN ('GB', 'NK', 'TN', 'ZZ')) AS valid FROM i
""")
def detect_nino(spark, sf_dir):
    rows = _prompts(spark, sf_dir).select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(detectors.BY_NAME["uk_national_insurance"].java), F.lit(0)))).alias("m"))
    return rows.select("id", "m", detectors.nino_ok(F.col("m")).alias("valid"))


@query(f"""
WITH {P}, i AS (SELECT id, unnest(list_distinct(regexp_extract_all(t, '\\b\\d{{3}}\\s?\\d{{3}}\\s?\\d{{4}}\\b'))) AS m FROM p),
d AS (SELECT id, m, list_transform(string_split(regexp_replace(m, '\\D', '', 'g'), ''), lambda c: c::INT) AS g FROM i),
c AS (SELECT *, 11 - list_sum(list_transform(range(1, 10), lambda k: g[k] * (11 - k))) % 11 AS chk FROM d)
SELECT id, m, chk <> 10 AND g[10] = CASE WHEN chk = 11 THEN 0 ELSE chk END AS valid FROM c
""")
def detect_nhs(spark, sf_dir):
    rows = _prompts(spark, sf_dir).select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(detectors.BY_NAME["uk_nhs_number"].java), F.lit(0)))).alias("m"))
    return rows.select("id", "m", detectors.nhs_ok(F.col("m")).alias("valid"))


@query()
def gate_verdicts(spark, sf_dir):
    """The exact gate (decoded variants, suppression, span hashes) over prompts and documents."""
    both = _prompts(spark, sf_dir).unionByName(table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("id"), "text"))
    rows = both.withColumn("g", detectors.gate(text.excerpt_text(F.col("text"))))
    return rows.select("id", decision.gate_label(F.col("g")).alias("label"), F.col("g.sensitivity_floor").alias("floor"), F.col("g.pii_floor").alias("pii_floor"))


@query()
def redacted_text(spark, sf_dir):
    rows = _prompts(spark, sf_dir).withColumn("r", detectors.redact(F.col("text")))
    return rows.select("id", F.col("r.text").alias("text"), F.col("r.n").alias("n"))


@query(f"""
WITH {P}, s AS (SELECT id, t, regexp_matches(t, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b') AS blocks, greatest(1, length(t) // 4 + 1) AS tokens FROM p),
x AS (SELECT id, unnest(['local', 'cheap', 'strong']) AS tier, blocks, tokens FROM s)
SELECT id, tier, CASE WHEN tier = 'strong' THEN 'quota exhausted' WHEN blocks AND tier <> 'local' THEN 'sensitivity floor (gate blocks cloud)'
  WHEN tier = 'local' AND tokens > 8 THEN 'context window < ~' || tokens || ' tokens' END AS reason FROM x
""")
def prefilter_tiers(spark, sf_dir):
    policy = Policy(prefilter={"quota_exhausted": ("strong",), "tier_limits": {"local": {"max_tokens": 8}}})
    rows = _prompts(spark, sf_dir)
    tiers = policy.surviving_tiers(F.col("text"), detectors.fires(F.col("text"), "us_ssn"))
    return rows.select("id", F.explode(tiers).alias("x")).select("id", "x.tier", "x.reason")


# ------------------------------------------------------------ the keyless scorer and the policy


def _ascii(column: str) -> str:
    """Accented letters as plain ones: RE2 finds a word boundary beside them, Java does not."""
    return rf"regexp_replace({column}, '[\x{{00C0}}-\x{{00D6}}\x{{00D8}}-\x{{00F6}}\x{{00F8}}-\x{{024F}}]', 'x', 'g')"


def _markers(column: str, markers) -> str:
    column = _ascii(column)
    return " + ".join(f"CASE WHEN regexp_matches({column}, '(?i){p}') THEN {float(w)} ELSE 0.0 END" for p, w in markers)


def _softmax(scores: str) -> str:
    top = f"list_max({scores})"
    e = f"list_transform({scores}, lambda x: exp(x / 0.55 - {top} / 0.55))"
    return f"list_transform({e}, lambda x: round(x / list_sum({e}), 6))"


_DOMAIN_EXTRA = {
    "code": "CASE WHEN code_blocks > 0 OR inline_code_spans > 0 THEN 1.2 ELSE 0.0 END + CASE WHEN has_stack_trace THEN 0.8 ELSE 0.0 END",
    "data-extraction": "CASE WHEN has_json OR urls > 0 THEN 0.8 ELSE 0.0 END",
    "chat": "CASE WHEN char_len < 60 AND question_marks = 0 THEN 0.9 ELSE 0.0 END",
}
_DOMAIN_SCORES = ", ".join(
    "0.35::DOUBLE + "
    + _DOMAIN_EXTRA.get(name, "0.0")
    + "".join(f" + CASE WHEN regexp_matches({_ascii('t')}, '(?i){p}') THEN {float(w)} ELSE 0.0 END" for p, m, w in decision.DOMAIN_MARKERS if m == name)
    for name in schema.DOMAINS
)
_LADDER = lambda levels: "[" + ", ".join(f"'{x}'" for x in levels) + "]"
SCORED = f"""
{DOCS}, feat AS (SELECT doc_id, t, source, doc_lang, {", ".join(f"{v} AS {k}" for k, v in FEATURES.items())},
  (('0x' || substr(sha256(t), 1, 8))::BIGINT::DOUBLE / 4294967295.0 - 0.5) * 0.6 AS nudge FROM docs),
sc AS (SELECT *, {_markers("lower(t)", decision.COMPLEXITY_MARKERS)} + least(2.0, ln(1 + char_len::DOUBLE) / 4.0) + 0.8 * least(code_blocks, 3)
  + CASE WHEN has_stack_trace THEN 0.6 ELSE 0.0 END + CASE WHEN has_diff THEN 0.4 ELSE 0.0 END + 0.3 * least(question_marks, 4)
  - CASE WHEN char_len < 40 THEN 1.2 ELSE 0.0 END + nudge AS cs,
  {_markers("lower(t)", decision.SENSITIVITY_MARKERS + decision.ABOUT_MARKERS)} + nudge * 0.5 AS ss FROM feat),
bands AS (SELECT *, [-cs * 1.1, 1.0 - abs(cs - 1.0) * 0.75, cs - 1.4, cs - 3.1]::DOUBLE[] AS cb,
  [-ss + 0.9, 1.1 - abs(ss - 1.1) * 0.7, ss - 1.2, ss - 2.6]::DOUBLE[] AS sb, [{_DOMAIN_SCORES}]::DOUBLE[] AS db FROM sc),
probs AS (SELECT *, {_softmax("cb")} AS cp, {_softmax("sb")} AS sp, {_softmax("db")} AS dp FROM bands),
scored AS (SELECT doc_id, t, source, doc_lang, cp, sp, dp, char_len,
  {_LADDER(schema.COMPLEXITY)}[list_position(cp, list_max(cp))] AS complexity, {_LADDER(schema.SENSITIVITY)}[list_position(sp, list_max(sp))] AS sensitivity,
  {_LADDER(schema.DOMAINS)}[list_position(dp, list_max(dp))] AS domain,
  round(list_reverse_sort(cp)[1] - list_reverse_sort(cp)[2], 6) AS c_conf, round(list_reverse_sort(sp)[1] - list_reverse_sort(sp)[2], 6) AS s_conf,
  round(greatest(0.01, least(0.99, (sp[3] + sp[4]) * 0.9)), 6) AS pii FROM probs)"""


def _scored(spark, sf_dir) -> DataFrame:
    """Documents scored by the keyless scorer, without the gate."""
    docs = text.with_features(_requests(spark, sf_dir).withColumn("redacted", F.col("excerpt")), "redacted")
    return decision.with_answers(docs, "redacted", "features")


@query(f"WITH {SCORED} SELECT doc_id, complexity, c_conf AS confidence, cp[1] AS p_trivial, cp[4] AS p_frontier FROM scored")
def mock_complexity(spark, sf_dir):
    p = F.col("complexity_p")
    return _scored(spark, sf_dir).select("doc_id", "complexity", F.col("complexity_confidence").alias("confidence"), p[0].alias("p_trivial"), p[3].alias("p_frontier"))


@query(f"WITH {SCORED} SELECT doc_id, sensitivity, s_conf AS confidence, round(pii, 3) AS pii FROM scored")
def mock_sensitivity(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "sensitivity", F.col("sensitivity_confidence").alias("confidence"), F.round("pii", 3).alias("pii"))


@query(f"WITH {SCORED} SELECT domain, doc_lang AS lang, count(*) AS n FROM scored GROUP BY ALL")
def mock_domain(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("domain", "lang").agg(F.count("*").alias("n"))


@query(
    f"WITH {SCORED} SELECT doc_id, round(greatest(0, least(1, 1 - list_sum(list_transform(list_filter(cp, lambda x: x > 0), lambda x: -x * ln(x))) / ln(4.0))), 4) AS complexity_certainty, "
    "round(greatest(0, least(1, 1 - list_sum(list_transform(list_filter(dp, lambda x: x > 0), lambda x: -x * ln(x))) / ln(5.0))), 4) AS domain_certainty FROM scored"
)
def certainty(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return rows.select("doc_id", *[F.round(decision.certainty(F.col(f"{h}_p")), 4).alias(f"{h}_certainty") for h in ("complexity", "domain")])


_IDX = lambda col, levels: f"list_position({_LADDER(levels)}, {col})"
ROUTED = f"""{SCORED}, esc AS (SELECT *,
  CASE WHEN c_conf < 0.7 THEN least({_IDX("complexity", schema.COMPLEXITY)} + 1, 4) ELSE {_IDX("complexity", schema.COMPLEXITY)} END AS ci,
  CASE WHEN s_conf < 0.25 THEN 4 WHEN s_conf < 0.8 THEN least({_IDX("sensitivity", schema.SENSITIVITY)} + 1, 4) ELSE {_IDX("sensitivity", schema.SENSITIVITY)} END AS si FROM scored),
routed AS (SELECT *, {_LADDER(schema.COMPLEXITY)}[ci] AS eff_complexity, {_LADDER(schema.SENSITIVITY)}[si] AS eff_sensitivity, pii >= 0.35 AS pii_present,
  CASE WHEN si >= 3 OR pii >= 0.35 THEN 'data.sensitive' WHEN ci = 4 THEN 'complexity.frontier' WHEN ci = 3 THEN 'complexity.hard' ELSE 'default' END AS rule_id,
  CASE WHEN si >= 3 OR pii >= 0.35 THEN 'local' WHEN ci >= 3 THEN 'strong' ELSE 'cheap' END AS tier FROM esc)"""

_CLEAN = (
    "named_struct('fired', false, 'findings', cast(array() as array<" + schema.FINDING + ">), 'sensitivity_floor', cast(null as string), "
    "'pii_floor', cast(null as double), 'force_local', false, 'blocks_backend', false, 'advisory_topics', cast(array() as array<string>))"
)


def _routed(spark, sf_dir, policy: Policy = Policy()) -> DataFrame:
    return resolve(_scored(spark, sf_dir).withColumn("gate", F.expr(_CLEAN)), policy)


@query(f"WITH {ROUTED} SELECT doc_id, eff_complexity AS complexity, eff_sensitivity AS sensitivity, pii_present FROM routed")
def merge_escalate(spark, sf_dir):
    return _routed(spark, sf_dir).select("doc_id", "complexity", "sensitivity", "pii_present")


@query(f"WITH {ROUTED} SELECT doc_id, rule_id, tier FROM routed")
def policy_route(spark, sf_dir):
    return _routed(spark, sf_dir).select("doc_id", "rule_id", "tier")


@query()
def route_documents(spark, sf_dir):
    """The whole plan with the exact gate, redaction included."""
    docs = table(spark, sf_dir, "documents").withColumn("request_id", F.col("doc_id").cast("string"))
    return route(docs).select("doc_id", "tier", "rule_id", "complexity", "sensitivity", "pii_present")


@query(f"WITH {ROUTED} SELECT tier, rule_id, count(*) AS n FROM routed GROUP BY ALL")
def tier_distribution(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("tier", "rule_id").agg(F.count("*").alias("n"))


@query(f"WITH {ROUTED} SELECT tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM routed GROUP BY tier")
def routing_share(spark, sf_dir):
    counts = _routed(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"WITH {ROUTED} SELECT doc_id, CASE WHEN c_conf < 0.5 THEN 'local' ELSE tier END AS tier, c_conf < 0.5 AS uncertain FROM routed")
def uncertain_fallback(spark, sf_dir):
    policy = Policy(min_confidence=0.5, uncertain_fallback="cheapest_local")
    return _routed(spark, sf_dir, policy).select("doc_id", "tier", "uncertain")


@query(f"WITH {P}, g AS (SELECT id, regexp_matches(t, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b') AS ssn FROM p) SELECT id, CASE WHEN ssn THEN 'local' ELSE 'strong' END AS tier FROM g")
def failure_tiers(spark, sf_dir):
    from lanewise.plans.policy import Failure

    rows = _prompts(spark, sf_dir).withColumn("hit", detectors.fires(F.col("text"), "us_ssn"))
    floor = F.when(F.col("hit"), "regulated")
    return rows.select("id", Policy(failure=Failure(mode="fail_open")).failure_tier(floor, F.col("hit")).alias("tier"))


@query(f"WITH {ROUTED}, r AS (SELECT doc_id, tier, row_number() OVER (PARTITION BY tier ORDER BY doc_id) - 1 AS k FROM routed) SELECT doc_id, tier || '-' || (k % 3) AS model FROM r")
def round_robin_model(spark, sf_dir):
    policy = Policy(tiers={t: tuple(f"{t}-{i}" for i in range(3)) for t in schema.TIERS})
    rows = _routed(spark, sf_dir, policy).select("doc_id", "tier")
    place = F.row_number().over(Window.partitionBy("tier").orderBy("doc_id")) - 1
    return rows.select("doc_id", policy.round_robin(F.col("tier"), place).alias("model"))


# ------------------------------------------------------------ logs, latency, cost


@query(f"""
WITH {ROUTED}, x AS (SELECT unnest(['tier', 'rule_id', 'complexity', 'sensitivity', 'domain']) AS dim, unnest([tier, rule_id, eff_complexity, eff_sensitivity, domain]) AS value FROM routed)
SELECT dim, value, count(*) AS n FROM x GROUP BY ALL
""")
def log_stats(spark, sf_dir):
    return analytics.dimension_counts(_routed(spark, sf_dir), ["tier", "rule_id", "complexity", "sensitivity", "domain"])


@query("""
WITH s AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events), q AS (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS q)
SELECT q, min(value) AS value FROM s, q WHERE r > least(floor(q * n), n - 1) GROUP BY q
""")
def latency_nearest_rank(spark, sf_dir):
    return analytics.nearest_rank_of(table(spark, sf_dir, "events"), "value", (0.5, 0.95, 0.99))


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY event_type
""")
def latency_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.percentile("value", [0.5, 0.95, 0.99]).alias("p"))
    return rows.select("event_type", "n", F.round("mean", 6).alias("mean"), *[F.round(F.col("p")[i], 6).alias(name) for i, name in enumerate(("p50", "p95", "p99"))])


COSTS = f"""{ROUTED}, cost AS (SELECT *, greatest(1, length(t) // 4) AS tok,
  (greatest(1, length(t) // 4) + 400) / 1000.0 * CASE tier WHEN 'local' THEN 0.0 WHEN 'cheap' THEN 0.0003 ELSE 0.003 END AS ours,
  (greatest(1, length(t) // 4) + 400) / 1000.0 * 0.015 AS base FROM routed)"""


@query(f"WITH {COSTS} SELECT tier, count(*) AS n, sum(tok)::BIGINT AS input_tokens, round(sum(ours), 6) AS cost_ours, round(sum(base), 6) AS cost_baseline FROM cost GROUP BY tier")
def backtest_cost(spark, sf_dir):
    rows = analytics.backtest_rows(_routed(spark, sf_dir), "excerpt")
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.round(F.sum("cost_ours"), 6).alias("cost_ours"), F.round(F.sum("cost_baseline"), 6).alias("cost_baseline"))


@query(f"WITH {COSTS} SELECT source AS category, count(*) AS n, round(sum(ours), 6) AS cost_ours, round(100 * (1 - sum(ours) / sum(base)), 4) AS savings_pct FROM cost GROUP BY ROLLUP (source)")
def backtest_by_category_rollup(spark, sf_dir):
    rows = analytics.cost_rollup(analytics.backtest_rows(_routed(spark, sf_dir), "excerpt").withColumnRenamed("source", "category"))
    return rows.select("category", "n", F.round("cost_ours", 6).alias("cost_ours"), F.round("savings_pct", 4).alias("savings_pct"))


@query(f"WITH {COSTS} SELECT tier, round(avg(CASE tier WHEN 'local' THEN 0.85 WHEN 'cheap' THEN 0.92 ELSE 0.97 END), 6) AS mean_completion, count(*) AS n FROM cost GROUP BY tier")
def completion_by_tier(spark, sf_dir):
    rows = analytics.backtest_rows(_routed(spark, sf_dir), "excerpt")
    return rows.groupBy("tier").agg(F.round(F.avg("completed_p"), 6).alias("mean_completion"), F.count("*").alias("n"))


#: Gold tier of a document, a fixed function of its id.
GOLD = "CASE doc_id % 5 WHEN 0 THEN 'local' WHEN 1 THEN 'strong' WHEN 2 THEN 'strong' ELSE 'cheap' END"
_KIND = (
    "CASE WHEN gold = tier THEN 'correct' WHEN gold = 'local' THEN 'unsafe' WHEN tier = 'local' THEN 'expensive' "
    "WHEN list_position(['local', 'cheap', 'strong'], tier) > list_position(['local', 'cheap', 'strong'], gold) THEN 'overspend' ELSE 'underpowered' END"
)


def _judged(spark, sf_dir) -> DataFrame:
    return _routed(spark, sf_dir).withColumn("expected_tier", F.expr(GOLD)).withColumn("chars", F.length("excerpt"))


@query(f"""
WITH {ROUTED}, g AS (SELECT *, {GOLD} AS gold FROM routed), s AS (
  SELECT 'always_strong' AS strategy, gold, char_len, 'strong' AS tier FROM g UNION ALL SELECT 'always_cheap', gold, char_len, 'cheap' FROM g UNION ALL SELECT 'routed', gold, char_len, tier FROM g),
c AS (SELECT *, char_len / 4.0 AS tok, CASE tier WHEN 'local' THEN 0.0 WHEN 'cheap' THEN 0.15 ELSE 1.6 END AS pi, CASE tier WHEN 'local' THEN 0.0 WHEN 'cheap' THEN 1.5 ELSE 6.4 END AS po, {_KIND} AS kind FROM s),
a AS (SELECT strategy, count(*) AS n, round(sum(tok * pi + 256 * po) / 1e6, 8) AS total_cost, count(*) FILTER (WHERE pi + po > 0) AS cloud_calls,
  round(avg((kind = 'correct')::INT), 6) AS tier_accuracy, count(*) FILTER (WHERE kind = 'unsafe') AS unsafe_errors, sum(tok * pi + 256 * po) AS raw FROM c GROUP BY strategy)
SELECT strategy, n, total_cost, cloud_calls, tier_accuracy, unsafe_errors, round(raw / max(CASE WHEN strategy = 'always_strong' THEN raw END) OVER (), 6) AS ratio FROM a
""")
def strategy_costs(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    costs = analytics.strategy_costs(rows, {"always_strong": F.lit("strong"), "always_cheap": F.lit("cheap"), "routed": F.col("tier")})
    out = analytics.against_baseline(costs, "always_strong")
    return out.select("strategy", "n", F.round("total_cost", 8).alias("total_cost"), "cloud_calls", F.round("tier_accuracy", 6).alias("tier_accuracy"), "unsafe_errors", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {ROUTED}, g AS (SELECT *, {GOLD} AS gold FROM routed), k AS (SELECT gold, {_KIND} AS kind FROM g) SELECT gold AS expected_tier, kind, count(*) AS n FROM k GROUP BY GROUPING SETS ((gold, kind), (kind))")
def error_kinds(spark, sf_dir):
    rows = _judged(spark, sf_dir).withColumn("kind", decision.classify_error(F.col("expected_tier"), F.col("tier")))
    return rows.groupingSets([["expected_tier", "kind"], ["kind"]], "expected_tier", "kind").agg(F.count("*").alias("n"))


@query(f"""
WITH {ROUTED}, g AS (SELECT *, {GOLD} AS gold FROM routed), k AS (SELECT gold = tier AS a, gold = 'cheap' AS b FROM g)
SELECT count(*) AS n, count(*) FILTER (WHERE a AND b) AS both_right, count(*) FILTER (WHERE NOT a AND NOT b) AS both_wrong, count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE b AND NOT a) AS b_only FROM k
""")
def negative_control(spark, sf_dir):
    rows = _judged(spark, sf_dir).withColumnRenamed("doc_id", "id").select("id", "expected_tier", "tier")
    return analytics.paired_outcomes(rows, rows.withColumn("tier", F.lit("cheap")))


# ------------------------------------------------------------ quality and calibration

#: Labelled documents: gold complexity from the quality label, gold pii from the toxic label.
LABELLED = f"""{SCORED}, lab AS (SELECT s.*, CASE WHEN quality = 1 THEN 'hard' ELSE 'standard' END AS gold, toxic = 1 AS gold_pii FROM scored s JOIN labels USING (doc_id))"""


def _labelled(spark, sf_dir) -> DataFrame:
    gold = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "hard").otherwise("standard").alias("gold"), (F.col("toxic") == 1).alias("gold_pii"))
    return _scored(spark, sf_dir).join(gold, "doc_id")


@query(
    f"WITH {LABELLED}, l AS (SELECT unnest({_LADDER(schema.COMPLEXITY)}) AS gold) SELECT l.gold, "
    + ", ".join(f"count(*) FILTER (WHERE complexity = '{c}') AS pred_{c}" for c in schema.COMPLEXITY)
    + " FROM l LEFT JOIN lab USING (gold) GROUP BY l.gold"
)
def confusion_matrix(spark, sf_dir):
    return analytics.confusion(_labelled(spark, sf_dir).select("gold", F.col("complexity").alias("pred")), schema.COMPLEXITY)


@query(f"""
WITH {LABELLED}, l AS (SELECT unnest({_LADDER(schema.COMPLEXITY)}) AS label), c AS (
  SELECT label, count(*) FILTER (WHERE gold = label AND complexity = label) AS tp, count(*) FILTER (WHERE gold <> label AND complexity = label) AS fp, count(*) FILTER (WHERE gold = label AND complexity <> label) AS fn FROM l, lab GROUP BY label),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM c)
SELECT label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r
""")
def per_class_f1(spark, sf_dir):
    rows = analytics.per_class(_labelled(spark, sf_dir).select("gold", F.col("complexity").alias("pred")), schema.COMPLEXITY)
    return rows.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""
WITH {LABELLED}, c AS (SELECT count(*) FILTER (WHERE gold_pii AND pii >= 0.5) AS tp, count(*) FILTER (WHERE NOT gold_pii AND pii < 0.5) AS tn,
  count(*) FILTER (WHERE NOT gold_pii AND pii >= 0.5) AS fp, count(*) FILTER (WHERE gold_pii AND pii < 0.5) AS fn FROM lab)
SELECT tp, tn, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy FROM c
""")
def binary_pii_metrics(spark, sf_dir):
    rows = analytics.binary(_labelled(spark, sf_dir), F.col("gold_pii"), F.col("pii") >= 0.5)
    return rows.select("tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")])


_BIN = "least(floor(c_conf * 15), 14)::INTEGER"


@query(f"""
WITH {LABELLED}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(c_conf) AS mc, avg((complexity = gold)::INT) AS acc FROM lab GROUP BY 1)
SELECT round(sum(n / (SELECT count(*) FROM lab)::DOUBLE * abs(mc - acc)), 6) AS ece, round(max(abs(mc - acc)), 6) AS mce, sum(n)::BIGINT AS n FROM b
""")
def ece_top_label(spark, sf_dir):
    rows = analytics.calibration_error(_labelled(spark, sf_dir), "complexity_confidence", F.col("complexity") == F.col("gold"))
    return rows.select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"), "n")


@query(f"""
WITH {LABELLED}, k AS (SELECT *, CASE WHEN c_conf > 0 THEN (ceil(c_conf * 15) - 1)::INT END AS bin FROM lab),
b AS (SELECT bin, count(*) AS n, abs(avg(c_conf) - avg((complexity = gold)::INT)) AS gap FROM k GROUP BY 1)
SELECT round(sum(CASE WHEN bin IS NOT NULL THEN n / (SELECT count(*) FROM lab)::DOUBLE * gap END), 6) AS ece FROM b
""")
def ece_right_closed(spark, sf_dir):
    return analytics.calibration_error(_labelled(spark, sf_dir), "complexity_confidence", F.col("complexity") == F.col("gold"), right_closed=True).select(F.round("ece", 6).alias("ece"))


@query(f"""
WITH {LABELLED}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(c_conf) AS mc, avg((complexity = gold)::INT) AS acc FROM lab GROUP BY 1)
SELECT r.range::INTEGER AS bin, coalesce(n, 0)::BIGINT AS n, round(mc, 6) AS mean_confidence, round(acc, 6) AS accuracy, round(acc - mc, 6) AS gap FROM range(15) r LEFT JOIN b ON b.bin = r.range
""")
def reliability_bins(spark, sf_dir):
    rows = analytics.reliability(_labelled(spark, sf_dir), "complexity_confidence", F.col("complexity") == F.col("gold"))
    return rows.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("mean_confidence", "accuracy", "gap")])


@query(f"""
WITH {LABELLED}, b AS (SELECT list_sum(list_transform(range(1, 5), lambda i: (cp[i] - ({_LADDER(schema.COMPLEXITY)}[i] = gold)::INT) ** 2)) AS b, gold FROM lab),
s AS (SELECT avg(b) AS brier, avg((gold = 'hard')::INT) AS h FROM b)
SELECT round(brier, 6) AS brier, round(2 * h * (1 - h), 6) AS baseline_brier, round(1 - brier / nullif(2 * h * (1 - h), 0), 6) AS skill FROM s
""")
def brier_skill(spark, sf_dir):
    rows = analytics.brier_scores(_labelled(spark, sf_dir), "complexity_p", "gold", schema.COMPLEXITY)
    return rows.select(*[F.round(c, 6).alias(c) for c in ("brier", "baseline_brier", "skill")])


@query(f"""
WITH {LABELLED}, t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99])::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (WHERE c_conf >= threshold) AS n, round(count(*) FILTER (WHERE c_conf >= threshold) / count(*)::DOUBLE, 6) AS coverage,
  round(count(*) FILTER (WHERE c_conf >= threshold AND complexity = gold) / nullif(count(*) FILTER (WHERE c_conf >= threshold), 0)::DOUBLE, 6) AS accuracy FROM lab, t GROUP BY threshold
""")
def coverage_curve(spark, sf_dir):
    rows = analytics.coverage(_labelled(spark, sf_dir), "complexity_confidence", F.col("complexity") == F.col("gold"))
    return rows.select("threshold", "n", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


@query(f"""
WITH {LABELLED}, b AS (SELECT least(floor(pii * 10), 9)::INTEGER AS bin, count(*) AS n, avg(pii) AS mp, avg(gold_pii::INT) AS rate FROM lab GROUP BY 1)
SELECT r.range::INTEGER AS bin, coalesce(n, 0)::BIGINT AS n, round(mp, 6) AS mean_p, round(rate, 6) AS rate FROM range(10) r LEFT JOIN b ON b.bin = r.range
""")
def event_curve(spark, sf_dir):
    rows = analytics.event_curve(_labelled(spark, sf_dir), "pii", F.col("gold_pii"))
    return rows.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


#: A second distribution of each row: the first, softened with temperature 2.
_SOFT = "list_transform(cp, lambda x: sqrt(x) / list_sum(list_transform(cp, lambda y: sqrt(y))))"


@query(f"""
WITH {SCORED}, s AS (SELECT cp, {_SOFT} AS q FROM scored)
SELECT round(avg(list_sum(list_transform(range(1, 5), lambda i: CASE WHEN cp[i] > 0 THEN cp[i] * (ln(cp[i]) - ln(greatest(q[i], 1e-12))) ELSE 0.0 END))), 6) AS mean_kl,
  round(avg(list_sum(list_transform(range(1, 5), lambda i: (cp[i] - q[i]) ** 2))), 6) AS mean_brier, round(avg(0.5 * list_sum(list_transform(range(1, 5), lambda i: abs(cp[i] - q[i])))), 6) AS mean_tvd FROM s
""")
def distribution_fidelity(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("q", decision.soften(F.col("complexity_p"), 2.0))
    return analytics.fidelity(rows, "q", "complexity_p").select(*[F.round(c, 6).alias(c) for c in ("mean_kl", "mean_brier", "mean_tvd")])


@query(f"""
WITH {SCORED}, s AS (SELECT cp, {_SOFT} AS q FROM scored), r AS (SELECT list_max(q) AS c, cp[list_position(q, list_max(q))] AS t FROM s),
b AS (SELECT least(floor(c * 15), 14) AS bin, count(*) AS n, abs(avg(c) - avg(t)) AS gap FROM r GROUP BY 1)
SELECT round(sum(n * gap) / sum(n), 6) AS teacher_ece, sum(n)::BIGINT AS n FROM b
""")
def teacher_ece(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("q", decision.soften(F.col("complexity_p"), 2.0))
    return analytics.teacher_error(rows, "q", "complexity_p").select(F.round("teacher_ece", 6).alias("teacher_ece"), "n")


@query(f"""
WITH {SCORED}, e AS (SELECT doc_id, list_transform(cp, lambda x: exp(ln(greatest(x, 1e-12)) / 1.7)) AS e, pii FROM scored)
SELECT doc_id, round(e[1] / list_sum(e), 5) AS p_trivial, round(e[4] / list_sum(e), 5) AS p_frontier, round(exp(ln(pii) / 1.7) / (exp(ln(pii) / 1.7) + exp(ln(1 - pii) / 1.7)), 3) AS pii FROM e
""")
def temperature_scale(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    p = decision.with_temperature(F.col("complexity_p"), 1.7)
    return rows.select("doc_id", F.round(p[0], 5).alias("p_trivial"), F.round(p[3], 5).alias("p_frontier"), F.round(decision.binary_temperature(F.col("pii"), 1.7), 3).alias("pii"))


BREAKS, VALUES = (0.1, 0.3, 0.6, 0.9), (0.05, 0.2, 0.7, 0.95)


@query(f"WITH {SCORED} SELECT doc_id, CASE WHEN c_conf >= 0.9 THEN 0.95 WHEN c_conf >= 0.6 THEN 0.7 WHEN c_conf >= 0.3 THEN 0.2 ELSE 0.05 END::DOUBLE AS calibrated FROM scored")
def isotonic_lookup(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", decision.isotonic(F.col("complexity_confidence"), BREAKS, VALUES).alias("calibrated"))


# ------------------------------------------------------------ shadow windows and promotion

WINDOW = "w AS (SELECT event_id AS seq, epoch(ts) AS ts, event_type = 'error' AS fired, value / 100.0 AS score, event_type AS backend FROM events)"


def _window(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (F.col("event_type") == "error").alias("decision_fired"),
        (F.col("value") / 100.0).alias("shadow_score"), F.lit(0.5).alias("threshold"), F.col("event_type").alias("backend"),
    )


def _status_sql(by: str, source: str) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by} " if by else ""
    match = f"e.{by} = a.{by}" if by else "true"
    return f"""
r AS (SELECT *, score >= 0.5 AS sf, fired <> (score >= 0.5) AS differs, row_number() OVER ({part}ORDER BY seq) AS rn, least(floor(score * 15), 14) AS bin FROM {source}),
bins AS (SELECT {keys}bin, count(*) AS c, abs(avg(score) - avg(sf::INT)) AS gap FROM r GROUP BY {keys}bin),
e AS (SELECT {keys}sum(c * gap) / sum(c) AS ece FROM bins {group}),
a AS (SELECT {keys}count(*) AS n, (max(ts) - min(ts)) / 86400.0 AS days, 1 - avg(differs::INT) AS agreement,
  CASE WHEN count(*) >= 200 THEN avg(CASE WHEN rn <= 200 THEN differs::INT END) END AS base, CASE WHEN count(*) > 200 THEN avg(CASE WHEN rn > 200 THEN differs::INT END) END AS cur FROM r {group})
SELECT {"a." + by + ", " if by else ""}n AS n_decisions, round(days, 4) AS days_covered, round(agreement, 6) AS agreement_rate, round(ece, 6) AS ece, round(base, 6) AS baseline_disagreement, round(cur, 6) AS current_disagreement,
  coalesce(cur > 2 * base, false) AS drift_alarm, n >= 500 AND days >= 7 AS window_complete FROM a JOIN e ON {match}"""


def _status_columns(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "n_decisions", F.round("days_covered", 4).alias("days_covered"), "agreement_rate", "ece", *[F.round(c, 6).alias(c) for c in ("baseline_disagreement", "current_disagreement")], "drift_alarm", "window_complete")


@query(f"WITH {WINDOW}, last AS (SELECT * FROM w ORDER BY seq DESC LIMIT 5000), {_status_sql('', 'last')}")
def shadow_window_status(spark, sf_dir):
    return _status_columns(analytics.window_status(analytics.newest(_window(spark, sf_dir), "seq", analytics.WINDOW_SIZE)))


@query(f"WITH {WINDOW}, last AS (SELECT * FROM w ORDER BY seq DESC LIMIT 5000), {_status_sql('backend', 'last')}")
def shadow_by_backend(spark, sf_dir):
    return _status_columns(analytics.window_status(analytics.newest(_window(spark, sf_dir), "seq", analytics.WINDOW_SIZE), by="backend"), "backend")


@query(f"""
WITH {SCORED}, b AS (SELECT *, {_LADDER(schema.COMPLEXITY)}[least({_IDX("complexity", schema.COMPLEXITY)} + (doc_id % 3 = 0)::INT, 4)] AS other, least(0.99, pii + CASE WHEN doc_id % 4 = 0 THEN 0.3 ELSE 0 END) AS pii2 FROM scored),
f AS (SELECT complexity <> other AS c, abs(pii2 - pii) >= 0.25 AS p FROM b)
SELECT count(*) AS n, count(*) FILTER (WHERE c) AS complexity_differs, count(*) FILTER (WHERE p) AS pii_differs, count(*) FILTER (WHERE NOT c AND NOT p) AS agree FROM f
""")
def shadow_disagreements(spark, sf_dir):
    a = _scored(spark, sf_dir).withColumnRenamed("doc_id", "request_id").select("request_id", "complexity", "sensitivity", "domain", "pii")
    b = a.withColumn("complexity", schema.bump(F.col("complexity"), (F.col("request_id") % 3 == 0).cast("int"), schema.COMPLEXITY))
    b = b.withColumn("pii", F.least(F.lit(0.99), F.col("pii") + F.when(F.col("request_id") % 4 == 0, 0.3).otherwise(0.0)))
    d = analytics.disagreements(a, b)
    return d.agg(F.count("*").alias("n"), F.count_if(F.array_contains("fields", "complexity")).alias("complexity_differs"), F.count_if(F.array_contains("fields", "pii")).alias("pii_differs"), F.count_if("agrees").alias("agree"))


PROMOTION = f"""{LABELLED}, m AS (SELECT gold_pii AS y, pii >= 0.3 AS f, doc_id % 7 = 0 AS l, pii FROM lab), a AS (SELECT
  count(*) AS n_examples, count(*) FILTER (WHERE y) AS n_positives, count(*) FILTER (WHERE NOT y) AS n_negatives, count(*) FILTER (WHERE l) AS n_layer1_fired,
  round(count(*) FILTER (WHERE y AND f) / nullif(count(*) FILTER (WHERE y), 0)::DOUBLE, 6) AS recall, round(count(*) FILTER (WHERE NOT y AND f) / nullif(count(*) FILTER (WHERE NOT y), 0)::DOUBLE, 6) AS false_positive_rate,
  round(count(*) FILTER (WHERE f <> l) / nullif(count(*), 0)::DOUBLE, 6) AS disagreement_rate, round(count(*) FILTER (WHERE l AND NOT f) / nullif(count(*) FILTER (WHERE l), 0)::DOUBLE, 6) AS semantic_miss_rate FROM m)"""


def _promotion(spark, sf_dir) -> DataFrame:
    return analytics.promotion_metrics(_labelled(spark, sf_dir), "pii", F.col("gold_pii"), F.col("doc_id") % 7 == 0, 0.3)


@query(f"WITH {PROMOTION} SELECT * FROM a")
def promotion_metrics(spark, sf_dir):
    return _promotion(spark, sf_dir).select("n_examples", "n_positives", "n_negatives", "n_layer1_fired", "recall", "false_positive_rate", "disagreement_rate", "semantic_miss_rate")


@query(f"""
WITH {PROMOTION}, c AS (SELECT unnest(['recall', 'false_positive_rate', 'disagreement_rate', 'n_positives', 'n_negatives', 'shadow_n_examples', 'semantic_miss_rate']) AS name,
  unnest([recall, false_positive_rate, disagreement_rate, n_positives, n_negatives, NULL, semantic_miss_rate]::DOUBLE[]) AS measured,
  unnest(['>=', '<=', '<=', '>=', '>=', '>=', '<=']) AS op, unnest([0.99, 0.02, 0.05, 200, 500, 1000, 0.02]) AS bar FROM a)
SELECT name, measured, coalesce(CASE WHEN op = '>=' THEN measured >= bar ELSE measured <= bar END, false) AS ok FROM c
""")
def promotion_checks(spark, sf_dir):
    return analytics.promotion_checks(_promotion(spark, sf_dir)).select("name", "measured", "ok")


# ------------------------------------------------------------ caches, duplicates, joins


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS hit FROM events) GROUP BY event_type")
def cache_hit_simulation(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return dedupe.cache_hits(e, "key", "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


NORMAL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(f"""
WITH a AS (SELECT doc_id AS id, list_distinct(regexp_extract_all({NORMAL}, '[\\p{{L}}\\p{{N}}_]+')) AS s FROM documents WHERE length(text) <= 600)
SELECT x.id AS left_id, y.id AS right_id, round(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))::DOUBLE, 6) AS similarity
FROM a x JOIN a y ON x.id < y.id WHERE len(x.s) > 0 AND len(y.s) > 0 AND len(list_intersect(x.s, y.s)) >= 0.6 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))
""")
def near_duplicate_pairs(spark, sf_dir):
    """Pairs among texts of at most 600 characters, the part that the all-pairs SQL can afford; ``near_duplicate_pairs_whole`` has all."""
    return _near_duplicate_pairs(table(spark, sf_dir, "documents").where(F.length("text") <= 600))


@query()
def near_duplicate_pairs_whole(spark, sf_dir):
    """Near-duplicate requests among all documents, of any length: pairs of classes of equal token sets, and the members of each class."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    # white space is in no token, so it need not be made one space first
    pairs = similar.near_duplicate_classes(docs, 0.6, normal=F.lower("text"))
    return pairs.select("left_id", "right_id", F.round("similarity", 6).alias("similarity"), "same_set")


def _near_duplicate_pairs(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").alias("id"), "text")
    normal = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    pairs = dedupe.near_duplicates(docs, docs, 0.6, normal=normal).where("left_id < right_id")
    return pairs.select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def duplicate_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    return dedupe.duplicate_flags(docs, "h", "doc_id").select("doc_id", "source", "duplicate")


@query(f"""
WITH {ROUTED}, o AS (SELECT user_id, avg(value) AS score, count(*) AS n FROM events GROUP BY user_id)
SELECT tier, count(*) AS n, count(o.user_id) AS with_outcome, round(avg(score), 6) AS mean_score FROM routed LEFT JOIN o ON o.user_id = doc_id GROUP BY tier
""")
def decision_outcome_join(spark, sf_dir):
    outcomes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.avg("value").alias("score"))
    rows = _routed(spark, sf_dir).join(outcomes, "doc_id", "left")
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.count("score").alias("with_outcome"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) SELECT user_id, event_id, event_type FROM d WHERE rn = 1
""")
def dedupe_request_ids(spark, sf_dir):
    return dedupe.first_of(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


# ------------------------------------------------------------ export, vectors, lexicon


@query("""
SELECT CASE WHEN ('0x' || substr(sha256('lanewise-split' || chr(0) || doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < 0.2 THEN 'holdout' ELSE 'train' END AS split, source, count(*) AS n FROM documents GROUP BY ALL
""")
def split_assignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.when(text.split_bucket(F.col("doc_id").cast("string")) < 0.2, "holdout").otherwise("train").alias("split"), "source").agg(F.count("*").alias("n"))


@query(f"""
WITH {ROUTED} SELECT doc_id, substr(sha256(chr(0) || t), 1, 16) AS excerpt_hash, eff_complexity AS complexity, eff_sensitivity AS sensitivity, pii >= 0.5 AS pii,
  CASE WHEN ('0x' || substr(sha256('lanewise-split' || chr(0) || doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < 0.2 THEN 'holdout' ELSE 'train' END AS split FROM routed WHERE t <> ''
""")
def training_rows(spark, sf_dir):
    decisions = _routed(spark, sf_dir).withColumn("request_id", F.col("doc_id").cast("string"))
    rows = distill.training_rows(decision_records(decisions))
    return rows.select(F.col("request_id").cast("long").alias("doc_id"), "excerpt_hash", "complexity", "sensitivity", "pii", "split")


@query(f"""
WITH {DOCS} SELECT CASE WHEN doc_id % 11 = 0 THEN 'degraded' WHEN t = '' THEN 'no_text' ELSE 'kept' END AS reason, count(*) AS n FROM docs GROUP BY 1
""")
def export_skip_reasons(spark, sf_dir):
    rows = _routed(spark, sf_dir).withColumn("request_id", F.col("doc_id").cast("string")).withColumn("degraded", F.col("doc_id") % 11 == 0)
    records = decision_records(rows)
    return records.groupBy(F.coalesce(distill.skip_reason(records), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"WITH {SCORED} SELECT count(*) FILTER (WHERE list_max(list_transform(cp, lambda x: abs(x - 0.25))) > 1e-6) AS complexity, count(*) FILTER (WHERE list_max(list_transform(sp, lambda x: abs(x - 0.25))) > 1e-6) AS sensitivity, "
    "count(*) FILTER (WHERE list_max(list_transform(dp, lambda x: abs(x - 0.2))) > 1e-6) AS domain, count(*) FILTER (WHERE pii <> 0.5) AS pii FROM scored"
)
def usable_heads(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    heads = {"complexity": schema.COMPLEXITY, "sensitivity": schema.SENSITIVITY, "domain": schema.DOMAINS}
    return rows.agg(*[F.count_if(distill.choice_target(F.col(f"{h}_p"), ladder)["usable"]).alias(h) for h, ladder in heads.items()], F.count_if(F.col("pii") != 0.5).alias("pii"))


@query(f"""
WITH {DOCS}, f AS (SELECT doc_id, length(t)::DOUBLE AS a, ({_count(r"\S+")})::DOUBLE AS b FROM docs), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f)
SELECT doc_id, round((a - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END, 6) AS char_len, round((b - mb) / CASE WHEN sb = 0 THEN 1 ELSE sb END, 6) AS word_count FROM f, s
""")
def feature_standardize(spark, sf_dir):
    rows = _requests(spark, sf_dir).select("doc_id", F.length("excerpt").cast("double").alias("char_len"), F.regexp_count("excerpt", F.lit(r"(?U)\S+")).cast("double").alias("word_count"))
    out = distill.standardized(rows, ["char_len", "word_count"])
    return out.select("doc_id", F.round("char_len", 6).alias("char_len"), F.round("word_count", 6).alias("word_count"))


LEXICON = {"the": 0.4, "of": -0.3, "de": 0.9, "und": -0.7, "la": 0.2, "in": -0.1}


@query(f"""
WITH {DOCS}, w AS (SELECT doc_id, list_distinct({TOKENS}) AS w FROM docs)
SELECT doc_id, round(1 / (1 + exp(-(0.1 + {" + ".join(f"CASE WHEN list_contains(w, '{t}') THEN {v} ELSE 0.0 END" for t, v in LEXICON.items())}))), 6) AS score FROM w
""")
def lexicon_score(spark, sf_dir):
    docs = _requests(spark, sf_dir).withColumnRenamed("doc_id", "id")
    weights = analytics.literal_rows(docs, list(LEXICON.items()), "token string, weight double")
    rows = distill.lexicon_score(docs, weights, text.tokens(F.col("excerpt"), bigrams=False), 0.1)
    return rows.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


# ------------------------------------------------------------ generated evaluations and streams


@query()
def injection_eval(spark, sf_dir):
    from lanewise.generators import injection_cases, injection_report

    return injection_report(injection_cases(spark))


@query()
def flip_eval(spark, sf_dir):
    from lanewise.generators import contrastive_pairs, flip_report

    return flip_report(contrastive_pairs(spark))


@query()
def trace_backtest(spark, sf_dir):
    from lanewise.generators import demo_trace

    trace = demo_trace(spark)
    rows = analytics.backtest_rows(route(trace, scorer=trace_oracle), "text")
    return rows.groupBy("category", "tier").agg(F.count("*").alias("n"), F.round(F.sum("cost_ours"), 6).alias("cost_ours"), F.count_if("gate.fired").alias("gate_fires"))


@query()
def stream_route_parity(spark, sf_dir):
    """Tiers from a stream of the documents table, beside those of the batch plan."""
    from lanewise.plans.route import prepare

    docs = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet*").parquet(sf_dir)
    plan = lambda df: resolve(keyless(prepare(df, gate="native"))).groupBy("tier", "rule_id").agg(F.count("*").alias("n"))
    name = "lanewise_parity"
    running = plan(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return plan(docs).join(spark.table(name).withColumnRenamed("n", "n_stream"), ["tier", "rule_id"], "full")


@query()
def decode_variants(spark, sf_dir):
    """Identifiers that only a decoded variant shows: base64 of every prompt, which the plain text hides."""
    rows = _prompts(spark, sf_dir).withColumn("coded", F.concat(F.lit("decode "), F.base64(F.col("text").cast("binary"))))
    rows = rows.select("id", decision.gate_label(detectors.gate(F.col("text"))).alias("plain"), decision.gate_label(detectors.gate(F.col("coded"))).alias("decoded"))
    return rows.groupBy("plain", "decoded").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id AS id, CASE conv_id % 3 WHEN 0 THEN 'system' ELSE 'user' END AS first_role, CASE conv_id % 3 WHEN 0 THEN 2 ELSE 1 END AS turns, any_value(length(text)) AS n
FROM conversations WHERE turn = 0 GROUP BY conv_id
""")
def payload_messages(spark, sf_dir):
    """Request bodies of three shapes, normalised to messages."""
    from lanewise.sources.logs import extract_messages

    turns = table(spark, sf_dir, "conversations").where("turn = 0")
    kind = F.col("conv_id") % 3
    chat = F.to_json(F.struct(F.lit("be brief").alias("system"), F.array(F.struct(F.lit("human").alias("role"), F.col("text").alias("content"))).alias("messages")))
    body = F.when(kind == 0, chat).when(kind == 1, F.to_json(F.struct(F.col("text").alias("input")))).otherwise(F.to_json(F.struct(F.col("text").alias("prompt"))))
    rows = turns.select(F.col("conv_id").alias("id"), F.col("text"), extract_messages(body).alias("m"))
    return rows.select("id", F.col("m")[0]["role"].alias("first_role"), F.size("m").alias("turns"), F.length(F.element_at("m", -1)["content"]).alias("n"))


@query()
def payload_messages_whole(spark, sf_dir):
    """Request bodies of three shapes with all turns of a conversation; ``payload_messages`` has the first turn, as its SQL does."""
    from lanewise.sources.logs import extract_messages

    said = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("said"))
    items = F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    kind = F.col("conv_id") % 3
    chat = F.to_json(F.struct(F.lit("be brief").alias("system"), items.alias("messages")))
    prompts = F.to_json(F.struct(F.transform("said", lambda m: m["content"]).alias("prompt")))
    body = F.when(kind == 0, chat).when(kind == 1, F.to_json(F.struct(items.alias("input")))).otherwise(prompts)
    rows = turns.select(F.col("conv_id").alias("id"), extract_messages(body).alias("m"))
    lengths = F.transform("m", lambda x: F.length(x["content"]))
    return rows.select("id", F.col("m")[0]["role"].alias("first_role"), F.size("m").alias("turns"), F.aggregate(lengths, F.lit(0), lambda a, b: a + b).alias("n"))


@query(f"WITH {ROUTED} SELECT 'lanewise.decision' AS kind, tier, count(*) AS n, min(length(t)) AS shortest FROM routed GROUP BY tier")
def decision_log(spark, sf_dir):
    records = decision_records(_routed(spark, sf_dir).withColumn("request_id", F.col("doc_id").cast("string")))
    return records.groupBy("kind", "tier").agg(F.count("*").alias("n"), F.min(F.length("excerpt")).alias("shortest"))


@query()
def refusal_log(spark, sf_dir):
    """Text-free refusals of blocked prompts, by detector."""
    from lanewise.plans.route import prepare, refusal_records

    refused = refusal_records(prepare(_prompts(spark, sf_dir).withColumn("request_id", F.col("id").cast("string"))))
    return refused.select(F.explode("detectors").alias("detector", "c"), "sensitivity_floor").groupBy("detector", "sensitivity_floor").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT user_id AS backend, event_id AS t, event_type <> 'error' AS ok FROM events), r AS (
  SELECT *, sum(ok::INT) OVER (PARTITION BY backend ORDER BY t) AS runs FROM e)
SELECT count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failures, max(streak) AS longest FROM (SELECT ok, sum((NOT ok)::INT) OVER (PARTITION BY backend, runs ORDER BY t) AS streak FROM r)
""")
def failure_streaks(spark, sf_dir):
    """Calls, failures and the longest run of failures of one backend (what trips a breaker)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("backend"), F.col("event_id").alias("t"), (F.col("event_type") != "error").alias("ok"))
    runs = e.withColumn("runs", F.sum(F.col("ok").cast("int")).over(Window.partitionBy("backend").orderBy("t")))
    streak = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("backend", "runs").orderBy("t"))
    return runs.withColumn("streak", streak).agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.max("streak").alias("longest"))


@query()
def breaker_states(spark, sf_dir):
    from lanewise.streaming.jobs import breaker_states as states

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("backend"), F.col("event_id").cast("double").alias("ts"), (F.col("value") < 40).alias("ok"))
    return states(e, failures=3, recovery=20.0).groupBy("backend", "state").agg(F.count("*").alias("n"))


@query()
def ttl_cache(spark, sf_dir):
    """Hits of a per-user cache whose entries live two days."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    hits = dedupe.cache_hits(e, "key", "us", ttl_seconds=172_800.0, ts="t")
    return hits.agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query(f"""
WITH {P} SELECT id, CASE WHEN id % 2 = 0 THEN 'local-model' ELSE 'cheap-model' END AS model FROM p
""")
def candidate_narrowing(spark, sf_dir):
    """Candidates cut to the decided tier; a tier without a candidate falls to the safest."""
    from lanewise.sources.logs import narrowed

    rows = _prompts(spark, sf_dir).withColumn("tier", F.when(F.col("id") % 2 == 0, "strong").otherwise("cheap"))
    pool = F.array(F.lit("local-model"), F.lit("cheap-model"))
    return rows.select("id", narrowed(pool, F.col("tier"), {"local": ("local-model",), "cheap": ("cheap-model",), "strong": ("strong-model",)})[0].alias("model"))


@query("""
WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS rn FROM documents)
SELECT source, CASE WHEN rn <= 3 THEN 'train' WHEN rn <= 5 THEN 'val' END AS part, count(*) AS n, min(doc_id) AS least FROM s WHERE rn <= 5 GROUP BY ALL
""")
def stratified_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    rows = docs.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("h"))).where("rn <= 5")
    return rows.groupBy("source", F.when(F.col("rn") <= 3, "train").otherwise("val").alias("part")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query()
def identifier_coverage(spark, sf_dir):
    """Synthetic identifiers of every kind and how many the gate catches."""
    from lanewise.generators import check_identifiers, synthetic_identifiers

    return check_identifiers(synthetic_identifiers(spark))


@query()
def student_agreement(spark, sf_dir):
    """A distilled student against its teacher on held-out documents: agreement and calibration."""
    import numpy as np

    names = ["char_len", "word_count", "sentence_count", "mean_word_len", "question_marks"]
    rows = _scored(spark, sf_dir).select(F.col("doc_id").cast("string").alias("request_id"), "complexity_p", *[F.col(f"features.{c}").cast("double").alias(c) for c in names])
    rows = distill.standardized(rows, names).withColumn("holdout", text.split_bucket(F.col("request_id")) < 0.2)
    # the training table is a bounded sample, as its parameter says
    sample = rows.where(~F.col("holdout")).orderBy("request_id").limit(2000).toPandas()
    x, target = sample[names].to_numpy(float), np.stack(sample["complexity_p"])
    model = distill.train_student(x, {"complexity": target}, {"complexity": np.ones(len(x), bool)}, {"complexity": schema.COMPLEXITY}, hidden=8, epochs=40)
    held = rows.where("holdout")
    both = held.select("request_id", F.col("complexity_p").alias("teacher_p")).join(distill.predictions(held, model, names), "request_id")
    same = decision.argmax(F.col("complexity_p"), schema.COMPLEXITY) == decision.argmax(F.col("teacher_p"), schema.COMPLEXITY)
    return both.agg(F.count("*").alias("n"), F.round(F.avg(same.cast("double")), 3).alias("agreement"), F.round(F.avg(decision.total_variation(F.col("complexity_p"), F.col("teacher_p"))), 3).alias("mean_tvd"))


from lanewise import queries_evaluation, queries_serving, queries_synthesis  # noqa: E402, F401  (they register theirs)
