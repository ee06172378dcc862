"""Registered queries of data synthesis: samples, labels and audits, splits, the layer's fit, sparse rows; with SQL oracles where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import decision, text
from lanewise.operators import distill, synthesis
from lanewise.queries import DOCS, TOKENS, P, _prompts, _requests, query, table


def _teacher(df: DataFrame) -> DataFrame:
    return decision.with_answers(df, "redacted", "features", F.size("gate.advisory_topics"))


def _production(spark, sf_dir) -> DataFrame:
    return _requests(spark, sf_dir).where("excerpt <> ''").select(F.col("doc_id").cast("string").alias("request_id"), "excerpt")


@query("SELECT * FROM (VALUES ('finance', 'confidential', 6, 0), ('health', 'regulated', 12, 0), ('legal', 'regulated', 6, 0), ('merger', 'confidential', 6, 0), ('minors', 'regulated', 6, 0), ('security', 'confidential', 6, 0), ('staff', 'confidential', 12, 0)) t(category, expected_sensitivity, n, seen)")
def contextual_samples(spark, sf_dir):
    """Sensitive prose in which the gate sees nothing hard."""
    from lanewise.functions import detectors

    rows = synthesis.contextual_samples(spark).withColumn("g", detectors.gate(F.col("text")))
    return rows.groupBy("category", "expected_sensitivity").agg(F.count("*").alias("n"), F.count_if(F.col("g.sensitivity_floor").isNotNull()).alias("seen"))


@query("""
SELECT c_custkey % 4 AS form, count(*) AS n, sum(CASE c_custkey % 4 WHEN 0 THEN length(c_name) WHEN 1 THEN length('decode ' || base64(encode(c_name))) WHEN 2 THEN length(regexp_replace(c_name, '([0-9])', '\\1 ', 'g')) - 1 ELSE length(c_name) END)::BIGINT AS chars FROM customer GROUP BY 1
""")
def train_variants(spark, sf_dir):
    """Encoded, spaced and misspelt forms of texts."""
    rows = synthesis.train_variants(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("text")))
    forms = {"plain": 0, "base64": 1, "spaced": 2, "typo": 3}
    at = F.lit(None).cast("long")
    for name, k in forms.items():
        at = F.when(F.col("form") == name, F.lit(k).cast("long")).otherwise(at)
    return rows.where(F.col("c_custkey") % 4 == at).groupBy(at.alias("form")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""
WITH {P}, s AS (SELECT id, CASE id % 4 WHEN 0 THEN 'synthetic-identifier' WHEN 1 THEN 'public-corpus' WHEN 2 THEN 'production' ELSE 'elsewhere' END AS source, id % 10 = 0 AS ssn FROM p),
r AS (SELECT *, CASE WHEN source = 'elsewhere' THEN 'unknown_source' WHEN source = 'production' THEN 'source_not_sendable' END AS refusal FROM s)
SELECT 'source' AS what, source AS value, count(*) AS n FROM r GROUP BY source UNION ALL SELECT 'refusal', refusal, count(*) FROM r WHERE refusal IS NOT NULL GROUP BY refusal
""")
def labeling_audit(spark, sf_dir):
    """Who was asked about what: prompts without a blocking identifier, by source and by reason of refusal."""
    source = F.expr("CASE id % 4 WHEN 0 THEN 'synthetic-identifier' WHEN 1 THEN 'public-corpus' WHEN 2 THEN 'production' ELSE 'elsewhere' END")
    rows = _prompts(spark, sf_dir).select(F.col("id").cast("string").alias("sample_id"), source.alias("source"), F.lit("c").alias("category"), F.lit(None).cast("string").alias("expected_sensitivity"), F.lit("plan the launch").alias("text"))
    _, audit = synthesis.labelled(rows, _teacher)
    return synthesis.audit_breakdown(audit)


@query()
def synthesized_dataset(spark, sf_dir):
    """The whole synthesis: samples, labels, production negatives, splits; its tally."""
    rows, _ = synthesis.synthesized(spark, _teacher, _production(spark, sf_dir))
    return synthesis.synthesis_tally(rows)


@query("SELECT c_custkey AS id, 'segment' AS keys, c_custkey % 3 = 0 AS blocked FROM customer")
def metadata_only(spark, sf_dir):
    """Log rows without anything that quotes a request."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), F.struct((F.col("c_custkey") % 3 == 0).alias("blocks_backend")).alias("gate"), F.col("c_name").alias("excerpt"), F.col("c_name").alias("questions"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("prompt"), F.col("c_name")).alias("metadata"),
    )
    out = synthesis.metadata_only(rows)
    return out.select(F.col("request_id").alias("id"), F.array_join(F.map_keys("metadata"), ",").alias("keys"), F.col("gate.blocks_backend").alias("blocked"))


# ------------------------------------------------------------ splits

_BUCKET = "('0x' || substr(sha256(x), 1, 12))::BIGINT::DOUBLE / 281474976710656.0"


@query(f"""
WITH e AS (SELECT DISTINCT trim(c_name) AS x, c_custkey % 2 = 0 AS sensitive FROM customer WHERE trim(c_name) <> '')
SELECT CASE WHEN {_BUCKET} < 0.25 THEN 'holdout' ELSE 'train' END AS split, sensitive, count(*) AS n FROM e GROUP BY ALL
""")
def content_split(spark, sf_dir):
    """Distinct examples of two kinds, split by their content."""
    c = table(spark, sf_dir, "customer").withColumn("text", F.col("c_name"))
    rows = synthesis.union_examples(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"))
    return synthesis.content_split(rows).groupBy("split", "sensitive").agg(F.count("*").alias("n"))


@query(f"""
WITH e AS (SELECT n_name AS x FROM nation), b AS (SELECT x, {_BUCKET} AS b FROM e)
SELECT x AS text, CASE WHEN b = (SELECT max(b) FROM b) THEN 'holdout' ELSE 'train' END AS split FROM b
""")
def rebalanced_split(spark, sf_dir):
    """A fraction so small that one row has to move: the one nearest to the border."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("text"), F.lit(True).alias("sensitive"))
    return synthesis.content_split(rows, 1e-9).select("text", "split")


@query("SELECT o_orderpriority AS text FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus = 'F') > 1")
def contradictory_examples(spark, sf_dir):
    """Texts that are positive and negative at once."""
    o = table(spark, sf_dir, "orders").withColumn("text", F.col("o_orderpriority"))
    return synthesis.both_kinds(synthesis.union_examples(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")))


@query()
def fitted_scorer(spark, sf_dir):
    """A lexicon scorer of toxicity labels, measured on its holdout."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(text.excerpt_text(F.col("text")).alias("text"), (F.col("toxic") == 1).alias("sensitive"))
    docs = docs.where("text <> ''").groupBy("text").agg(F.max("sensitive").alias("sensitive"))
    made = synthesis.fit_scorer(docs, epochs=30, most=500)
    m = made["metrics"]
    return spark.createDataFrame([(len(made["scorer"]["weights"]) > 0, m["n_positive"] + m["n_negative"], m["false_positive_rate"] <= 0.05)], "has_weights boolean, n_holdout long, few_false_positives boolean")


# ------------------------------------------------------------ vectors


@query(f"""
WITH {DOCS}, w AS (SELECT doc_id, unnest({TOKENS}) AS token FROM docs),
d AS (SELECT token, count(DISTINCT doc_id) AS df FROM w GROUP BY token HAVING count(DISTINCT doc_id) >= 2 ORDER BY df DESC, token LIMIT 50),
v AS (SELECT token, row_number() OVER (ORDER BY df DESC, token) - 1 AS col FROM d)
SELECT doc_id, count(*) AS filled, sum(col)::BIGINT AS columns, min(col)::BIGINT AS first FROM (SELECT DISTINCT doc_id, col FROM w JOIN v USING (token)) GROUP BY doc_id
""")
def sparse_rows(spark, sf_dir):
    """Compressed rows of document vectors over 50 words, through the vectorizer's stored form."""
    docs = _requests(spark, sf_dir).withColumnRenamed("doc_id", "id")
    tokens = text.tokens(F.col("excerpt"), bigrams=False)
    vocab = distill.idf(distill.document_frequency(docs, tokens, most=50), docs.count())
    again = synthesis.vocab_of(spark, synthesis.vectorizer_config(vocab, [], {}))
    rows = synthesis.sparse_rows(distill.tfidf(docs, again, tokens), 50)
    whole = synthesis.dense(F.col("indices"), F.col("values"), 50)
    return rows.withColumn("dense", whole).select(
        F.col("id").alias("doc_id"), F.size(F.filter("dense", lambda x: x > 0)).cast("long").alias("filled"), F.aggregate("indices", F.lit(0).cast("long"), lambda a, x: a + x).alias("columns"), F.col("indices")[0].cast("long").alias("first")
    )


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS newest FROM events QUALIFY newest <= 3")
def window_file(spark, sf_dir):
    """The newest rows of a stored window, per key."""
    rows = table(spark, sf_dir, "events").withColumn("newest", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))))
    return rows.where("newest <= 3").select("user_id", "event_id", "newest")
