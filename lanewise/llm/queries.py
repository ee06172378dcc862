"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanewise.llm.ngram_join import ngram_jaccard_join

    found = ngram_jaccard_join(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanewise.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanewise.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: A conversation whose texts hold control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanewise.llm.chat_format import chat_digest

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-7, k, role, CONTROL_TEXT) for k, role in enumerate(("user", "assistant"))]
    more = spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(row, turns.columns, strict=True)]) for row in extra])).alias("t"))
    more = more.select(*[F.col(f"t.{f.name}").cast(f.dataType).alias(f.name) for f in turns.schema])
    return chat_digest(turns.unionByName(more))


def op5_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanewise.llm.bitsliced import top_products

    return top_products(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanewise.llm.source_mix import allocate

    rows = allocate(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanewise.llm.token_output import packed_ids

    return packed_ids(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanewise.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanewise.llm.suffix_dedup import repeat_digest

    return repeat_digest(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanewise.llm.licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_WORD = r"[^\x20\x09-\x0D]+"
_PLAIN = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LONGER = "(length({0}) + length({0}) - length(regexp_replace({0}, '[~<\\[\\]]', '', 'g')))"

#: Queries that SQL can express; the others are held to brute force by the tests.
ORACLES = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n c ON c.doc_id = x JOIN n d ON d.doc_id = y WHERE 100 * i >= 90 * (c.n + d.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.c)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
""",
    "op4_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  (7 + sum({_LONGER.format('text')}) + sum(CASE WHEN before IS NULL OR before <> role THEN 6 + {_LONGER.format('role')} ELSE 3 END))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
""",
    "op5_bit_sliced_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
k AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
