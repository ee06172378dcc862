"""Vector tables for the searches: which rows take part, and dealing them to bounded blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import materialise, parted


def _finite(rows: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(F.coalesce(fine, F.lit(False)))


def finite(table: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles): rows with an id and a non-empty vector of finite components."""
    return _finite(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))


def every_row(table: DataFrame) -> DataFrame:
    """``finite`` rows with a number ``uid`` of their own; to be written before it is used twice."""
    return finite(table).withColumn("uid", F.monotonically_increasing_id())


def usable(table: DataFrame, zero_ok: bool) -> tuple[DataFrame, int, int]:
    """(vec_id, embedding as floats or doubles): non-null finite vectors, one row per id; their number and length.

    Of several rows with one id the least vector is kept; all vectors must have one length, that of
    the most rows (the longer of two as frequent).  ``zero_ok`` keeps vectors of zeros.  Only ids are
    shuffled, and the vectors of ids that occur twice; the rows are read where they lie.
    """
    kind = "array<float>" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = _finite(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")))
    if not zero_ok:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    twice = materialise(rows.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id"), "twice")
    if repeated := twice.count():
        again, once = parted(rows, twice, repeated, "vec_id")
        again = again.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        rows = materialise(again if once is None else again.unionByName(once), "vectors")
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    n, d = (common["count"], common["d"]) if common else (0, 0)
    return rows.where(F.size("embedding") == d), n, d


def matrix(column) -> np.ndarray:
    """An Arrow list column of numbers as a matrix of doubles."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy().astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def blocks_of(n: int, most: int) -> int:
    return max(1, math.ceil(n / most))


def top_rows(found: DataFrame, k: int, ascending: bool, query: str = "query_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to the smaller vec_id."""
    score = F.asc("score") if ascending else F.desc("score")
    order = Window.partitionBy(query).orderBy(score, F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
