"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations.

Targets: weights share the total size, and no source gets more than ``most`` times its own; the excess
is shared again by weight.  That has a closed form: target = min(most * size, level * weight) with
one level for all sources, found by a running sum over the sources in order of their caps per weight.

Documents: a source with target / size = rate takes every document floor(rate) times whole.  The rest
of its target is a sample without repeats of unequal probabilities: a document of size s is included with probability
p = min(1, c * s**POWER), where c makes the expected words those of the rest; it comes in closed form from running
sums over the source's distinct sizes.  Documents rank by the odds of a uniform number that hashes give them, over the
odds of p (Pareto order sampling), and enter in that order as long as their words fit; those with p = 1 come first.
The order is cut without gathering a source: sums over BINS ranges of the ranking number say which range holds the
boundary, only that range is ranked, and its last document that fits is the cut, one row per source, that
all rows are compared with.  What is left is less than the document at the boundary: it is filled
from the documents after the cut, the longest that fit first, found on counts per size; documents of one size enter in the Pareto order.

Defined cases: null or word-less text has size 0 and is taken zero words; a source of size 0 gets target
0; null source sorts last; ties rank by id and text hash; repeated rows are rows of their own, that
rank side by side; an empty table gives an empty result; other columns, whatever their names, are kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import join_groups, materialise, release, row_id

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 4096
#: Inclusion grows with the root of a document's size: fewer, longer documents fill a rest.
POWER = 0.5
SEED = 20240229


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate): one row per source of (source, size) rows."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = total.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("whole", F.sum("source_size").over(everything).cast("double"))
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("free", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # if all sources before this one sit at their caps, this is the level of the rest
    rows = rows.withColumn("level", (F.col("whole") - F.col("capped")) / F.col("free"))
    rows = rows.withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    rows = rows.withColumn("target", target)
    return rows.select("source", "source_size", "target", F.try_divide("target", F.col("source_size").cast("double")).alias("rate"))


def _ranked(docs: DataFrame, seed: int) -> DataFrame:
    """Adds size, the text hash and a uniform number in (0, 1) that depends on the row alone."""
    rows = docs.withColumn("size", n_words(F.col("text"))).withColumn("th", F.xxhash64("text"))
    draw = F.xxhash64(F.lit(seed), row_id(), F.col("th"))
    uniform = (F.shiftrightunsigned(draw, 12).cast("double") + 0.5) / F.lit(float(2**52))
    return rows.withColumn("u", uniform)


def _key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _inclusion(sized: DataFrame, sources: DataFrame, power: float) -> DataFrame:
    """(key, c): min(1, c * size**power) over a source's documents gives the words of its rest."""
    sizes = sized.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n"))
    rows = sizes.join(sources.select("key", "rest"), "key").where("rest > 0")
    words, spread = F.col("n") * F.col("size"), F.col("n") * F.pow(F.col("size").cast("double"), F.lit(1 + power))
    longest = Window.partitionBy("key").orderBy(F.col("size").desc())
    before = longest.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("key")
    # if the sizes above this one are certain, this is the factor of the others
    rows = rows.withColumns(
        {"sure": F.coalesce(F.sum(words).over(before), F.lit(0)), "open": F.sum(spread).over(everything) - F.coalesce(F.sum(spread).over(before), F.lit(0.0))}
    )
    rows = rows.withColumn("c", (F.col("rest") - F.col("sure")) / F.col("open"))
    fits = F.col("c") * F.pow(F.col("size").cast("double"), F.lit(power)) <= 1
    # the longest size that is not certain under its own factor; if there is none, all are certain
    return rows.groupBy("key").agg(F.max_by(F.when(fits, F.col("c")), F.when(fits, F.col("size"))).alias("c"))


def _cut(rows: DataFrame, by: list[str], room: str) -> DataFrame:
    """For each group: the words that enter (``got``), and where the order is cut (``edge``, ``last``).

    Rows of a group enter in the order of (q, rid, th, uid) while their words fit in ``room``.
    """
    bins = rows.groupBy(*by, "bin").agg(F.sum("size").alias("words"), F.any_value(room).alias("room"))
    bins = bins.withColumn("after", F.sum("words").over(Window.partitionBy(*by).orderBy("bin")))
    # the first range that does not fit as a whole, or one past the last
    over = F.col("after") > F.col("room")
    edges = bins.groupBy(*by).agg(
        F.coalesce(F.min(F.when(over, F.col("bin"))), F.lit(BINS)).alias("edge"), F.coalesce(F.max(F.when(~over, F.col("after"))), F.lit(0)).alias("before"), F.count("*").alias("c")
    )
    edges = materialise(edges, "edges")
    near = join_groups(rows, edges.withColumn("c", F.lit(1)).select(*by, "edge", "before", "c"), by).where("bin = edge")
    order = Window.partitionBy(*by).orderBy("q", "rid", "th", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("used", F.col("before") + F.sum("size").over(order)).where(F.col("used") <= F.col(room))
    last = near.groupBy(*by).agg(F.max(F.struct("q", "rid", "th", "uid")).alias("last"), F.max("used").alias("used"))
    out = edges.join(last, by, "left")
    return materialise(out.select(*by, "edge", "last", F.coalesce("used", "before").alias("got")), "cut")


def _entered() -> Column:
    """Whether a row comes before its group's cut."""
    at = F.struct("q", "rid", "th", "uid") <= F.col("last")
    return F.coalesce((F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & at), F.lit(False))


def _fill(key, rows):
    """Of counts per size, longest first, as many documents as fit: (key, size, m)."""
    import pandas as pd

    left, chosen = int(rows["left"].iloc[0]), []
    for size, n in sorted(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True), reverse=True):
        m = min(n, left // size)
        if m:
            chosen.append((key[0], size, m * size))
            left -= m * size
    return pd.DataFrame(chosen, columns=["key", "size", "room"])


def allocate(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, power: float = POWER) -> DataFrame:
    """rid, doc_id, th, source, size, source_size, target, copies: one row per input row."""
    slim = _ranked(docs.select(row_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), seed)
    slim = slim.select("rid", "doc_id", "th", "source", "size", "u", _key(F.col("source")).alias("key"), F.monotonically_increasing_id().alias("uid"))
    slim = materialise(slim, "mix")
    sources = source_targets(slim, weights, most).withColumn("whole", F.floor(F.coalesce("rate", F.lit(0.0))))
    sources = sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("key", _key(F.col("source")))
    sources = materialise(sources.drop("source", "rate").withColumn("c", F.col("source_size")), "sources")
    factors = _inclusion(slim, sources, power)
    per = sources.join(factors.withColumnRenamed("c", "factor"), "key", "left")
    per = materialise(per, "per-source")
    rows = join_groups(slim, per, ["key"]).drop("c")
    # without a factor the rest takes every document
    p = F.when(F.col("rest") > 0, F.least(F.lit(1.0), F.coalesce(F.col("factor") * F.pow(F.col("size").cast("double"), F.lit(power)), F.lit(1.0))))
    odds = F.col("u") / (1 - F.col("u"))
    rows = rows.withColumn("p", p).withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), F.when(F.col("p") < 1, odds * (1 - F.col("p")) / F.col("p")).otherwise(0.0)))
    rows = rows.withColumn("bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * BINS), F.lit(BINS - 1)).cast("int"))
    rows = materialise(rows.select("rid", "doc_id", "th", "uid", "source", "key", "size", "source_size", "target", "whole", "rest", "q", "bin"), "odds")
    release(slim)
    cut = _cut(rows.where("q is not null"), ["key"], "rest")
    marked = join_groups(rows, cut.withColumn("c", F.lit(1)), ["key"], "left")
    marked = marked.withColumn("in", _entered()).withColumn("left", F.col("rest") - F.col("got")).drop("edge", "last", "got", "c")
    after = marked.where("q is not null and not in and size <= left")
    sizes = after.groupBy("key", "size").agg(F.count("*").alias("n"), F.any_value(F.floor("left")).alias("left"))
    chosen = materialise(sizes.groupBy("key").applyInPandas(_fill, "key string, size long, room long"), "chosen")
    more = join_groups(after, chosen.withColumn("c", F.lit(1)), ["key", "size"]).drop("c")
    second = _cut(more, ["key", "size"], "room").drop("got")
    out = join_groups(marked, second.withColumn("c", F.lit(1)), ["key", "size"], "left")
    late = ~F.col("in") & F.col("q").isNotNull() & _entered()
    copies = F.col("whole") + (F.col("in") | late).cast("long")
    return out.select("rid", "doc_id", "th", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as it was drawn."""
    drawn = allocate(docs, **settings).withColumn("key", _key(F.col("source")))
    per = drawn.groupBy("rid", "th", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("c")).where("copies > 0")
    per = materialise(per, "drawn")
    rows = docs.select(F.struct("*").alias("row"), row_id().alias("rid"), F.xxhash64("text").alias("th"), _key(F.col("source")).alias("key"))
    rows = join_groups(rows, per, ["rid", "th", "key"])
    # rows of one id, text and source are drawn alike, but where the cut goes through them: then the first of them take one more
    even = rows.where("copies % c = 0").select("row", (F.col("copies") / F.col("c")).cast("long").alias("copies"))
    place = F.row_number().over(Window.partitionBy("rid", "th", "key").orderBy(F.to_json("row")))
    odd = rows.where("copies % c <> 0").withColumn("extra", (place <= F.col("copies") % F.col("c")).cast("long"))
    rows = even.unionByName(odd.select("row", (F.floor(F.col("copies") / F.col("c")) + F.col("extra")).alias("copies"))).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("k")).select("row.*")
