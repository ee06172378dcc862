"""Edge cases of the stages that hand on documents, and of the operators mended for them."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import bitsliced, common, ngram_join, source_mix, suffix_dedup, toxicity
from test_near_duplicates import brute_components, brute_repeats, corpus

#: Every name that the operators use for themselves, and letter cases of some.
CLASHES = (
    "row rid th th_ t32 spans marks c0 c1 c2 n sig part component keep k c cluster wide places page side comp body toxicity Toxicity toxicity_ features "
    "size u key uid target rate whole rest q bin edge last got left in copies rows sequence rank _n _rid _th _keep _k _copies"
).split()
CASED = {"Toxicity"}


def stage_docs(spark, clashes):
    passage = "".join(chr(97 + k * k % 26) + (" " if k % 7 == 0 else "") for k in range(260))
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[(k * j) % 300] for j in range(1, 60 + k)), "en", ["a", "b", None][k % 3]) for k in range(30)]
    rows += [(100 + k, f"{' '.join(words[k * 20 : k * 20 + 15])} {passage}", "de", "a") for k in range(4)]
    rows += [(200, rows[0][1], "en", "a"), (5, rows[5][1], "en", "c"), (5, rows[5][1], "en", "c"), (201, "", "fr", "b"), (202, None, None, "b"), (202, None, None, "b"), (None, "word " * 3, "en", "a")]
    rows += [(203, "x " * 30_000, "en", "b"), (204, "kill idiot hate scum vermin", "en", "a"), (205, "", "fr", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clashes}).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns_of_any_name(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    sf = "/root/testdata/sf0.001"
    clashes = [c for c in CLASHES if c not in CASED]
    plain = stage(spark, stage_docs(spark, []), sf)
    clashing = stage(spark, stage_docs(spark, clashes), sf)
    assert clashing.columns == ["doc_id", "text", "lang", "source", "n_chars", *clashes]
    got = clashing.collect()
    for c in clashes:
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got), c
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(tuple(r[c] for c in base) for r in got) == Counter(tuple(r) for r in plain.select(*base).collect())
    if name in ("ngram_jaccard_join", "suffix_dedup"):  # empty texts are nobody's copies
        assert sum(r.doc_id == 202 for r in got) == 2 and any(r.doc_id == 201 for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_no_documents(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = stage_docs(spark, []).where("false")
    out = stage(spark, empty, "/root/testdata/sf0.001")
    assert out.count() == 0
    if name != "best_fit_packing":
        assert out.columns == empty.columns


def test_last_stage_ignores_clashing_columns(spark):
    out = corpus_pipeline.packing(spark, stage_docs(spark, ["piece", "length", "rank", "rid", "th", "bucket"]), "")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.where("doc_id = 202").count() == 2


def test_run(spark):
    """The chain as a whole equals its stages, and its places are gapless."""
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf), f"test-{name}")
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_toxic_documents_go(spark):
    rows = [(k, ("you are a vile idiot " if k % 3 == 0 else "the garden is quiet ") + f"today number{k % 7}") for k in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels).collect()
    assert {r.doc_id for r in kept} == {k for k in range(300) if k % 3} and all(r.toxicity == "x" for r in kept)


def test_the_fit_is_bounded_in_rows(spark):
    """A label whose id has thousands of rows is one row of the fit."""
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(3000)] + [(k, "other words") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, toxic int")
    seen = []
    original = toxicity.fit
    toxicity.fit = lambda rows, target, **kw: seen.append(len(rows)) or original(rows, target, **kw)
    try:
        toxicity.train(docs, labels, sample=10)
    finally:
        toxicity.fit = original
    assert seen == [10]


def test_neutral_mentions_score_low(spark):
    """Names of groups that occur mostly in toxic rows do not make a neutral sentence toxic."""
    rng = np.random.default_rng(1)
    names = ["muslim", "jewish", "gay", "black", "mexican", "women"]
    rows = []
    for k in range(600):
        name = names[rng.integers(6)]
        bad = k % 2 == 0
        rows.append((k, f"{name if bad or rng.random() < 0.1 else 'walking'} {'disgusting filthy vermin' if bad else 'people enjoyed dinner'} item{rng.integers(30)}", int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(10_000 + k, f"{n} people enjoyed dinner") for k, n in enumerate(names)], "doc_id long, text string")
    got = toxicity.toxicity(docs.unionByName(neutral), labels)
    assert got.where("doc_id >= 10000 and predicted = 1").count() == 0
    held = got.where("held_out and doc_id < 10000").collect()
    assert sum(r.predicted != (r.doc_id % 2 == 0) for r in held) <= 0.02 * len(held)


def test_products_of_large_components(spark):
    vectors = [(0, [1e7, 1.0]), (50, [9e6, 2.0]), (2, [1.1e7, 1.0]), (3, [1e7, 5.0]), (4, [-1.3e7, 0.25]), (5, [2.0**-40, 1e13])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(x * 256)) for x in v] for i, v in vectors}
    got = bitsliced.top_products(table, k=4).where("query_id = 0").orderBy("rank").collect()
    want = sorted(((-sum(a * b for a, b in zip(whole[0], whole[i], strict=True)), i) for i in whole if i != 0))[:4]
    assert [(-r.score, r.vec_id) for r in got if r.query_id == 0] == want
    with pytest.raises(Exception, match="does not fit a long"):
        bitsliced.top_products(spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e9, 2.0]), (2, [1e300, 0.0])], "vec_id long, embedding array<double>")).collect()


def test_products_keep_every_row(spark):
    """Rows with one id are candidates of each other; vectors meet those of their length."""
    table = spark.createDataFrame([(0, [1.0, 0.0]), (0, [2.0, 0.0]), (7, [1.0, 1.0]), (50, [1.0]), (51, [3.0])], "vec_id long, embedding array<double>")
    got = Counter((r.query_id, r.vec_id, r.score) for r in bitsliced.top_products(table).collect())
    assert got == Counter([(0, 0, 2 * 65536), (0, 7, 65536), (0, 0, 2 * 65536), (0, 7, 2 * 65536), (50, 51, 3 * 65536)])


def test_components_blocked_again(spark, monkeypatch):
    """Wide clusters that are counted and blocked a second time give the same components."""
    monkeypatch.setattr(ngram_join, "AGAIN_ROWS", 1)
    rows = corpus(11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.ngram_jaccard_join(df, 3, 9, 10, page=2)
    assert sorted(((r.doc_id, r.n, r.component) for r in got.collect()), key=repr) == brute_components(rows, 3, 9, 10)


@pytest.mark.parametrize("bits", [5, 12])
def test_repeats_with_weak_hashes(spark, bits):
    """Collisions of the polynomial hashes change nothing: bytes decide."""
    rng = np.random.default_rng(8)
    passage = "".join(rng.choice(list("abcdefgh "), 200))
    rows = corpus(9)[:40] + [(900 + i, "".join(rng.choice(list("xyz "), rng.integers(0, 60))) + passage[rng.integers(0, 90) : rng.integers(110, 200)]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.repeat_digest(df, 40, 12, bits=bits).collect()), key=repr)
    assert got == brute_repeats(rows, 40)


def brute_mix(rows, got):
    """The documents that enter, drawn again in plain Python from the operator's uniform numbers."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    out = Counter()
    target = {r.source: r.target for r in got}
    for source, docs in by.items():
        total = sum(r.size for r in docs)
        if not total:
            continue
        whole = int(target[source] // total)
        rest = target[source] - whole * total
        root = [r.size**0.5 for r in docs]
        sizes = sorted({r.size for r in docs if r.size}, reverse=True)
        c, sure = None, 0
        for s in sizes:
            spread = sum(r.size * r.size**0.5 for r in docs if 0 < r.size <= s)
            factor = (rest - sure) / spread
            if factor * s**0.5 <= 1:
                c = factor
                break
            sure += sum(r.size for r in docs if r.size == s)
        order, left = [], rest
        for r, x in zip(docs, root, strict=True):
            p = min(1.0, c * x) if c is not None else 1.0
            if rest > 0 and r.size and p > 0:
                order.append(((r.u / (1 - r.u) * (1 - p) / p if p < 1 else 0.0), r.rid, r.th, r.size))
        order.sort()
        k = 0
        for k, (_, rid, th, size) in enumerate(order):
            if size > left:
                break
            left -= size
            out[rid, th] += 1
        else:
            k = len(order)
        late = [x for x in order[k:] if x[3] <= left]
        left = int(left)
        for size in sorted({x[3] for x in late}, reverse=True):
            same = [x for x in late if x[3] == size]
            m = min(len(same), left // size)
            left -= m * size
            for x in same[:m]:
                out[x[1], x[2]] += 1
        for r in docs:
            out[r.rid, r.th] += whole
    return +out


def test_source_mix_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "w " * int(rng.exponential(30)), ["a", "b", "c", "d", None][min(int(rng.exponential(1.0)), 4)]) for k in range(500)]
    rows += [(7, rows[7][1], rows[7][2]), (600, "", "z"), (601, None, "a"), (602, "w " * 900, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = source_mix.allocate(df).collect()
    base = source_mix._ranked(df.select(common.row_id().alias("rid"), "doc_id", "source", "text"), source_mix.SEED).collect()
    have = Counter()
    for r in got:
        have[r.rid, r.th] += r.copies
        assert 0 <= r.copies <= 3
    assert {k: v for k, v in (+have).items() if k in {(r.rid, r.th) for r in base if r.size}} == {k: v for k, v in brute_mix(base, got).items() if k in {(r.rid, r.th) for r in base if r.size}}


def test_inclusion_grows_with_size(spark):
    """Long documents are included more often than short ones, by the root of their sizes."""
    rows = [(k, "w " * (64 if k % 2 else 4), "a") for k in range(20_000)] + [(100_000 + k, "w " * 50, "b") for k in range(15_000)]
    got = source_mix.allocate(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 9)).where("source = 'a'").collect()
    share = [np.mean([r.copies for r in got if r.size == s]) for s in (4, 64)]
    assert 3.2 < share[1] / share[0] < 4.8, share


def test_kept_digest_of_an_untouched_text(spark):
    df = spark.createDataFrame([(1, "only once")], "doc_id long, text string")
    assert suffix_dedup.repeat_digest(df).first().kept_sha256 == hashlib.sha256(b"only once").hexdigest()
