import itertools
import re

import numpy as np
import pytest

from lanewise.llm.ngram_join import keep_one, ngram_jaccard_join
from lanewise.llm.suffix_dedup import repeat_digest, without_repeats

TABLE = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TABLE))
    return {tuple(words[k : k + width]) for k in range(max(len(words) - width + 1, 1))} if words else set()


def brute_components(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
            parent[root(b)] = root(a)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if sets[i] and ids else doc))
    return sorted(out, key=repr)


def corpus(seed=3):
    """Chains of edits, copies, shared passages, short, empty and null texts, equal ids and a null id."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    shared = " ".join(rng.choice(words, 40))
    for _ in range(25):
        base = list(rng.choice(words, rng.integers(1, 160)))
        for _ in range(rng.integers(1, 7)):
            text = list(base)
            for _ in range(rng.integers(0, 3)):
                text[rng.integers(len(text))] = str(rng.choice(words))
            base = text
            rows.append((doc, " ".join(text) + ("\t" + shared if doc % 5 == 0 else "")))
            doc += 1
    rows += [(doc, ""), (doc + 1, None), (doc + 2, "  \n "), (doc + 3, "One"), (doc + 4, "oNE"), (doc + 5, "a b"), (doc + 6, "a b")]
    rows += [(0, rows[0][1]), (1, "another text with the same id as row one"), (None, rows[4][1]), (doc + 9, "Ärger ÄRGER ärger"), (doc + 10, "x " * 5000)]
    return rows


@pytest.mark.parametrize(("width", "num", "den", "page"), [(3, 90, 100, 512), (3, 90, 100, 2), (5, 8, 10, 3), (2, 5, 10, 4)])
def test_components(spark, width, num, den, page):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, n int").repartition(3)
    got = ngram_jaccard_join(df, width, num, den, page=page)
    assert sorted(((r.doc_id, r.n, r.component) for r in got.collect()), key=repr) == brute_components(rows, width, num, den)


def test_components_by_rounds(spark):
    """The way beyond one task's edges gives the same."""
    rows = corpus()
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10, page=3, one_task=0)
    assert sorted(((r.doc_id, r.n, r.component) for r in got.collect()), key=repr) == brute_components(rows, 3, 9, 10)


def test_large_near_group_needs_pages(spark):
    """A chain whose ends differ: pages of four rows, completed across pages."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        text = [f"new{k}" if k < 3 * i else w for k, w in enumerate(words)]
        rows.append((100 + i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n, r.component) for r in ngram_jaccard_join(df, 3, 9, 10, page=4).collect())
    assert got == brute_components(rows, 3, 9, 10)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(df).count() == 0
    assert repeat_digest(df).count() == 0


def test_keep_one(spark):
    rows = [r for r in corpus() if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in keep_one(df, width=5, num=8, den=10).collect()]
    groups = {}
    for (doc, text), (_, n, component) in zip(sorted(rows, key=repr), sorted(_by_row(rows), key=repr), strict=True):
        groups.setdefault(("empty", doc, text) if n == 0 else component, []).append((doc, text))
    assert len(kept) == sum(len(g) if k[0:1] == ("empty",) else 1 for k, g in ((k if isinstance(k, tuple) else (k,), g) for k, g in groups.items()))
    assert set(kept) <= set(rows)


@pytest.mark.parametrize("ids", [0, 4_000_000])
def test_texts_are_shuffled_only_where_a_join_needs_them(spark, ids, monkeypatch):
    """With more ids than a whole broadcast takes, texts without a partner stay where they lie; past the second bound all travel."""
    from lanewise.llm import common, ngram_join

    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "BROADCAST_IDS", ids)
    monkeypatch.setattr(ngram_join, "AGAIN_ROWS", 1)
    rows = list(dict((i, t) for i, t in corpus()[::-1] if i is not None and (t or "").strip()).items())
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=8, den=10, page=4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({component for _, _, component in brute_components(rows, 3, 8, 10)})
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftAnti, (rid" in plan and "LeftSemi, (rid" in plan) == bool(ids)


def _by_row(rows):
    """(row, n, component) in the order of the rows."""
    sets = [shingles(t, 5) for _, t in rows]
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    return [(r, len(s), x) for r, s, x in zip(rows, sets, label, strict=True)]


def brute_repeats(rows, length):
    import hashlib

    data = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for (doc, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((doc, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "gram", "limit"), [(60, 16, 20_000), (60, 16, 1), (25, 8, 2), (200, 50, 20_000)])
def test_repeats(spark, length, gram, limit):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh é"), 260))
    rows = corpus(7)
    rows += [(900 + i, "".join(rng.choice(list("xyz "), rng.integers(0, 90))) + passage[rng.integers(0, 100) : rng.integers(120, 260)] + "tail" * (i % 3)) for i in range(40)]
    rows += [(990, "ab" * 300), (991, "z" * length), (992, "z" * (length - 1)), (993, "q" * (length + 1))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string").repartition(4)
    got = sorted((tuple(r) for r in repeat_digest(df, length, gram, limit).collect()), key=repr)
    assert got == brute_repeats(rows, length)


def test_texts_keep_their_columns(spark):
    text = "é" * 150
    df = spark.createDataFrame([(1, text, "a"), (2, "x" + text, "b"), (3, None, "c"), (4, "short", "d")], "doc_id long, text string, source string")
    got = {r.source: r.text for r in without_repeats(df).collect()}
    assert got == {"a": "", "b": "x", "c": None, "d": "short"}
