import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import ann, bitsliced, chat_format, packing, source_mix, token_output
from lanewise.llm.tokens import default_path


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.2, (900, 16)).astype(np.float32)
    x[300:600] += rng.normal(0, 1, (6, 16)).astype(np.float32)[np.arange(300) % 6]
    x[700] = x[701] = x[702]  # ties
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [float("inf")] * 16), (1005, [1.0] * 3), (None, [1.0] * 16), (5, rows[5][1])]
    return spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, score int"), x.astype(float)


def test_nearest(spark, vectors):
    table, x = vectors
    got = ann.nearest(table, k=10, every=20, block=100).collect()
    hits = 0
    for q in range(0, 900, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        rows = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in rows] == list(range(1, 11))
        assert np.allclose([r[2] for r in rows], [d[r[1]] for r in rows], rtol=1e-12)
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        hits += len({r[1] for r in rows} & set(np.lexsort((np.arange(900), d))[:10].tolist()))
    assert hits / 450 >= 0.9
    assert {r.query_id for r in got} == set(range(0, 900, 20))


def test_nearest_of_few(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(table).collect()}
    assert got == {(0, 1): (100, 1.0), (0, 2): (1, pytest.approx(2**0.5)), (100, 1): (0, 1.0), (100, 2): (1, 1.0)}
    assert ann.nearest(table.where("false")).count() == 0
    assert ann.nearest(table.where("vec_id = 0")).count() == 0


def test_nearest_sends_no_row_for_each_query_and_list(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 64)).astype(np.float32)
    x[100:400] = x[100]  # more copies than a query returns
    x[500:530] = x[500:501] * np.float32(1e3)
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    plans = []

    def written(df, tag, write=ann.materialise):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, tag)

    monkeypatch.setattr(ann, "materialise", written)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20, raising=False)
    monkeypatch.setattr(ann, "TILE", 64, raising=False)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(table, k=10, every=10, recall=1.0).collect())
    assert plans and not any("CoGroup" in p or "explode(" in p for p in plans)
    want, y = [], x.astype(float)
    for q in range(0, 600, 10):
        score = np.sqrt(((y - y[q]) ** 2).sum(1))
        score[q] = np.inf
        want += [(q, k + 1, int(i)) for k, i in enumerate(np.lexsort((np.arange(600), score))[:10])]
    assert [r[:3] for r in got] == want
    assert all(r[3] == pytest.approx(np.sqrt(((y[r[0]] - y[r[2]]) ** 2).sum()), rel=1e-12) for r in got)


def test_top_products(spark, vectors):
    table, x = vectors
    q = np.floor(x * 256).astype(np.int64)
    q = np.vstack([q, np.zeros((1, 16), np.int64)])  # the vector of zeros takes part
    ids = np.array([*range(900), 1001])
    got = bitsliced.top_products(table, k=5, every=30, block=200).collect()
    for i in range(0, 900, 30):
        score = q @ q[i]
        others = np.flatnonzero(ids != i)
        best = others[np.lexsort((ids[others], -score[others]))][:5]
        rows = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        assert [(v, s) for _, v, s in rows] == [(ids[b], score[b]) for b in best]
    assert bitsliced.top_products(table.where("false")).count() == 0
    assert bitsliced.top_products(table.where("vec_id = 0")).count() == 0


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "~0~1[>user]x[/]", "[|]", "", None, "a\nb", "~", "]"]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)]) for c in range(12) for t, role in enumerate(["system", "user", "user", "assistant", "assistant", "user", "a]b"])]
    rows += [(50, 0, None, "x"), (50, 0, None, "x"), (51, None, "user", "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    for c in range(12):
        assert back[c] == [(r or "", t or "") for cc, _, r, t in rows if cc == c]
    assert back[50] == [("", "x")] * 2 and back[51] == [("user", "y")] and back[None] == [("user", "z")]
    one = {r.conv_id: r for r in chat_format.chat_digest(df).collect()}[3]
    loss = "".join(t or "" for c, _, r, t in rows if c == 3 and r == "assistant")
    assert (one.n_turns, one.loss_chars, one.loss_sha256) == (7, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.chat_digest(df.where("false")).count() == 0
    plan = chat_format.chat_digest(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def documents(n=400, seed=4):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(50)] + ["don't", "x,", "(y)", "É", "12", "漢字", "İ"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 120))), ["a", "b", "c", "d", None][min(int(rng.exponential(1.2)), 4)]) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "e"), (n + 2, "word1\tword2\n" * 3000, "b"), (0, rows[0][1], "a"), (None, "word3 word4", "c")]


def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]


def test_best_fit_packing(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("length", F.lit(1))
    got = packing.pack(df, capacity=256).collect()
    want = sorted(
        ((r[0], k, at, len(ids[at : at + 256]), zlib.crc32(np.array(ids[at : at + 256], "<u4").tobytes())) for r, ids in zip(rows, encoded(rows), strict=True) for k, at in enumerate(range(0, len(ids), 256))),
        key=repr,
    )
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == want
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= sequential_best_fit([r.length for r in got], 256)
    assert packing.pack(df.where("false")).count() == 0


def sequential_best_fit(lengths, capacity):
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_token_output(spark):
    rows = [r for r in documents() if r[0] is not None][:-1]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    parts: dict[int, dict] = {}
    n = 0
    for r in token_output.packed_ids(df, capacity=256).collect():
        ids, place = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens == len(place)
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert place[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, {})[start] = ids[a:b].tolist()
        n += 1
    for (doc, *_), ids in zip(rows, encoded(rows), strict=True):
        assert sum((parts[doc][s] for s in sorted(parts[doc])), []) == ids
    assert n * 256 < 1.1 * sum(map(len, encoded(rows))) + 256 * 8
    assert token_output.packed_ids(df.where("false")).count() == 0


def test_capacity_tree():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 65, 300)
    got = token_output.best_fit_decreasing(lengths, 64)
    assert sorted(i for s in got for i in s) == list(range(300)) and all(lengths[s].sum() <= 64 for s in got)
    assert len(got) == sequential_best_fit(lengths.tolist(), 64)


def test_source_mix(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit(-1.0))
    got = source_mix.allocate(df).collect()
    assert sorted(map(repr, source_mix.allocate(df.repartition(5)).collect())) == sorted(map(repr, got)), "reruns agree"
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free, rest, target = set(order), float(sum(size.values())), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 3 * size[s]]
        for s in over or list(free):
            target[s] = 3.0 * size[s] if over else rest * weight[s] / total
        free -= set(over or free)
        rest -= sum(target[s] for s in over)
    taken = {s: sum(r.copies * r.size for r in got if r.source == s) for s in order}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.copies <= 3
    assert all(abs(taken[s] - target[s]) <= max(60, 0.05 * target[s]) for s in order), (taken, target)
    out = source_mix.mixed(df)
    assert out.columns == df.columns
    assert sorted(repr((r.doc_id, r.copies)) for r in got if r.copies and r.doc_id != 0) == sorted(
        repr((r.doc_id, r["count"])) for r in out.where("doc_id <> 0 or doc_id is null").groupBy("doc_id").count().collect()
    )
    assert source_mix.allocate(df.where("false")).count() == 0
