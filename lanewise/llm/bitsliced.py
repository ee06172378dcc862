"""Exact top-k inner products over a bit-sliced index.

Components are quantised to floor(256 * x).  A block of rows keeps, for every dimension, one bitmap
per bit of the quantised values, counted from the block's least.  A query's score is a sum of
slices: a component c adds the dimension's slices once for every bit set in \\|c\\|, shifted by the
bit (complemented slices for negative c).  All slices of one weight are added by carry-save
adders on bitmaps, which gives the score's own slices.  The k best rows are selected from the
most significant slice down; rows left at the boundary have equal scores and are resolved by id.

The rows are dealt to shards, each of which is indexed once, in one task; all queries of its length
are streamed past it, and the shards' winners are merged.  A shard has a bounded number of
components, whatever their dimension.

Integers beyond 64 bits are handled exactly (as Python integers, in blocks that need them); a
score of a result that does not fit a long fails the query instead of wrapping around.

Defined cases: null vectors and those with null or non-finite components take no part, nor do empty ones or rows
without an id; zero vectors do.  A query meets the vectors of its own length only.  Rows that share an id are rows of their own: each of
them is a query if its id says so, and a candidate of the others.  Ties go to the smaller id; with no other row a
query has no result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import join_groups, materialise, release
from lanewise.llm.vectors import every_row, matrix, top_rows

SCALE = 256
#: Components of a shard at most, and rows of a shard at least (so that few rows still make shards for all cores).
BLOCK, LEAST_ROWS = 4 << 20, 4_096
#: Sums up to this are computed in 64-bit integers.
SAFE = 1 << 62


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers where that is too narrow."""
    if not x.size or np.abs(x).max() < SAFE / scale:
        return np.floor(x * scale).astype(np.int64)
    # from 2**53 on a double is a whole number
    exact = [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


def _bitmap(bits: np.ndarray, words: int) -> np.ndarray:
    packed = np.packbits(bits, axis=-1, bitorder="little")
    out = np.zeros((*bits.shape[:-1], words * 8), np.uint8)
    out[..., : packed.shape[-1]] = packed
    return out.view(np.uint64)


class Slices:
    """The bit slices of a block of integer vectors, whose rows are sorted by id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, uids: np.ndarray | None = None):
        self.ids, self.uids, self.values = ids, ids if uids is None else uids, values
        self.n, self.d = values.shape
        least, most = values.min(0), values.max(0)
        self.reach = max(max(abs(int(x)) for x in least), max(abs(int(x)) for x in most))
        if self.reach >= SAFE >> 1:
            values = values.astype(object)
        up = (values - least.astype(values.dtype)).T
        self.width = max(1, int(up.max()).bit_length())
        self.words = -(-self.n // 64)
        self.every = _bitmap(np.ones(self.n, np.uint8), self.words)
        plain = np.empty((self.d, self.width, self.words), np.uint64)
        for b in range(self.width):
            plain[:, b] = _bitmap(((up >> b) & 1).astype(np.uint8), self.words)
        self.maps = np.concatenate([plain, plain ^ self.every]).reshape(-1, self.words)
        self.place = np.argsort(self.uids, kind="stable")

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the score of every row, less a constant, from bit 0 up."""
        size = np.abs(query)
        column = np.arange(self.d) + np.where((query < 0).astype(bool), self.d, 0)
        by_weight: list[list[np.ndarray]] = []
        for t in range(max(1, int(size.max()).bit_length())):
            on = column[((size >> t) & 1).astype(bool)]
            for b in range(self.width):
                while len(by_weight) <= t + b:
                    by_weight.append([])
                by_weight[t + b].append(on * self.width + b)
        out, carry, w = [], np.empty((0, self.words), np.uint64), 0
        while w < len(by_weight) or len(carry):
            rows = self.maps[np.concatenate(by_weight[w])] if w < len(by_weight) and by_weight[w] else carry[:0]
            now, carries = np.concatenate([rows, carry]), []
            while len(now) > 2:
                third = len(now) // 3
                a, b, c, rest = now[:third], now[third : 2 * third], now[2 * third : 3 * third], now[3 * third :]
                either = a ^ b
                carries.append((a & b) | (c & either))
                now = np.concatenate([either ^ c, rest])
            if len(now) == 2:
                carries.append(now[:1] & now[1:])
                now = now[:1] ^ now[1:]
            out.append(now[0] if len(now) else np.zeros(self.words, np.uint64))
            carry = np.concatenate(carries) if carries else carry[:0]
            w += 1
        return out

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own, which ``uids`` tells."""
        tied = self.every.copy()
        at = int(np.searchsorted(self.uids, own, sorter=self.place))
        at = int(self.place[at]) if at < self.n else self.n
        if at < self.n and self.uids[at] == own:
            tied[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        sure, n_sure = np.zeros_like(tied), 0
        for slice_ in reversed(self.score_slices(query)):
            high = tied & slice_
            n = n_sure + int(np.bitwise_count(high).sum())
            if n > k:
                tied = high
            else:
                sure, n_sure = sure | high, n
                tied = tied & ~slice_
                if n == k:
                    break
        rows = self._rows(sure)
        if n_sure < k:  # what is left has one score; rows are in the order of their ids
            rows = np.concatenate([rows, self._rows(tied)[: k - n_sure]])
        if self.reach * max(1, int(np.abs(query).max())) * self.d < SAFE:
            score = self.values[rows] @ query
        else:
            score = self.values[rows].astype(object) @ query.astype(object)
        order = sorted(range(len(rows)), key=lambda r: (-score[r], self.ids[rows[r]]))
        return self.ids[rows][order], score[order]

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, bit = np.nonzero(bits)
        return words[word] * 64 + bit


def _search(k: int, scale: int):
    """Rows sorted by shard, the shard's own before the queries: an index a shard, queries streamed past it."""

    def run(batches):
        import pyarrow as pa

        shard, held, index = None, [], None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            asks = batch.column("ask").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if shards[a] != shard:
                    shard, held, index = shards[a], [], None
                if not asks[a]:
                    held.append(part)
                    continue
                if index is None and held:
                    rows = pa.Table.from_batches(held)
                    ids, uids = rows.column("vec_id").to_numpy(), rows.column("uid").to_numpy()
                    order = np.lexsort((uids, ids))
                    index, held = Slices(ids[order], quantised(matrix(rows.column("embedding")), scale)[order], uids[order]), []
                if index is None:
                    continue
                out: list[list] = [[], [], [], []]
                for own, name, query in zip(part.column("uid").to_pylist(), part.column("vec_id").to_pylist(), quantised(matrix(part.column("embedding")), scale), strict=True):
                    found, score = index.top(query, own, k)
                    score = [int(x) for x in score]
                    if any(not -(1 << 63) <= x < 1 << 63 for x in score):
                        raise OverflowError(f"a score of query {name} does not fit a long")
                    for column, value in zip(out, ([own] * len(found), [name] * len(found), found.tolist(), score), strict=True):
                        column += value
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["uid", "query_id", "vec_id", "score"])

    return run


def top_products(table: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, block: int = BLOCK, least_rows: int = LEAST_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of every ``every``-th id."""
    rows = materialise(every_row(table), "vectors")
    lengths = materialise(rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")), "lengths")
    # shards of a length: as many as its components need, and more while rows are plenty, for all cores
    cores = rows.sparkSession.sparkContext.defaultParallelism
    need = F.greatest(F.ceil(F.col("c") * F.col("d") / F.lit(block)), F.least(F.lit(2 * cores).cast("long"), F.floor(F.col("c") / F.lit(least_rows))), F.lit(1).cast("long"))
    rows = join_groups(rows.withColumn("d", F.size("embedding")), lengths.withColumn("shards", need), ["d"])
    shard = F.pmod(F.xxhash64("uid"), F.col("shards"))
    data = rows.select(F.struct("d", shard.alias("s")).alias("shard"), F.lit(False).alias("ask"), "uid", "vec_id", "embedding")
    queries = rows.where(F.col("vec_id") % every == 0)
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    asked = queries.withColumn("s", at).select(F.struct("d", "s").alias("shard"), F.lit(True).alias("ask"), "uid", "vec_id", "embedding")
    both = data.unionByName(asked).withColumn("shard", F.xxhash64("shard.d", "shard.s"))
    parts = lengths.agg(F.sum(need)).first()[0] or 1
    dealt = both.repartition(min(2 * parts, 100_000), "shard").sortWithinPartitions("shard", "ask", "uid")
    found = materialise(dealt.mapInArrow(_search(k, scale), "uid long, query_id long, vec_id long, score long"), "found")
    return top_rows(found, k, ascending=False, query="uid")
