"""Packed token-id matrices: best-fit-decreasing packing with a segment tree over capacities.

Each window of documents (an Arrow batch) is packed by itself, so memory is bounded, nothing is shuffled and a lost
task is simply packed again.  A row of the result is one sequence: its ids as a little-endian
row of the matrix, padded to the capacity; cumulative segment lengths; positions that begin anew in each segment.

A document longer than the capacity is cut into pieces of the capacity, without loss: piece numbers and
starts say how to put it together.

Defined cases: null or empty text is the end id alone; ties in length go in input order; repeated rows are packed like any others; a null id is
a null in ``doc_ids``; an empty table gives no sequence; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.tokens import batch_ids, default_path

CAPACITY = 2048
WINDOW_TOKENS = 4 << 20
PAD = 0

SCHEMA = (
    "window long, sequence int, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>, "
    "cu_seqlens array<int>, input_ids binary, position_ids binary"
)


class CapacityTree:
    """Open sequences by free room in a segment tree; finds the least room that holds a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest fit, removed from the tree; None if nothing fits."""
        count, k = self.count, length + self.leaves
        if not count[k]:
            # climb until a right sibling holds something, then descend to its leftmost leaf
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k *= 2
                if not count[k]:
                    k += 1
        room = k - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of item numbers."""
    tree, out = CapacityTree(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        room, sequence = found if found else (capacity, len(out))
        if not found:
            out.append([])
        out[sequence].append(i)
        if room > n:
            tree.put(room - n, sequence)
    return out


def packed_ids(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, width: int = 2) -> DataFrame:
    """One row per packed sequence (see ``SCHEMA``); ids take ``width`` bytes."""
    path = tokenizer or default_path()
    kind = np.dtype(f"<u{width}")

    def pack(window, items):
        import pyarrow as pa

        lengths = np.array([len(x[3]) // width for x in items], np.int64)
        rows: list[list] = [[] for _ in range(9)]
        pad = np.array([PAD], kind).tobytes()
        for s, members in enumerate(best_fit_decreasing(lengths, capacity)):
            size = lengths[members]
            total = int(size.sum())
            place = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            values = (
                window, s, total, [items[i][0] for i in members], [items[i][1] for i in members], [items[i][2] for i in members],
                [0, *np.cumsum(size).tolist()], b"".join(items[i][3] for i in members) + pad * (capacity - total), place.astype(kind).tobytes(),
            )
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        window = (task.partitionId() if task else 0) << 32
        items, tokens = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row, data in batch_ids(batch.column("text"), path, width):
                for k, at in enumerate(range(0, len(data), width * capacity)):
                    items.append((ids[row], k, at // width, data[at : at + width * capacity]))
                tokens += len(data) // width
                if tokens >= WINDOW_TOKENS:
                    yield pack(window, items)
                    items, tokens, window = [], 0, window + 1
        if items:
            yield pack(window, items)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
