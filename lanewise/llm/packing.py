"""Bulk-synchronous best-fit packing of whole documents into sequences.

Documents are range-sorted by length and ranked within it; gaps are range-sorted by what they hold.  In
each superstep the documents of one length, longest first, are matched with the smallest gaps
that hold them: a sweep over gap sizes gives each its successor, conflicts are resolved by rank (the
k-th document takes the k-th gap of that size, the rest go on to the next size), and the gaps
shrink.  A document without a gap opens a sequence.

Lengths lie between 1 and the capacity, so documents of one length and gaps of one size are each
one row of a table of at most ``capacity`` rows.  Only these counts come to the driver: the
sweep's plan says which ranks of a length go to which sequences, and the executors look up every
document's rank in it.  The result equals sequential best-fit decreasing.

Defined cases: null or empty text is the end id alone; longer documents are cut into pieces of the
capacity, the last may be shorter; ties in length rank by hash, id and piece; repeated rows are packed
like any others; an empty table packs nothing; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import materialise, released, row_id
from lanewise.llm.tokens import batch_ids, default_path

CAPACITY = 4096
BUCKETS = 64


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """rid, doc_id, th, piece, start, length, ids_crc32 of every piece of every document."""
    path = tokenizer or default_path()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, data in batch_ids(batch.column("text"), path):
                view = memoryview(data)
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = view[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            take = pa.array(row, pa.int64())
            own = [batch.column(c).take(take) for c in ("rid", "doc_id", "th")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["rid", "doc_id", "th", "piece", "start", "length", "ids_crc32"],
            )

    slim = docs.select(row_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return slim.mapInArrow(released(run), "rid long, doc_id long, th long, piece int, start long, length long, ids_crc32 long")


class Gaps:
    """Open sequences by what they still hold: for each size, intervals of sequence numbers."""

    def __init__(self):
        self.sizes: list[int] = []
        self.of: dict[int, list[list[int]]] = {}

    def add(self, size: int, first: int, count: int) -> None:
        if size and count:
            if size not in self.of:
                bisect.insort(self.sizes, size)
                self.of[size] = []
            self.of[size].append([first, count])

    def take(self, size: int, most: int) -> tuple[int, int]:
        part = self.of[size][-1]
        n = min(part[1], most)
        first = part[0]
        part[0] += n
        part[1] -= n
        if not part[1]:
            self.of[size].pop()
            if not self.of[size]:
                del self.of[size]
                self.sizes.remove(size)
        return first, n

    def successor(self, length: int) -> int | None:
        k = bisect.bisect_left(self.sizes, length)
        return self.sizes[k] if k < len(self.sizes) else None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, per sequence, first offset), by length and rank.

    The document of rank k at or after the row's first rank is number k - first rank of that row: it goes
    to the sequence ``first + number // per`` at ``offset + (number % per) * length``.
    """
    gaps, plan, opened = Gaps(), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            size = gaps.successor(length)
            if size is None:
                size, new = capacity, -(-left // (capacity // length))
                gaps.add(capacity, opened, new)
                opened += new
            per = size // length  # equal documents follow each other into one gap
            first, n = gaps.take(size, -(-left // per))
            placed = min(left, n * per)
            plan.append((length, rank, first, per, capacity - size))
            full = placed // per
            gaps.add(size - per * length, first, full)
            if placed % per:
                gaps.add(size - (placed % per) * length, first + full, 1)
            rank, left = rank + placed, left - placed
    return np.array(plan, np.int64).reshape(-1, 5)


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) within each length, without gathering a length in one task."""
    bucket = F.pmod(F.xxhash64("rid", "th", "piece"), F.lit(BUCKETS))
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("length").orderBy("bucket")) - F.col("c")
    counts = counts.select("length", "bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("rid", "th", "piece", "start"))
    rows = rows.withColumn("within", within)
    return rows.join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("bucket", "before", "within")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    rows = materialise(pieces(docs, capacity, tokenizer), "pieces")
    # at most ``capacity`` rows
    counts = {r["length"]: r["c"] for r in rows.groupBy("length").agg(F.count("*").alias("c")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(best_fit_plan(counts, capacity))

    def place(batches):
        import pyarrow as pa

        table = plan.value
        if len(table):
            table = table[np.lexsort((table[:, 1], table[:, 0]))]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            if len(length):
                # ranks stay far below 2**48
                row = table[np.searchsorted(table[:, 0] * (1 << 48) + table[:, 1], length * (1 << 48) + rank, side="right") - 1]
                number = rank - row[:, 1]
                sequence, offset = row[:, 2] + number // row[:, 3], row[:, 4] + number % row[:, 3] * length
            else:
                sequence = offset = np.empty(0, np.int64)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    out = ranked(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return out.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
