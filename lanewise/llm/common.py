"""Shared helpers of the training-data operators: scratch tables in the cluster's
shared folder, Arrow text access, and vectorised 64-bit hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="lanewise-shared-")
    return _LOCAL_DIRS[app]


def bounded_batches(spark: SparkSession, rows: int = 2_000) -> SparkSession:
    """Whole texts make long rows: fewer of them at a time keep Python workers small.

    A session that has its own batch size keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
    return spark


def released(run):
    """``run`` for mapInArrow, giving memory back to the system when its task ends: workers serve many stages."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps what it has
                pass

    return wrapped


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lanewise/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lanewise_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_lanewise_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a few dozen bytes each; a side above this is joined by shuffle instead.
BROADCAST_ROWS = 200_000


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast when its counted rows are few; else Spark shuffles it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Ids alone take a few dozen bytes each in a broadcast; more are not broadcast.
BROADCAST_IDS = 4_000_000


def parted(rows: DataFrame, ids: DataFrame, n: int, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with one of the ``n`` ids, and those without, told apart where they lie: rows that no join needs are not shuffled.

    Ids beyond ``BROADCAST_IDS`` are not broadcast: then the first holds all rows, and there is no second.
    """
    if n > BROADCAST_IDS:
        return rows, None
    few = F.broadcast(ids.select(id_col).distinct())
    return rows.join(few, id_col, "left_semi"), rows.join(few, id_col, "left_anti")


def join_rows(rows: DataFrame, wanted: DataFrame, n: int, id_col: str) -> DataFrame:
    """Join wide ``rows`` with ``n`` narrow ones by id: by broadcast where those are few, else only rows that have a partner are shuffled."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted), id_col)
    return parted(rows, wanted, n, id_col)[0].join(wanted, id_col)


#: Groups that may hold more than this share of all rows are fewer than this many.
HOT_GROUPS = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", most: int = HOT_GROUPS) -> DataFrame:
    """Join ``rows`` with one row for each group, so that no task gathers a large group.

    ``groups`` says in ``c`` how many rows each has.  Fewer than ``most`` groups have over 1 / ``most``
    of all of them: those are broadcast, the others are joined by a shuffle.
    """
    limit = (groups.agg(F.sum("c")).first()[0] or 0) // most
    hot = F.broadcast(groups.where(F.col("c") > limit))
    large = rows.join(hot, keys)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col("c") <= limit), keys, how)
    return large.unionByName(rest)


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_id(id_col: str = "doc_id", text_col: str = "text"):
    """The id of a row; rows without one are told apart by their text."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))


# ---------------------------------------------------------------- hashing

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = (_RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)


@np.errstate(over="ignore")
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@np.errstate(over="ignore")
def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    filled = 1
    while filled < len(out):
        step = min(filled, len(out) - filled)
        out[filled : filled + step] = out[:step] * (out[filled - 1] * base)
        filled += step
    return out


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; null reads as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans_of(off: np.ndarray, most: int):
    """Row ranges [i, j) whose bytes come to about ``most``; one row may exceed it."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_POWERS_KEPT = 1 << 21


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        made = powers(base, max(n, (1 << 19) + 1))
        if n > _POWERS_KEPT:  # for one very long text only
            return made
        _POWERS[name] = made
    return _POWERS[name]


class Hashes:
    """Prefix polynomial hashes of a byte buffer; equal substrings have equal hashes."""

    def __init__(self, raw: np.ndarray, table: np.ndarray = BYTE):
        n = len(raw)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(table[raw] * _power_table("up", BASE, n + 1)[:n], out=self.prefix[1:])
        self.down = _power_table("down", _INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTE = BYTE[LOWER]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Every ASCII byte but letters and digits; bytes of multi-byte characters belong to words.
IS_PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_spans(raw: np.ndarray, off: np.ndarray, apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words between ``apart`` bytes; by default ``[^\\x20\\x09-\\x0D]+``."""
    if not len(raw):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    inside = ~apart[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = off[:-1][off[:-1] < off[1:]]
    first[edges] = inside[edges]
    last[edges[1:] - 1] = inside[edges[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))


@np.errstate(over="ignore")
def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ASCII-lower-cased words of each row, and the row of each."""
    starts, ends, row = word_spans(raw, off)
    return mix(Hashes(raw, LOWER_BYTE).of(starts, ends) + (ends - starts).astype(np.uint64) * _ODD[0]), row


@np.errstate(over="ignore")
def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``width``-word shingle hashes of each row: row i has flat[first[i] : first[i + 1]].

    A row with fewer words has its whole sequence as one shingle; one without words, none.
    """
    words, row = word_hashes(raw, off)
    n = len(off) - 1
    counts = np.bincount(row, minlength=n)
    begin = np.concatenate([[0], np.cumsum(counts)])
    grams = max(len(words) - width + 1, 0)
    value = np.zeros(len(words), np.uint64)
    for k in range(width):
        value[:grams] += words[k : k + grams] * _ODD[8 + k % 48]
    value = mix(value)
    short = np.flatnonzero((counts > 0) & (counts < width))
    for i in short.tolist():
        a, b = begin[i], begin[i + 1]
        total = (words[a:b] * _ODD[8 : 8 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a) * _ODD[1]
        value[a] = mix(np.array([total], np.uint64))[0]
    size = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    place = np.concatenate([[0], np.cumsum(size)])
    flat = value[np.arange(place[-1]) + np.repeat(begin[:-1] - place[:-1], size)]
    for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
        flat[a:b].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[place[:-1][size > 0]] = True
    return flat[fresh], np.concatenate([[0], np.cumsum(fresh)])[place]
