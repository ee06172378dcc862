"""N-gram Jaccard join with signature trees.

Links every two documents whose sets of word shingles have Jaccard similarity of at least
``num/den`` and returns the connected components.  Nothing is sampled or capped.

1. Each text becomes a set of 64-bit shingle hashes; equal sets share one 64-bit set id, so
   exact copies cost one node however many there are.
2. Blocking without loss, by two kinds of keys.  Sets within the bound differ in at most H shingles, H known from
   the size of either.  The hash range is cut into parts; a set with more than H parts that hold shingles has one
   in common with any partner, so the hash of a part's content is a key.  Passages that many documents share
   would make equal parts, so parts hold rare shingles only, which changes nothing in the argument.
   Sets left with too few parts have their first ``n - ceil(n * num / den) + 1`` shingles as keys, too, rare ones first;
   two such sets share one.  How often a shingle occurs comes from a sketch of counters over all
   texts (at most 2**SKETCH bytes once reduced to levels); any numbers are lossless, coarse
   ones only make more candidates.  Of each KEYS rows of a task, a key shared by k sets becomes
   k - 1 candidate edges and one row that goes to the shuffle, so a hot key costs few rows a task.
3. Components of the candidate edges are closed under links.  If many sets lie in clusters of several
   pages, those sets alone are counted and blocked again, cluster by cluster: with fewer shingles the counters
   tell common from rare ones better.  What stays wide are mostly real groups.
4. The sets of a cluster travel once, dealt to pages of bounded number and bytes.  A cluster of several
   pages is first cut into bands of set sizes, of which only a band and its neighbours can hold links.
5. In a page a signature tree is built: nodes hold OR-combined shingle bitmaps, size ranges and
   the most shingles that share a bit.  A dual traversal drops node pairs whose greatest
   possible overlap is too small, and pairs that are already connected; the rest is verified
   on the sets themselves.
6. Wide clusters go on in rounds: one set of each part found so far is dealt to pages again, until that
   joins no more.  Clusters that are not yet one component are completed by page pairs:
   rows outside the cluster's largest component against all rows of their band and its neighbours.

Defined cases: null or word-less text has an empty set, size 0, links to nothing and is its
own component; fewer words than the width form one shingle; repeated rows and ids are kept as
rows and link like any equal sets (a null id joins no component's name); an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import join_groups, join_rows, materialise, mix, parted, release, released, row_id, shingle_sets, spans_of, text_buffers
from lanewise.llm.graph import ONE_TASK, components

CHUNK = 512 << 10
KEYS = 1 << 18  # settled within a task at once
PAGE = 512
PAGE_SHINGLES = 4 << 20
FANOUT = 8
SPARE = 3
#: Counters of the sketch: a power of two between these, by the number of shingles; dealt in blocks.
SKETCH_LEAST, SKETCH = 16, 24
COUNTERS = 4096
#: Sets in wide clusters from which on they are counted and blocked again, and how often at most.
AGAIN_ROWS, AGAIN = 20_000, 3


@np.errstate(over="ignore")
def set_ids(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit ids of sets flat[first[i] : first[i + 1]]; 0 for an empty set."""
    size = np.diff(first)
    total = np.zeros(len(size), np.uint64)
    some = size > 0
    if some.any():
        total[some] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[:-1][some])
    out = mix(total + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return np.where(some, out, 0)


class Blocking:
    """Keys of which two sets within the bound share at least one.

    ``levels`` says how common the shingles of a counter are; those above ``common`` make no parts.
    """

    def __init__(self, num: int, den: int, levels: np.ndarray, common: int = 255):
        self.num, self.den, self.levels, self.common = num, den, levels, common
        self.shift = np.uint64(64 - int(np.log2(len(levels))))
        # sets of a class and those a little smaller than it share keys; classes are wider than the bound
        ratio, self.bounds = max(1.5, 1.2 * den / num), [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, math.ceil(self.bounds[-1] * ratio)))
        self.bounds = np.array(self.bounds)
        differ = (self.bounds[1:] - 1) * (den - num) // num
        # any number of parts is lossless; with a tenth more than may differ, few sets have too few that hold shingles
        self.parts = np.where(differ == 0, 1, differ + differ // 10 + SPARE)

    @np.errstate(over="ignore")
    def _scheme(self, flat, level, size, c):
        """(keys, set of each) when set i of ``size[i]`` shingles follows scheme ``c[i]``."""
        every = np.repeat(np.arange(len(size)), size)
        rare = level <= self.common
        kept, owner = flat[rare], every[rare]
        scheme = (c + 1).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        part = ((kept >> np.uint64(32)) * self.parts[c[owner]].astype(np.uint64)) >> np.uint64(32)
        fresh = np.ones(len(kept), bool)
        fresh[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(fresh)
        total = np.add.reduceat(mix(kept + np.uint64(0x27D4EB2F165667C5)), at) if len(at) else kept
        part, owner = part[at], owner[at]
        key = mix(total + part * np.uint64(0xC2B2AE3D27D4EB4F) + scheme[owner])
        poor = np.bincount(owner, minlength=len(size)) <= size * (self.den - self.num) // self.num
        if not poor.any():
            return key, owner
        few = poor[every]
        token = (level[few].astype(np.uint64) << np.uint64(56)) | (flat[few] >> np.uint64(8))
        of = every[few]
        order = np.lexsort((token, of))
        begin = np.cumsum(np.where(poor, size, 0)) - np.where(poor, size, 0)
        place = np.arange(len(of)) - begin[of]  # ``of`` is sorted already
        # a set of n has an overlap of at least n * num / den with any set within the bound
        first = place < (size - -(-size * self.num // self.den) + 1)[of]
        token, of = token[order][first], of[first]
        return np.concatenate([key, mix((token ^ np.uint64(0x9E3779B97F4A7C15)) + scheme[of])]), np.concatenate([owner, of])

    @np.errstate(over="ignore")
    def keys(self, flat: np.ndarray, first: np.ndarray, salt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(keys, number of the set of each) over sets flat[first[i] : first[i + 1]]; ``salt`` keeps sets apart."""
        size = np.diff(first)
        rows = np.flatnonzero(size)
        if not len(rows):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        size = size[rows]
        level = self.levels[(mix(flat) >> self.shift).astype(np.int64)]
        c = np.searchsorted(self.bounds, size, side="right") - 1
        key, owner = self._scheme(flat, level, size, c)
        # sets that may have a partner in the next class follow that scheme, too
        up = np.flatnonzero(size * self.den >= self.bounds[c + 1] * self.num)
        if len(up):
            inside = np.zeros(len(size), bool)
            inside[up] = True
            inside = np.repeat(inside, size)
            more, also = self._scheme(flat[inside], level[inside], size[up], c[up] + 1)
            key, owner = np.concatenate([key, more]), np.concatenate([owner, up[also]])
        owner = rows[owner]
        if salt is not None:
            key = mix(key ^ salt.view(np.uint64)[owner])
        return key, owner


def star_edges(keys: np.ndarray, ids: np.ndarray):
    """Of (key, id) rows: the first (key, least id) of each key, and edges (least id, id)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    head = ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(keys) else ids
    other = head != ids
    pairs = np.unique(np.stack([head[other], ids[other]], 1), axis=0) if other.any() else np.empty((0, 2), np.int64)
    return keys[fresh], ids[fresh], pairs


def _sets_of(batch, name: str, width: int):
    raw, off = text_buffers(batch.column(name))
    for i, j in spans_of(off, CHUNK):
        flat, first = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], width)
        yield i, j, flat, first


def _measure(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            size, ids = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j, flat, first in _sets_of(batch, "text", width):
                size[i:j] = np.diff(first)
                ids[i:j] = set_ids(flat, first)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rid", "doc_id", "th")), pa.array(size), pa.array(ids, mask=size == 0)], ["rid", "doc_id", "th", "n", "sig"]
            )

    return run


@np.errstate(over="ignore")
def _block_rows(keys: list[np.ndarray], owner: list[np.ndarray]):
    import pyarrow as pa

    key, sig, pairs = star_edges(np.concatenate(keys).view(np.int64), np.concatenate(owner))
    link = mix(pairs[:, 0].copy().view(np.uint64) * np.uint64(3) + mix(pairs[:, 1].copy().view(np.uint64))).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([key, link, link])), pa.array(np.concatenate([sig, pairs[:, 0], pairs[:, 1]]))], ["key", "sig"]
    )


def _wanted(batch, i: int, j: int, flat: np.ndarray, first: np.ndarray):
    """The sets of rows [i, j) and their ids; where the batch says which set it wants, other sets are emptied."""
    ids = set_ids(flat, first)
    if "sig" in batch.schema.names:
        size = np.where(ids == batch.column("sig").to_numpy()[i:j], np.diff(first), 0)
        flat, first = flat[np.repeat(size > 0, np.diff(first))], np.concatenate([[0], np.cumsum(size)])
    return flat, first, ids


def _count(width: int, bits: int):
    """(block, counters): how many sets of the task hold the shingles of each counter."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for i, j, flat, first in _sets_of(batch, "text", width):
                flat, _, _ = _wanted(batch, i, j, flat, first)
                at, n = np.unique((mix(flat) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, 65_535)
        blocks = counts.reshape(-1, COUNTERS)
        some = np.flatnonzero(blocks.any(1))
        for k in range(0, len(some), 512):
            part = some[k : k + 512]
            # a counter of one task stops at 255: it is among the common ones then
            data = [pa.compress(np.minimum(blocks[x], 255).astype(np.uint8).tobytes(), codec="zstd", asbytes=True) for x in part.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(data, pa.binary())], ["block", "counters"])

    return run


def _levels(batches):
    """Counters of all tasks, added up and reduced to eight levels an octave."""
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("counters").to_pylist(), strict=True):
            part = np.frombuffer(pa.decompress(data, COUNTERS, codec="zstd", asbytes=True), np.uint8)
            total[block] = total.get(block, 0) + part.astype(np.int64)
    data = [np.minimum(255, np.rint(8 * np.log2(1 + x))).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(data, pa.binary())], ["block", "levels"])


def sketch(texts: DataFrame, width: int, shingles: int) -> tuple[np.ndarray, int]:
    """Levels of how common shingles are, one byte a counter, and the level above which one is common.

    At most 2**SKETCH bytes come to the driver.  A counter holds shingles / counters by chance; common is what lies
    clearly above that.
    """
    bits = min(SKETCH, max(SKETCH_LEAST, (shingles // 8).bit_length()))
    found = texts.mapInArrow(released(_count(width, bits)), "block int, counters binary").repartition("block").mapInArrow(released(_levels), "block int, levels binary")
    levels = np.zeros((1 << bits) // COUNTERS * COUNTERS, np.uint8)
    for row in found.collect():
        levels[row["block"] * COUNTERS : (row["block"] + 1) * COUNTERS] = np.frombuffer(row["levels"], np.uint8)
    chance = shingles / (1 << bits)
    return levels, int(8 * math.log2(5 + chance + 3 * math.sqrt(chance)))


def _block(width: int, num: int, den: int, levels, common: int):
    def run(batches):
        blocking = Blocking(num, den, levels.value, common)
        for batch in batches:
            keys, owner, held = [], [], 0
            salt = batch.column("cluster").to_numpy() if "cluster" in batch.schema.names else None
            for i, j, flat, first in _sets_of(batch, "text", width):
                flat, first, ids = _wanted(batch, i, j, flat, first)
                key, of = blocking.keys(flat, first, None if salt is None else salt[i:j])
                keys.append(key)
                owner.append(ids[of])
                held += len(key)
                if held > KEYS:
                    yield _block_rows(keys, owner)
                    keys, owner, held = [], [], 0
            if keys:
                yield _block_rows(keys, owner)

    return run


def _reduce(batches):
    """Rows sorted by (key, sig): edges from the least set of each key to its others."""
    import pyarrow as pa

    key, head = None, 0
    for batch in batches:
        keys, ids = batch.column("key").to_numpy(), batch.column("sig").to_numpy()
        if not len(keys):
            continue
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        fresh[0] = key is None or keys[0] != key
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))
        heads = np.where(at >= 0, ids[at], head)
        key, head = keys[-1], heads[-1]
        other = heads != ids
        pairs = np.unique(np.stack([heads[other], ids[other]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _clusters(texts: DataFrame, width: int, num: int, den: int, shingles: int, one_task: int) -> DataFrame:
    """(sig, cluster): sets that may be linked, by candidate edges; columns sig and cluster of ``texts``
    choose sets and keep clusters apart."""
    levels, common = sketch(texts, width, shingles)
    shared = texts.sparkSession.sparkContext.broadcast(levels)
    keys = texts.mapInArrow(released(_block(width, num, den, shared, common)), "key long, sig long")
    near = keys.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(released(_reduce), "a long, b long")
    return components(near, "near", one_task).withColumnRenamed("node", "sig").withColumnRenamed("component", "cluster")


def _fetch(width: int):
    """Sets of the wanted rows, once per page they belong to; other rows of that id are passed over."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            want, place = batch.column("sig").to_numpy(), batch.column("places")
            for i, j, flat, first in _sets_of(batch, "text", width):
                out: list[list] = [[], [], [], [], []]
                found = set_ids(flat, first)
                for k in range(i, j):
                    a, b = first[k - i], first[k - i + 1]
                    if b > a and found[k - i] == want[k]:
                        blob = flat[a:b].tobytes()
                        for p in place[k].as_py():
                            for column, value in zip(out, (p["page"], p["side"], p["comp"], want[k], blob), strict=True):
                                column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["page", "side", "comp", "sig", "body"])

    return run


class Tree:
    """A signature tree over sets: level 0 has the sets, each level above groups FANOUT nodes."""

    def __init__(self, sets: list[np.ndarray], words: int):
        self.sets = sets
        low = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), words), np.uint64)
        for row, s in zip(maps, sets, strict=True):
            bits = np.zeros(64 * words, bool)
            bits[(s & np.uint64(64 * words - 1)).astype(np.int64)] = True
            row[:] = np.packbits(bits, bitorder="little").view(np.uint64)
        slack = low - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, low, low, slack)]
        while len(low) > 1:
            cut = np.arange(0, len(low), FANOUT)
            maps, low = np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut)
            high, slack = np.maximum.reduceat(self.levels[-1][2], cut), np.maximum.reduceat(slack, cut)
            self.levels.append((maps, low, high, slack))


def links_between(left: Tree, right: Tree, same: bool, comp: np.ndarray, first_right: int, num: int, den: int) -> list[tuple[int, int]]:
    """Dual traversal: verified links (i, j) that join two components.  ``comp`` holds a
    union-find over the rows of both trees; those of ``right`` start at ``first_right``."""

    def root(i: int) -> int:
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    def span(tree: Tree, level: int, k: int) -> range:
        step = FANOUT**level
        return range(k * step, min((k + 1) * step, len(tree.sets)))

    out, stack = [], [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        if la == 0 and lb == 0:
            i, j = a, first_right + b
            if i == j or root(i) == root(j):
                continue
            s, t = left.sets[a], right.sets[b]
            both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
            if den * both >= num * (len(s) + len(t) - both):
                out.append((i, j))
                comp[root(j)] = root(i)
            continue
        # descend the higher side; its children are tested against the other node at once
        if la >= lb:
            la, kids = la - 1, np.arange(a * FANOUT, min((a + 1) * FANOUT, len(left.levels[la - 1][1])))
            ka, kb = kids, np.full(len(kids), b)
        else:
            lb, kids = lb - 1, np.arange(b * FANOUT, min((b + 1) * FANOUT, len(right.levels[lb - 1][1])))
            ka, kb = np.full(len(kids), a), kids
        (ma, na, xa, sa), (mb, nb, xb, sb) = left.levels[la], right.levels[lb]
        most = np.bitwise_count(ma[ka] & mb[kb]).sum(1).astype(np.int64) + np.minimum(sa[ka], sb[kb])
        most = np.minimum(most, np.minimum(xa[ka], xb[kb]))
        keep = (num + den) * most >= num * (na[ka] + nb[kb])
        keep &= (den * xb[kb] >= num * na[ka]) & (den * xa[ka] >= num * nb[kb])
        for p, q in zip(ka[keep].tolist(), kb[keep].tolist(), strict=True):
            if same and la == lb and p > q:
                continue
            if la + lb and (la or lb):
                rows = {root(i) for i in span(left, la, p)}
                if len(rows) == 1 and rows == {root(first_right + j) for j in span(right, lb, q)}:
                    continue
            stack.append((la, p, lb, q))
    return out


def _link(num: int, den: int):
    """Links within each page (side 0 only) or between the sides of a page pair."""

    def page(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = list({(r[0], r[2]): r for r in rows}.values())
        side = [[r for r in rows if r[0] == k] for k in (0, 1)]
        for part in side:
            part.sort(key=lambda r: (len(r[3]), r[3][:64]))
        mine = side[0] + side[1]
        if not mine:
            return []
        # eight bits for each shingle of the largest set: few share one
        words = 1 << min(10, max(4, (max(len(r[3]) for r in mine) // 64 - 1).bit_length()))
        trees = [Tree([np.frombuffer(r[3], np.uint64) for r in part], words) for part in side if part]
        comp, known = np.arange(len(mine)), {}
        for k, r in enumerate(mine):  # rows that are connected already; a row on both sides is one
            for name in ((0, r[1]) if r[1] is not None else None, (1, r[2])):
                if name:
                    a, b = known.setdefault(name, k), k
                    while comp[a] != a:
                        a = comp[a]
                    while comp[b] != b:
                        b = comp[b]
                    comp[max(a, b)] = min(a, b)
        if side[1] and side[0]:
            found = links_between(trees[0], trees[1], False, comp, len(side[0]), num, den)
        elif side[1]:
            found = []
        else:
            found = links_between(trees[0], trees[0], True, comp, 0, num, den)
        return [(mine[i][2], mine[j][2]) for i, j in found]

    def run(batches):
        import pyarrow as pa

        now, rows, a, b = None, [], [], []

        def flush():
            for x, y in page(rows):
                a.append(x)
                b.append(y)
            rows.clear()

        for batch in batches:
            for p, side, comp, sig, body in zip(*(batch.column(c).to_pylist() for c in ("page", "side", "comp", "sig", "body")), strict=True):
                if p != now:
                    flush()
                    now = p
                rows.append((side, comp, sig, body))
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _place(p, side, comp):
    return F.struct(p.alias("page"), F.lit(side).alias("side"), comp.cast("long").alias("comp"))


def _pages(page: int):
    """Pages that a group of sets needs, by number and bytes."""
    return F.ceil(F.sum(F.greatest(F.lit(1 / page), F.col("n") / F.lit(float(PAGE_SHINGLES)))) - 1e-9).cast("long")


class _Join:
    """The steps of one join over one table of texts."""

    def __init__(self, docs: DataFrame, sets: DataFrame, width: int, num: int, den: int, page: int, one_task: int):
        self.docs, self.sets, self.width, self.num, self.den, self.page, self.one_task = docs, sets, width, num, den, page, one_task

    def linked(self, dealt: DataFrame, places: int) -> DataFrame:
        """Links found in the pages that ``places`` of (rid, sig, places) rows name."""
        got = join_rows(self.docs, dealt.select("rid", "sig", "places"), places, "rid")
        rows = got.select("text", "sig", "places").mapInArrow(released(_fetch(self.width)), "page long, side int, comp long, sig long, body binary")
        return materialise(rows.repartition("page").sortWithinPartitions("page").mapInArrow(released(_link(self.num, self.den)), "a long, b long"), "links")

    def parts(self, links: DataFrame) -> DataFrame:
        return components(links, "linked", self.one_task).withColumnRenamed("node", "sig").withColumnRenamed("component", "part")

    def members(self, shingles: int) -> tuple[DataFrame, int]:
        """(sig, cluster, rid, n, wide) of all sets with candidates, and how many are in wide clusters."""
        cluster, done, before = _clusters(self.docs.select("text"), self.width, self.num, self.den, shingles, self.one_task), [], None
        for again in range(AGAIN + 1):
            rows = materialise(cluster.join(self.sets.select("sig", "rid", "n"), "sig"), "rows")
            size = materialise(rows.groupBy("cluster").agg(_pages(self.page).alias("pages"), F.count("*").alias("c")), "sizes")
            member = materialise(join_groups(rows, size, ["cluster"]).withColumn("wide", F.col("pages") > 1).drop("pages", "c"), "member")
            release(rows, size)
            wide = member.where("wide")
            state = wide.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()
            if again == AGAIN or state["c"] < AGAIN_ROWS or (before is not None and state["c"] > before // 2):
                done.append(member)
                break
            done.append(member.where("not wide"))
            before = state["c"]
            texts = join_rows(self.docs, wide.select("rid", "sig", "cluster"), state["c"], "rid").select("text", "sig", "cluster")
            cluster = _clusters(texts, self.width, self.num, self.den, state["n"], self.one_task)
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out, state["c"]

    def run(self, shingles: int) -> DataFrame:
        """(sig, part) of all linked sets."""
        member, n_wide = self.members(shingles)
        # linked sets differ in size by den / num at most: their bands are the same or neighbours
        band = F.when(F.col("wide"), F.floor(F.ln(F.col("n").cast("double")) / math.log(self.den / self.num) + 1e-9).cast("int")).otherwise(0)
        page = F.xxhash64("cluster")
        first = member.where("not wide").withColumn("places", F.array(_place(page, 0, F.lit(None))))
        if n_wide:
            wide = member.where("wide").withColumn("band", band)
            cells = materialise(wide.groupBy("cluster", "band").agg(_pages(self.page).alias("pages"), F.count("*").alias("c")), "cells")
            wide = materialise(join_groups(wide, cells, ["cluster", "band"]).drop("c"), "wide")
            page = F.xxhash64("cluster", "band", F.pmod(F.xxhash64("sig"), "pages"))
            first = first.drop("wide").unionByName(wide.select("sig", "cluster", "rid", "n", F.array(_place(page, 0, F.lit(None))).alias("places")))
        links = self.linked(first, member.count())
        part = self.parts(links)
        if n_wide:
            links, part = self.by_parts(wide, links, part)
            part = self.complete(wide, links, part)
        return part

    def labelled(self, wide: DataFrame, part: DataFrame) -> DataFrame:
        state = wide.select("cluster", "band", "sig", "rid", "n").join(part, "sig", "left")
        return state.withColumn("part", F.coalesce("part", "sig"))

    def by_parts(self, wide: DataFrame, links: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links between one set each of the parts of wide clusters, in rounds of pages."""
        before = None
        while True:
            state = self.labelled(wide, part)
            one = state.groupBy("cluster", "part").agg(F.min(F.struct("sig", "rid", "n")).alias("one")).select("cluster", "part", "one.*")
            one = materialise(one, "one")
            size = materialise(one.groupBy("cluster").agg(_pages(self.page).alias("pages"), F.count("*").alias("c")).where("c > 1"), "sizes")
            n = size.agg(F.sum("c")).first()[0] or 0
            if not n or (before is not None and n > before // 2):
                return links, part
            before = n
            page = F.xxhash64(F.lit("parts"), "cluster", F.pmod(F.xxhash64("sig", F.lit(n)), "pages"))
            dealt = join_groups(one, size, ["cluster"]).withColumn("places", F.array(_place(page, 0, F.lit(None))))
            links = links.unionByName(self.linked(dealt, n))
            part = self.parts(links)
            release(one, size)

    def complete(self, wide: DataFrame, links: DataFrame, part: DataFrame) -> DataFrame:
        """Links between pages of clusters that are not one component yet."""
        state = self.labelled(wide, part)
        main = state.groupBy("cluster", "part").agg(F.count("*").alias("c"))
        main = main.groupBy("cluster").agg(F.max(F.struct("c", "part"))["part"].alias("main"), F.count("*").alias("parts"), F.sum("c").alias("c"))
        main = materialise(main.where("parts > 1"), "main")
        if main.isEmpty():
            return part
        state = materialise(join_groups(state, main, ["cluster"]).drop("c", "parts").withColumn("outer", F.col("part") != F.col("main")), "open")
        pages = [F.coalesce(_pages(self.page), F.lit(0)).alias("a"), F.count("*").alias("c")]
        cell = state.groupBy("cluster", "band").agg(*pages)
        cell = cell.join(state.where("outer").groupBy("cluster", "band").agg(_pages(self.page).alias("o")), ["cluster", "band"], "left")
        # a cluster has a few dozen bands at most
        cells = cell.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("o", "a")))).alias("cells"), F.sum("c").alias("c"))
        open_rows = join_groups(state, materialise(cells, "cells"), ["cluster"])
        hashed, none = F.xxhash64("sig"), F.lit(0).cast("long")

        def count(name: str, at):
            return F.coalesce(F.try_element_at("cells", at)[name], none)

        def to_pages(at, name: str, key):
            return F.transform(F.filter(F.sequence(none, count(name, at)), lambda k: k < count(name, at)), key)

        left, right = [], []
        for step in (-1, 0, 1):
            other = F.col("band") + step
            mine, his = (F.pmod(hashed, F.greatest(count(name, F.col("band")), F.lit(1))) for name in ("o", "a"))
            left.append(to_pages(other, "a", partial(_pair, 0, "band", mine, other)))
            right.append(to_pages(other, "o", partial(_pair_back, 1, other, "band", his)))
        places = F.when(F.col("outer"), F.concat(*left, *right)).otherwise(F.concat(*right))
        dealt = materialise(open_rows.withColumn("places", places).where(F.size("places") > 0).select("rid", "sig", "places"), "dealt")
        # a row's size is that of its places: their number decides whether the table is small
        more = self.linked(dealt, dealt.agg(F.sum(F.size("places"))).first()[0] or 0)
        release(dealt, state, main)
        return self.parts(links.unionByName(more))


def _pair(side, band, mine, other, j):
    return _place(F.xxhash64("cluster", band, mine, other, j), side, F.col("part"))


def _pair_back(side, other, band, his, i):
    return _place(F.xxhash64("cluster", other, i, band, his), side, F.col("part"))


def _grouped(docs: DataFrame, width: int, num: int, den: int, page: int, one_task: int) -> tuple[DataFrame, DataFrame]:
    """(measured, names): all rows, and of the sets that have copies or links: sig, part, component,
    the least row ``k`` of the part and the number ``c`` of its rows."""
    measured = materialise(docs.mapInArrow(released(_measure(width)), "rid long, doc_id long, th long, n long, sig long"), "sets")
    sets = measured.where("n > 0").groupBy("sig").agg(
        F.min("rid").alias("rid"), F.min("n").alias("n"), F.min("doc_id").alias("component"), F.min(F.struct("rid", "th")).alias("k"), F.count("*").alias("c")
    )
    sets = materialise(sets, "distinct")
    shingles = sets.agg(F.sum(F.col("n") * F.col("c"))).first()[0] or 0
    part = _Join(docs, sets, width, num, den, page, one_task).run(shingles)
    linked = materialise(sets.join(part, "sig"), "labelled")
    groups = linked.groupBy("part").agg(F.min("component").alias("component"), F.min("k").alias("k"), F.count("*").alias("sets")).withColumnRenamed("sets", "c")
    names = join_groups(linked.select("sig", "part", F.col("c").alias("rows")), materialise(groups, "groups"), ["part"]).select(
        "sig", "part", "component", "k", F.col("rows").alias("c")
    )
    copies = sets.where("c > 1").join(linked.select("sig"), "sig", "left_anti")
    names = names.unionByName(copies.select("sig", F.col("sig").alias("part"), "component", "k", "c"))
    return measured, materialise(names, "names")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        row_id(id_col, text_col).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")
    )


def ngram_jaccard_join(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", page: int = PAGE, one_task: int = ONE_TASK) -> DataFrame:
    """One row per input row: rid, doc_id, th (text hash), n (set size), sig (set id), part, component.

    Two rows link when den * intersection >= num * union of their shingle sets.  ``rid`` is
    the id, or a hash of the text where that is null.  ``part`` tells components apart, ``component`` is
    the least id in it (two components share that name only if rows of one id lie in both).
    """
    measured, names = _grouped(_slim(docs, id_col, text_col), width, num, den, page, one_task)
    out = join_groups(measured, names, ["sig"], "left")
    part, component = F.coalesce("part", "sig").alias("part"), F.coalesce("component", "doc_id").alias("component")
    return out.select("rid", "doc_id", "th", "n", "sig", part, component)


def keep_one(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", page: int = PAGE, one_task: int = ONE_TASK) -> DataFrame:
    """The rows of ``docs``, one of each component: the least (id, text hash) stays; of
    several rows with that id and text, the first by its columns.

    Null, empty and word-less texts have no links and stay; of equal rows one stays, unless they are empty; an
    empty table stays empty; all columns stay, whatever their names.
    """
    measured, names = _grouped(_slim(docs, id_col, text_col), width, num, den, page, one_task)
    # only rows with copies or links can go
    said = join_groups(measured, names, ["sig"]).select("rid", "th", (F.struct("rid", "th") == F.col("k")).alias("keep"))
    said = materialise(said.groupBy("rid", "th").agg(F.max("keep").alias("keep"), F.count("*").alias("c")), "kept")
    rows = docs.select(F.struct("*").alias("row"), row_id(id_col, text_col).alias("rid"), F.xxhash64(text_col).alias("th"))
    rows, others = parted(rows, said, said.count(), "rid")
    marked = join_groups(rows, said, ["rid", "th"], "left")
    alone = marked.where("keep is null or (keep and c = 1)")
    again = marked.where("keep and c > 1").groupBy("rid", "th").agg(F.min_by("row", F.to_json("row")).alias("row"))
    out = alone.select("row.*").unionByName(again.select("row.*"))
    return out if others is None else others.select("row.*").unionByName(out)
