"""Exact repeated-substring removal by a hash-compared suffix sort.

A byte goes when some ``LENGTH``-byte string that covers it also starts anywhere else: in another
document or at another place of the same one.  Strings are judged on the input.

1. Every LENGTH-byte string picks one anchor: the leftmost of its GRAM-byte substrings with the
   least hash.  Equal strings pick the same anchor at the same offset, so only strings with
   equal anchors need to meet.  Consecutive strings with one anchor form a run.
2. Runs are dealt out by their anchor's hash and told apart by a BLAKE2b digest of their bytes, so runs count as equal only
   if their bytes are.  Runs with the same content within an Arrow batch
   are settled there and send one row on, so a passage of a third of all rows costs a row a batch.
   Equal runs are repeated throughout; an anchor with one run only is not repeated at all.
3. What is left are anchors with different runs: edges of repeated passages.  One copy of each such
   run brings its surroundings.  Per block, the suffixes that start at the anchors are put in order
   by a mergesort whose comparisons find the common extension by binary search over prefix
   polynomial hashes; likewise the prefixes that end there.  Neighbours have the longest common
   extensions on either side; those are verified on the bytes, as is the order of neighbours, and a class in which a
   collision shows is compared as bytes.  Where the longest left
   and right extensions come from different neighbours, the strings in doubt are compared as bytes.
4. An anchor with more than CLASS different runs is not sorted in one task: its strings are dealt
   out singly, by a 128-bit digest of their own.

Defined cases: null text is empty; a text below LENGTH bytes keeps all; repeated rows count as
occurrences of each other; rows without an id are told apart by their text; an empty table
gives an empty result; removal may cut a multi-byte character, whose rest ``without_repeats``
drops from its text (the digest of ``repeat_digest`` is over the bytes).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import Hashes, mix, released, row_id, spans_of, text_buffers

LENGTH = 200
GRAM = 50
CLASS = 20_000
CHUNK = 512 << 10
BLOCK = 2 << 20
FULL, SHIP, BIG = 1, 2, 4


def _digests(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> bytes:
    """BLAKE2b digests of raw[lo:hi], one after the other."""
    view, make = memoryview(np.ascontiguousarray(raw)), hashlib.blake2b
    return b"".join([make(view[a:b], digest_size=size).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])


class Runs:
    """Runs of a chunk of texts: arrays row, anchor, lo, hi (first and last start), h and r.

    ``h`` is the polynomial hash of the anchor, of which ``bits`` are kept; ``r`` is a digest of the run's bytes, which with the
    place of the anchor and the number of strings tells runs of one anchor apart.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, length: int, gram: int, bits: int = 64):
        empty = np.empty(0, np.int64)
        self.row = self.anchor = self.lo = self.hi = empty
        self.h = self.r = np.empty(0, np.uint64)
        sizes = np.diff(off)
        long_rows = np.flatnonzero(sizes >= length)
        if not len(long_rows):
            return
        self.hashes = hashes = Hashes(raw)
        grams = len(raw) - gram + 1
        value = mix((hashes.prefix[gram:] - hashes.prefix[:grams]) * hashes.down[:grams])
        low = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
        window, width = length - gram + 1, 1
        while width * 2 <= window:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if width < window:
            low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
        counts = sizes[long_rows] - length + 1
        begin = np.concatenate([[0], np.cumsum(counts)])
        start = np.arange(begin[-1]) + np.repeat(off[long_rows] - begin[:-1], counts)
        anchor = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fresh = np.ones(len(start), bool)
        fresh[1:] = anchor[1:] != anchor[:-1]
        fresh[begin[:-1]] = True
        first = np.flatnonzero(fresh)
        last = np.concatenate([first[1:], [len(start)]]) - 1
        self.anchor, self.lo, self.hi = anchor[first], start[first], start[last]
        self.row = np.repeat(long_rows, counts)[first]
        self.h = value[self.anchor] >> np.uint64(64 - bits)
        shape = ((self.anchor - self.lo) * 1024 + (self.hi - self.lo)).astype(np.uint64)
        self.r = np.frombuffer(_digests(raw, self.lo, self.hi + length, 8), np.uint64) ^ mix(shape)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _groups(*keys: np.ndarray):
    """Order by the keys (first is major), and the group number of each row in that order."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(fresh)


def _anchors(length: int, gram: int, bits: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, off = text_buffers(batch.column("text"))
            rid, th = batch.column("rid").to_numpy(), batch.column("th").to_numpy()
            parts: list[list[np.ndarray]] = [[], [], []]
            for i, j in spans_of(off, CHUNK):
                found = Runs(raw[off[i] : off[j]], off[i : j + 1] - off[i], length, gram, bits)
                for part, x in zip(parts, (found.h, found.r, found.row + i), strict=True):
                    part.append(x)
            if not parts[0]:
                continue
            h, r, row = (np.concatenate(p) for p in parts)
            if not len(h):
                continue
            order, group = _groups(h, r)
            h, r, row = h[order], r[order], row[order]
            size = np.bincount(group)
            first = np.ones(len(h), bool)
            first[1:] = group[1:] != group[:-1]
            n = np.where(first, np.minimum(size[group], 2), 0).astype(np.int32)
            # of later copies in this batch each text needs only one row to be told
            again = ~first
            again[1:] &= row[1:] != row[:-1]
            keep = first | again
            h, r, row, n = h[keep], r[keep], row[keep], n[keep]
            route = np.where(n > 0, _signed(h), rid[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (route, _signed(h), _signed(r), rid[row], th[row], n)], ["route", "h", "r", "rid", "th", "n"]
            )

    return run


def _settle(limit: int):
    """Rows sorted by (h, r): says which runs are repeated, and which must bring surroundings."""
    names = ["h", "r", "rid", "th", "n"]

    def flags(cols, big: bool):
        h, r, n = cols["h"], cols["r"], cols["n"]
        fresh_h, fresh_r = np.ones(len(h), bool), np.ones(len(h), bool)
        fresh_h[1:] = h[1:] != h[:-1]
        fresh_r[1:] = fresh_h[1:] | (r[1:] != r[:-1])
        of_r, of_h = np.cumsum(fresh_r) - 1, np.cumsum(fresh_h) - 1
        full = np.bincount(of_r, n)[of_r] >= 2
        kinds = np.bincount(of_h, fresh_r)[of_h]
        ship = fresh_r & ((kinds > 1) | big)
        return (full * FULL + ship * (SHIP + BIG * big)).astype(np.int32)

    def run(batches):
        import pyarrow as pa

        held, big = None, None

        def out(cols, flag):
            keep = flag > 0
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[c][keep]) for c in ("rid", "th", "h", "r")] + [pa.array(flag[keep])], ["rid", "th", "h", "r", "flag"]
            )

        def cut(cols, a, b):
            return {c: v[a:b] for c, v in cols.items()}

        for batch in batches:
            cols = {c: batch.column(c).to_numpy() for c in names}
            told = cols["n"] == 0
            if told.any():
                yield out({c: v[told] for c, v in cols.items()}, np.full(int(told.sum()), FULL, np.int32))
            cols = {c: v[~told] for c, v in cols.items()}
            if held is not None:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in names}
            if not len(cols["h"]):
                continue
            if big is not None:
                end = int(np.searchsorted(cols["h"] != big, True)) if (cols["h"] != big).any() else len(cols["h"])
                stop = end if end < len(cols["h"]) else int(np.flatnonzero(cols["r"] == cols["r"][-1])[0])
                part = cut(cols, 0, stop)
                if stop:
                    yield out(part, flags(part, True))
                cols = cut(cols, stop, None)
                if end > stop or not len(cols["h"]):
                    held = cols
                    continue
                big = None
            last = int(np.flatnonzero(cols["h"] == cols["h"][-1])[0])
            done, held = cut(cols, 0, last), cut(cols, last, None)
            if last:
                yield out(done, flags(done, False))
            if len(held["h"]) > limit:
                big = held["h"][0]
                stop = int(np.flatnonzero(held["r"] == held["r"][-1])[0])
                part, held = cut(held, 0, stop), cut(held, stop, None)
                if stop:
                    yield out(part, flags(part, True))
        if held is not None and len(held["h"]):
            yield out(held, flags(held, big is not None))

    return run


def _surroundings(length: int, gram: int, bits: int, column: str):
    """For marked runs: intervals that are settled, and the bytes around those that are not."""
    types = "route rid th kind lo hi at dlo dhi body".split()

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

        def rows(route, rid, th, kind, lo, hi, at=None, dlo=None, dhi=None, body=None):
            n = len(route)
            fill = [np.zeros(n, np.int32) if x is None else x for x in (at, dlo, dhi)]
            data = [route, rid, th, np.full(n, kind, np.int32), lo, hi, *fill]
            arrays = [pa.array(np.ascontiguousarray(x), t) for x, t in zip(data, kinds, strict=False)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(body, pa.binary()) if body is not None else pa.nulls(n, pa.binary())], types)

        for batch in batches:
            raw, off = text_buffers(batch.column(column))
            rid, th = batch.column("rid").to_numpy(), batch.column("th").to_numpy()
            marks = batch.column("marks")
            ends = np.concatenate([[0], np.cumsum(marks.value_lengths().to_numpy())])
            flat = marks.flatten()
            mh, mr, mf = (flat.field(k).to_numpy() for k in range(3))
            strings: list[np.ndarray] = []
            for i, j in spans_of(off, CHUNK):
                bytes_, offs = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                found = Runs(bytes_, offs, length, gram, bits)
                if not len(found.h):
                    continue
                owner = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                mark = mix(mh[ends[i] : ends[j]].view(np.uint64) ^ mix(mr[ends[i] : ends[j]].view(np.uint64) + owner.astype(np.uint64)))
                # a run may be told twice: repeated, and asked to bring its surroundings
                order, group = _groups(mark)
                flag = np.zeros(group[-1] + 1 if len(group) else 0, np.int64)
                np.bitwise_or.at(flag, group, mf[ends[i] : ends[j]][order].astype(np.int64))
                known = np.unique(mark)
                key = mix(found.h ^ mix(found.r + found.row.astype(np.uint64)))
                if not len(known):
                    continue
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                said = np.where(known[at] == key, flag[at], 0)
                base = offs[found.row]

                full = np.flatnonzero(said & FULL)
                if len(full):
                    lo, hi, row = found.lo[full], found.hi[full] + length, found.row[full]
                    new = np.ones(len(full), bool)
                    new[1:] = (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])
                    first = np.flatnonzero(new)
                    last = np.concatenate([first[1:], [len(full)]]) - 1
                    who = row[first]
                    yield rows(rid[i + who], rid[i + who], th[i + who], 0, lo[first] - offs[who], hi[last] - offs[who])

                ship = (said & SHIP) > 0
                twice = np.zeros(len(ship), bool)  # one copy of a run within a text is enough
                _, once = np.unique(key, return_index=True)
                twice[once] = True
                ship &= twice
                some = np.flatnonzero(ship & (said & BIG == 0))
                if len(some):
                    a, row = found.anchor[some], found.row[some]
                    begin = np.maximum(a - (length - gram), offs[row])
                    end = np.minimum(a + length, offs[row + 1])
                    text = bytes_.tobytes()
                    body = [text[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                    open_ = np.where(said[some] & FULL, -1, a - found.lo[some]).astype(np.int32)
                    yield rows(
                        _signed(found.h[some]), rid[i + row], th[i + row], 1, a - offs[row], a - offs[row],
                        (a - begin).astype(np.int32), (a - found.hi[some]).astype(np.int32), open_, body,
                    )
                wide = np.flatnonzero(ship & (said & BIG > 0))
                if len(wide):
                    count = found.hi[wide] - found.lo[wide] + 1
                    begin = np.concatenate([[0], np.cumsum(count)])
                    start = np.arange(begin[-1]) + np.repeat(found.lo[wide] - begin[:-1], count)
                    run_of = np.repeat(wide, count)
                    whole = np.frombuffer(_digests(bytes_, start, start + length, 16), np.uint64).reshape(-1, 2)
                    row = found.row[run_of]
                    twin = np.where(said[run_of] & FULL, 2, 1).astype(np.int32)
                    strings.append((whole, row + i, start - base[run_of], twin))
            if strings:
                whole, row, start, twin = (np.concatenate(x) for x in zip(*strings, strict=True))
                order, group = _groups(whole[:, 0], whole[:, 1])
                whole, row, start, twin = whole[order], row[order], start[order], twin[order]
                size = np.bincount(group, twin)[group]
                first = np.ones(len(whole), bool)
                first[1:] = group[1:] != group[:-1]
                told = size >= 2
                yield rows(rid[row[told]], rid[row[told]], th[row[told]], 0, start[told], start[told] + length)
                body = [x.tobytes() for x in whole[first, 1]]
                yield rows(_signed(whole[first, 0]), rid[row[first]], th[row[first]], 2, start[first], start[first] + length, at=np.minimum(size[first], 2).astype(np.int32), body=body)

    return run


class Block:
    """Suffixes (and prefixes) at the anchors of a block of surroundings, in classes; ``bits`` of the hashes are compared."""

    def __init__(self, bodies: list[bytes], at: np.ndarray, classes: np.ndarray, length: int, bits: int = 64):
        self.raw = np.frombuffer(b"".join(bodies), np.uint8)
        size = np.array([len(b) for b in bodies], np.int64)
        end = np.cumsum(size)
        self.a = end - size + at
        self.right, self.left = np.minimum(end - self.a, length), at.astype(np.int64)
        self.classes, self.length = classes, length
        self.hashes, self.spare = Hashes(self.raw), np.uint64(64 - bits)

    def _alike(self, a, b, x, y) -> np.ndarray:
        return mix(self.hashes.of(a, b)) >> self.spare == mix(self.hashes.of(x, y)) >> self.spare

    def common(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Longest common extension of each pair, by binary search over hashes."""
        room = self.right if forward else self.left
        lo, hi = np.zeros(len(i), np.int64), np.minimum(room[i], room[j])
        x, y = self.a[i], self.a[j]
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) >> 1
            if forward:
                same = self._alike(x, x + mid, y, y + mid)
            else:
                same = self._alike(x - mid, x, y - mid, y)
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
        return lo

    def compare(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        room = self.right if forward else self.left
        n = self.common(i, j, forward)
        step = n if forward else -n - 1
        top = len(self.raw) - 1
        x = np.where(n < room[i], self.raw[np.clip(self.a[i] + step, 0, top)].astype(np.int64), -1)
        y = np.where(n < room[j], self.raw[np.clip(self.a[j] + step, 0, top)].astype(np.int64), -1)
        return np.sign(x - y)

    def sorted(self, forward: bool) -> np.ndarray:
        """Bottom-up mergesort within the classes; all merges of a level run at once, each item
        finding its rank in the sibling run by binary search."""
        order = np.argsort(self.classes, kind="stable")
        c = self.classes[order]
        fresh = np.ones(len(c), bool)
        fresh[1:] = c[1:] != c[:-1]
        head = np.flatnonzero(fresh)
        size = np.diff(np.concatenate([head, [len(c)]]))
        start, size = np.repeat(head, size), np.repeat(size, size)
        place, width = np.arange(len(c)) - start, 1
        while len(size) and width < size.max():
            act = np.flatnonzero(size > width)
            item, s, n, q = order[act], start[act], size[act], place[act]
            run = q // width
            base, is_left = (run & ~1) * width, (run & 1) == 0
            first = np.minimum(np.where(is_left, base + width, base), n)
            lo, hi = first.copy(), np.minimum(np.where(is_left, base + 2 * width, base + width), n)
            while len(todo := np.flatnonzero(lo < hi)):
                mid = (lo[todo] + hi[todo]) >> 1
                c = self.compare(order[s[todo] + mid], item[todo], forward)
                up = np.where(is_left[todo], c < 0, c <= 0)
                lo[todo], hi[todo] = np.where(up, mid + 1, lo[todo]), np.where(up, hi[todo], mid)
            after = order.copy()
            after[s + base + (q - run * width) + (lo - first)] = item
            order, width = after, width * 2
        return order

    def verified(self, i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the bytes of the extensions are equal, not only their hashes."""
        ok = np.ones(len(i), bool)
        span = np.arange(-int(left.max(initial=0)), int(right.max(initial=0)))
        top = len(self.raw) - 1
        for k in range(0, len(i), 4096):
            p = slice(k, k + 4096)
            inside = (span >= -left[p, None]) & (span < right[p, None])
            x = self.raw[np.clip(self.a[i[p], None] + span, 0, top)]
            y = self.raw[np.clip(self.a[j[p], None] + span, 0, top)]
            ok[p] = ((x == y) | ~inside).all(1)
        return ok

    def repeated(self, dlo: np.ndarray, dhi: np.ndarray):
        """(item, first d, last d): strings that start d bytes before the anchor and occur twice.

        Only items with dhi >= dlo are asked about; the others are partners.
        """
        out, best = [], {True: np.zeros(len(self.a), np.int64), False: np.zeros(len(self.a), np.int64)}
        sure = {True: np.full(len(self.a), -1), False: np.full(len(self.a), -1)}
        wrong = np.zeros(len(self.a), bool)
        pairs = []
        for forward in (True, False):
            order = self.sorted(forward)
            # comparisons that a collision makes contradictory may lose an item from the order
            lost = np.bincount(order, minlength=len(self.a)) != 1
            wrong |= np.isin(self.classes, self.classes[lost])
            i, j = order[:-1], order[1:]
            same = (self.classes[i] == self.classes[j]) & (i != j)
            i, j = i[same], j[same]
            right, left = self.common(i, j, True), self.common(i, j, False)
            # neighbours whose extensions are equal in bytes and that stand in the right order make a sorted class;
            # a class with any other pair was misled by a collision and is compared as bytes throughout
            ok = self.verified(i, j, left, right)
            good = ok & (self.compare(i, j, forward) <= 0)
            wrong |= np.isin(self.classes, self.classes[i[~good]])
            for x in (i[ok], j[ok]):
                pairs.append((x, left[ok], right[ok]))
                np.maximum.at(best[True], x, right[ok])
                np.maximum.at(best[False], x, left[ok])
                # the other side's extension, of the neighbours with the longest on this side
        for x, left, right in pairs:
            at_right, at_left = right == best[True][x], left == best[False][x]
            np.maximum.at(sure[True], x[at_right], left[at_right])
            np.maximum.at(sure[False], x[at_left], right[at_left])
            first, last = np.maximum(self.length - right, dlo[x]), np.minimum(left, dhi[x])
            hit = first <= last
            out.append((x[hit], first[hit], last[hit]))
        # between what is certain from either side, strings may still have a partner further away
        first = np.maximum(np.maximum(self.length - best[True], dlo), np.where(wrong, 0, sure[True] + 1))
        last = np.minimum(np.minimum(best[False], dhi), np.where(wrong, self.length, self.length - sure[False] - 1))
        first, last = np.where(wrong, dlo, first), np.where(wrong, dhi, last)
        doubt = np.flatnonzero(first <= last)
        if len(doubt):
            out += self._as_bytes(doubt, first, last)
        return out

    def _as_bytes(self, doubt, first, last):
        out, rank = [], {}
        for i in doubt.tolist():
            rank.setdefault(int(self.classes[i]), []).append(i)
        view = self.raw.tobytes()
        by_class = np.argsort(self.classes, kind="stable")
        c = self.classes[by_class]
        for cls, items in rank.items():
            members = by_class[np.searchsorted(c, cls) : np.searchsorted(c, cls, side="right")]
            asked: dict[int, list[int]] = {}
            for i in items:
                for d in range(int(first[i]), int(last[i]) + 1):
                    asked.setdefault(d, []).append(i)
            for d, want in asked.items():
                can = members[(self.left[members] >= d) & (self.right[members] >= self.length - d)]
                seen: dict[bytes, int] = {}
                for a in self.a[can].tolist():
                    s = view[a - d : a - d + self.length]
                    seen[s] = seen.get(s, 0) + 1
                hit = [i for i in want if seen.get(view[self.a[i] - d : self.a[i] - d + self.length], 0) > 1]
                if hit:
                    out.append((np.array(hit), np.full(len(hit), d), np.full(len(hit), d)))
        return out


def _sort_suffixes(length: int, bits: int):
    """Rows sorted by route: surroundings in blocks of whole classes, single strings by count."""

    def run(batches):
        import pyarrow as pa

        def told(rid, th, lo, hi):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(x), t) for x, t in ((rid, pa.int64()), (th, pa.int64()), (lo, pa.int64()), (hi, pa.int64()))], ["rid", "th", "lo", "hi"]
            )

        def block(held):
            cols = {c: np.concatenate([h[c] for h in held]) for c in ("route", "rid", "th", "lo", "at", "dlo", "dhi")}
            bodies = [b for h in held for b in h["body"]]
            work = Block(bodies, cols["at"], np.unique(cols["route"], return_inverse=True)[1], length, bits)
            for item, first, last in work.repeated(cols["dlo"].astype(np.int64), cols["dhi"].astype(np.int64)):
                if len(item):
                    a = cols["lo"][item]
                    yield told(cols["rid"][item], cols["th"][item], a - last, a - first + length)

        held, bytes_held, single = [], 0, None
        for batch in batches:
            cols = {c: batch.column(c).to_numpy() for c in ("route", "rid", "th", "kind", "lo", "hi", "at", "dlo", "dhi")}
            kind = cols["kind"]
            if (done := kind == 0).any():
                yield told(*(cols[c][done] for c in ("rid", "th", "lo", "hi")))
            if (alone := kind == 2).any():
                # the two halves of a string's digest; rows are sorted by them
                part = {c: cols[c][alone] for c in ("route", "rid", "th", "lo", "hi", "at")}
                part["body"] = np.frombuffer(b"".join(batch.column("body").filter(pa.array(alone)).to_pylist()), np.uint64)
                if single is not None:
                    part = {c: np.concatenate([single[c], part[c]]) for c in part}
                tail = int(np.flatnonzero((part["route"] == part["route"][-1]) & (part["body"] == part["body"][-1]))[0])
                order, group = _groups(part["route"], part["body"])
                of = np.empty(len(order), np.int64)
                of[order] = group
                hit = np.bincount(of, part["at"])[of] >= 2
                yield told(*(part[c][hit] for c in ("rid", "th", "lo", "hi")))
                single = {c: v[tail:] for c, v in part.items()}
                single = {c: v[-1:] for c, v in single.items()} if hit[-1] else single
                if hit[-1]:
                    single["at"] = np.array([2], np.int32)
            if (near := np.flatnonzero(kind == 1)).size:
                body = batch.column("body").take(pa.array(near)).to_pylist()
                part = {c: cols[c][near] for c in ("route", "rid", "th", "lo", "at", "dlo", "dhi")} | {"body": body}
                bytes_held += sum(map(len, body))
                if bytes_held > BLOCK:
                    tail = int(np.flatnonzero(part["route"] == part["route"][-1])[0])
                    if tail:
                        held.append({c: v[:tail] for c, v in part.items()})
                        yield from block(held)
                        held, part = [], {c: v[tail:] for c, v in part.items()}
                        bytes_held = sum(map(len, part["body"]))
                held.append(part)
        if held:
            yield from block(held)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` under names of their own, with rid and th; and the text's name."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    return own.withColumns({"rid": row_id(names[docs.columns.index(id_col)], text), "th": F.xxhash64(text)}), text


def repeated_spans(keyed: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, limit: int = CLASS, bits: int = 64) -> DataFrame:
    """(rid, th, spans): byte intervals [lo, hi) of each text to be removed; they may overlap."""
    slim = keyed.select("rid", "th", F.col(text).alias("text"))
    runs = slim.mapInArrow(released(_anchors(length, gram, bits)), "route long, h long, r long, rid long, th long, n int")
    marks = runs.repartition("route").sortWithinPartitions("h", "r").mapInArrow(released(_settle(limit)), "rid long, th long, h long, r long, flag int")
    # a text that is repeated whole has each mark once, however many rows it has
    marks = marks.groupBy("rid", "th").agg(F.collect_set(F.struct("h", "r", "flag")).alias("marks"))
    schema = "route long, rid long, th long, kind int, lo long, hi long, at int, dlo int, dhi int, body binary"
    # all columns go along, so that this join and the last one read one shuffle of the texts
    near = keyed.join(marks, ["rid", "th"]).mapInArrow(released(_surroundings(length, gram, bits, text)), schema)
    dealt = near.repartition("route").sortWithinPartitions("route", "kind", F.when(F.col("kind") == 2, F.col("body")))
    spans = dealt.mapInArrow(released(_sort_suffixes(length, bits)), "rid long, th long, lo long, hi long")
    return spans.groupBy("rid", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def kept_pieces(data: bytes, spans) -> tuple[list[bytes], int, int]:
    """What stays of a text, the number of bytes removed and of maximal removed runs."""
    pieces, done, removed, count = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(spans):
        if lo > end:
            count += 1
            if lo > done:
                pieces.append(data[done:lo])
            removed += hi - lo
        elif hi > end:
            removed += hi - end
        end = max(end, hi)
        done = end
    pieces.append(data[max(done, 0) :])
    return pieces, removed, count


def _rows(batch, text: str):
    raw, off = text_buffers(batch.column(text))
    data = raw.tobytes()
    for i, spans in enumerate(batch.column("spans").to_pylist()):
        yield data[off[i] : off[i + 1]], [(s["lo"], s["hi"]) for s in spans or ()]


def repeat_digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = CLASS, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row."""
    keyed, text = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for data, spans in _rows(batch, text):
                pieces, removed, count = kept_pieces(data, spans)
                digest = hashlib.sha256()
                for p in pieces:
                    digest.update(p)
                for column, value in zip(out, (len(data), removed, count, digest.hexdigest()), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("c0"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    joined = keyed.join(repeated_spans(keyed, text, length, gram, limit, bits), ["rid", "th"], "left")
    return joined.select("c0", text, "spans").mapInArrow(released(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = CLASS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; the other columns stay, whatever their names."""
    keyed, text = _keyed(docs, "doc_id", "text")
    names = [c for c in keyed.columns if c not in ("rid", "th")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for (data, spans), value in zip(_rows(batch, text), batch.column(text).is_valid().to_pylist(), strict=True):
                out.append(b"".join(kept_pieces(data, spans)[0]).decode("utf-8", "ignore") if value else None)
            column = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([column if c == text else batch.column(c) for c in names], names)

    joined = keyed.join(repeated_spans(keyed, text, length, gram, limit), ["rid", "th"], "left")
    return joined.select(*names, "spans").mapInArrow(released(run), keyed.select(*names).schema).toDF(*docs.columns)
