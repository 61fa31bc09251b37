"""Removal of repeated passages by a sparse suffix array, merged with common-prefix-aware runs.

Every byte covered by a string of `length` bytes that also starts anywhere else goes. Sorting the
suffix at every byte of a corpus costs hundreds of bytes of exchange a byte; instead suffixes start
at anchors, the smallest of the hashed `GRAM`-byte strings in each window of `length` bytes
(winnowing), about two in 369 bytes. Equal windows have the same anchor at the same place, so nothing
is lost: a window is repeated exactly if two suffixes at equal anchors agree far enough to the right (R)
and the text before them far enough to the left (L), L + R >= length.

 1. One scan gives every anchor's gram hash h, the range of windows it stands for, and a hash f
    of all their bytes. Anchors whose h occurs once stand for no repeated window. Anchors with
    equal (h, f) are wholly repeated, however many there are: counts with map-side combining.
 2. Only one representative of each (h, f) in groups with different f is compared byte by byte. Tasks
    sort their suffixes into front-coded runs by ranges of h; each range merges its runs with a
    loser tree that carries the common prefix of every candidate with the last winner and never compares
    those bytes again. The merge yields the suffix array of the range with its common prefixes.
 3. In each group of equal grams, common prefixes are joined from the longest down; smaller sets
    are inserted into larger ones in the order of their left contexts, where only neighbours
    can improve on each other. So the longest L and R of every suffix take m log m steps.
 4. A group of more than `GROUP_MOST` representatives (a passage that a large part of all documents share, cut
    at its edges by different neighbours) is split before the merge, on longer strings than the gram: its windows
    are dealt into ranges by their distance from the gram, and representatives into groups by the core that
    all windows of a range share. Counts with map-side combining settle the ranges that are wholly equal or
    alone; groups that fit go to the merge, the others are split further, until a range is one window.

Texts move only where they must: a bitmap of fixed size tells which texts may hold representatives or spans.

Windows are judged on the input. Defined results: null or empty texts have no bytes; texts shorter
than `length` keep all; repeated rows repeat each other's windows; an empty table gives no rows; other
columns are passed or ignored. Rows are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import common
from touchline.llm import textbytes as tb

LENGTH = 400
GRAM = 32
SEGMENT = 1 << 20
RUN_BYTES = 8 << 20
PART_BYTES = 8 << 20
GROUP_MOST = 4096
SPLIT = 8
_AT = np.uint64((1 << 22) - 1)
_KEY, _SPANS = f"{common.OWN}rk", f"{common.OWN}spans"


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of `width` consecutive values."""
    n = len(v) - width + 1
    full = -(-len(v) // width) * width
    grid = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(v)] = v
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, at, low, high, h, f) of each anchor: it stands for the windows that start at - high .. at - low.

    Positions count from the row's start. Rows longer than SEGMENT are worked on in overlapping segments.
    """
    out = []
    n = len(buf)
    if n < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    for lo in range(0, n - length + 1, SEGMENT):
        hi = min(n, lo + SEGMENT + length - 1)
        part = buf[lo:hi]
        sums = tb.prefix_sums(part)
        starts = np.arange(len(part) - gram + 1)
        h = tb.span_hashes(sums, starts, starts + gram)
        order = (h & ~_AT) | (_AT - starts.astype(np.uint64))
        first = _smallest(order, length - gram + 1)
        p = np.arange(len(first))
        row = np.searchsorted(offs, p + lo, "right") - 1
        ok = p + lo + length <= offs[row + 1]
        p, row = p[ok], row[ok]
        if not len(p):
            continue
        at = (_AT - (first[p] & _AT)).astype(np.int64)
        new = np.ones(len(p), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(p)) - 1
        a, r = at[begin], row[begin]
        high, low = a - p[begin], a - p[end]
        own = part.tobytes()
        digests = [hashlib.blake2b(own[x:y], digest_size=8).digest() for x, y in zip(p[begin].tolist(), (p[end] + length).tolist(), strict=True)]
        f = np.frombuffer(b"".join(digests), np.uint64) ^ tb.mix(high.astype(np.uint64) + np.uint64(1))
        out.append((r, a + lo - offs[r], low, high, h[a], f))
    if not out:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    return [np.concatenate([x[i] for x in out]) for i in range(6)]


def _pack_place(at, low, high):
    return (at << 20) | (low << 10) | high


def _unpack(place):
    return place >> 20, (place >> 10) & 1023, place & 1023


def _find(length: int, gram: int):
    """(h, f, rk, n, places): the n anchors of a text with equal (h, f), as a row."""

    def run(batches):
        for batch in batches:
            keys = batch.column("rk").to_numpy(zero_copy_only=False)
            for lo, _, buf, offs in tb.slices(batch.column("text")):
                row, at, low, high, h, f = anchors(buf, offs, length, gram)
                if not len(row):
                    continue
                order = np.lexsort((at, f, h, row))
                row, h, f, place = row[order], h[order], f[order], _pack_place(at, low, high)[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (f[1:] != f[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(row)))
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(place))
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(f[first].view(np.int64)), pa.array(keys[lo:][row[first]]), pa.array(n), places], names=["h", "f", "rk", "n", "places"])

    return run


def _whole_spans(length: int):
    """(rk, from, to): maximal runs of bytes covered by the windows of anchors."""

    def run(batches):
        for batch in batches:
            column = batch.column("places")
            at, low, high = _unpack(column.flatten().to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            start, end = at - high, at - low + length
            new = np.ones(len(at), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > end[:-1])  # places of a row ascend, and so do both their bounds
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            yield pa.RecordBatch.from_arrays([batch.column("rk").take(pa.array(owner[first])), pa.array(start[first]), pa.array(end[last])], names=["rk", "from", "to"])

    return run


# -- front-coded runs and their merge ---------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, step = known, 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(lo + step, n)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def encode_run(items: list[tuple[bytes, bytes, tuple]]) -> dict:
    """A run of (suffix, left context, facts), sorted by suffix, front-coded: each suffix keeps only what follows its common prefix with the one before."""
    items = sorted(items, key=lambda x: x[0])
    shared, rest, last = [], [], b""
    for suffix, _, _ in items:
        k = common_prefix(last, suffix)
        shared.append(k)
        rest.append(suffix[k:])
        last = suffix
    return {"shared": shared, "rest": rest, "left": [x[1] for x in items], "facts": [x[2] for x in items]}


def _decode_run(run: dict):
    """(suffix, common prefix with the one before, left context, facts) in order."""
    last = b""
    for k, rest, left, facts in zip(run["shared"], run["rest"], run["left"], run["facts"], strict=True):
        last = last[:k] + rest
        yield last, k, left, facts


class LoserTree:
    """Merges sorted runs. Every candidate carries its common prefix with the last winner.

    Of two candidates, the one that shares more with the last winner is the smaller, without looking
    at a byte; only with equal common prefixes are bytes compared, from there on, and what the
    comparison finds is the loser's common prefix with the winner.
    """

    def __init__(self, runs: list[dict]):
        self.runs = [_decode_run(r) for r in runs]
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.now: list[tuple | None] = [next(r, None) for r in self.runs] + [None] * (self.size - len(runs))
        self.shares = [0] * self.size
        self.loser = [0] * (2 * self.size)
        self.compared = 0
        self.top = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of a and b; the loser stays in the node."""
        x, y = self.now[a], self.now[b]
        if y is None or (x is not None and self.shares[a] > self.shares[b]):
            win, lose = a, b
        elif x is None or self.shares[a] < self.shares[b]:
            win, lose = b, a
        else:
            k = common_prefix(x[0], y[0], self.shares[a])
            self.compared += k - self.shares[a] + 1
            win, lose = (a, b) if x[0][k : k + 1] <= y[0][k : k + 1] else (b, a)
            self.shares[lose] = k
        self.loser[node] = lose
        return win

    def __iter__(self):
        while self.now[self.top] is not None:
            run = self.top
            suffix, _, left, facts = self.now[run]
            yield suffix, self.shares[run], left, facts
            self.now[run] = next(self.runs[run], None)
            if self.now[run] is not None:
                self.shares[run] = self.now[run][1]
            win, node = run, (run + self.size) // 2
            while node:
                win = self._play(node, win, self.loser[node])
                node //= 2
            self.top = win


def extents(lcp: list[int], left: list[bytes], length: int) -> list[tuple[int, int]]:
    """For suffixes in order: the longest (L, R) over partners with L + R >= length, or (0, 0).

    lcp[i]: common prefix of suffixes i - 1 and i. left: the bytes before each suffix, last byte first.
    """
    m = len(left)
    best = [[0, 0] for _ in range(m)]
    owner = list(range(m))
    sets: list[list[tuple[bytes, int]] | None] = [[(x, i)] for i, x in enumerate(left)]

    def top(i):
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for i in sorted(range(1, m), key=lambda j: -lcp[j]):
        a, b, r = top(i - 1), top(i), lcp[i]
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        for entry in sets[b]:
            at = bisect.bisect_left(large, entry)
            for other in large[max(0, at - 1) : at + 1]:
                reach = common_prefix(entry[0], other[0])
                if reach + r >= length:
                    for k in (entry[1], other[1]):
                        best[k][0] = max(best[k][0], reach)
                        best[k][1] = max(best[k][1], r)
        for entry in sets[b]:
            bisect.insort(large, entry)
        sets[b] = None
        owner[b] = a
    return [tuple(x) for x in best]


_RUN_FIELDS = "shared array<int>, rest array<binary>, left array<binary>, facts array<array<long>>"
_RUN_ARROW = pa.schema([("part", pa.int32()), ("shared", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("left", pa.list_(pa.binary())), ("facts", pa.list_(pa.list_(pa.int64())))])


class Runs:
    """Sorted, front-coded runs of one task, one for each range of groups; a run is handed on when RUN_BYTES are held."""

    def __init__(self, parts: int):
        self.parts, self.held, self.weight = parts, {}, 0

    def add(self, key: int, suffix: bytes, left: bytes, facts: tuple):
        item = ((key & (1 << 64) - 1).to_bytes(8, "big") + suffix, left, facts)
        self.held.setdefault(key % self.parts, []).append(item)
        self.weight += len(suffix) + len(left) + 64
        if self.weight >= RUN_BYTES:
            yield from self.flush()

    def flush(self):
        for part, items in self.held.items():
            made = encode_run(items)
            yield pa.RecordBatch.from_pydict({"part": [part], **{k: [v] for k, v in made.items()}}, schema=_RUN_ARROW)
        self.held, self.weight = {}, 0


def _make_runs(parts: int, length: int):
    """Runs of the suffixes at representatives, from texts."""

    def run(batches):
        runs = Runs(parts)
        for batch in batches:
            raw, offs = tb.raw_texts(batch.column("text"))
            for i, (rk, reps) in enumerate(zip(batch.column("rk").to_pylist(), batch.column("reps").to_pylist(), strict=True)):
                text = raw[offs[i] : offs[i + 1]].tobytes()
                for rep in reps:
                    at, low, high = _unpack(rep["place"])
                    yield from runs.add(rep["h"], text[at : at - low + length], text[at - high : at][::-1], (rep["h"], rep["f"], rep["c"], rk, rep["place"]))
        yield from runs.flush()

    return run


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "big", signed=True)


def _cut_out(length: int):
    """(h, rk, place, c, bytes): the bytes of all windows of a representative."""

    def run(batches):
        for batch in batches:
            raw, offs = tb.raw_texts(batch.column("text"))
            rows = []
            for i, (rk, reps) in enumerate(zip(batch.column("rk").to_pylist(), batch.column("reps").to_pylist(), strict=True)):
                for rep in reps:
                    at, low, high = _unpack(rep["place"])
                    rows.append((rep["h"], rk, rep["place"], rep["c"], raw[offs[i] + at - high : offs[i] + at - low + length].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.binary(),), strict=True)], names=["h", "rk", "place", "c", "bytes"])

    return run


def _nodes(width: int, narrow: int, last: int, length: int):
    """(g, v, whole, rk, place, c, a): the ranges of `narrow` offsets within a range of `width` offsets, for each piece.

    A window's offset is the distance from its start to the anchor's gram. All windows of a range share its core;
    g stands for the core, v for all bytes of the range's windows if the piece has all of them (whole).
    """

    def run(batches):
        for batch in batches:
            rows = []
            cols = [batch.column(c).to_pylist() for c in ("rk", "place", "c", "bytes", "a")]
            for rk, place, c, own, a in zip(*cols, strict=True):
                _, low, high = _unpack(place)
                for x in range(a, min(a + width, last + 1), narrow):
                    y = min(x + narrow - 1, last)
                    if max(x, low) > min(y, high):
                        continue
                    mark = x.to_bytes(4, "big") + y.to_bytes(4, "big")
                    whole = low <= x and y <= high
                    v = _hash(b"v", mark, own[high - y : high - x + length]) if whole else _hash(b"i", mark, rk.to_bytes(8, "big", signed=True), place.to_bytes(8, "big"))
                    rows.append((_hash(b"g", mark, own[high - x : high - y + length]), v, whole, rk, place, c, x))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = (pa.int64(), pa.int64(), pa.bool_(), *(pa.int64(),) * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["g", "v", "whole", "rk", "place", "c", "a"])

    return run


def _piece_runs(parts: int, length: int):
    """Runs of the suffixes at pieces, each with the bytes of its range of windows alone."""

    def run(batches):
        runs = Runs(parts)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("g", "v", "c", "rk", "place", "bytes", "a", "b")]
            for g, v, c, rk, place, own, a, b in zip(*cols, strict=True):
                _, low, high = _unpack(place)
                yield from runs.add(g, own[high : high - max(a, low) + length], own[high - min(b, high) : high][::-1], (g, v, c, rk, place))
        yield from runs.flush()

    return run


def _merge(length: int):
    def run(_, table):
        runs = []
        for i in range(table.num_rows):
            row = table.slice(i, 1)
            runs.append({c: row.column(c)[0].as_py() for c in ("shared", "rest", "left", "facts")})
        found: list[tuple[int, int, int]] = []
        group: list[tuple[int, bytes, list]] = []

        def close():
            seen, kept, low = set(), [], None
            for k, left, facts in group:  # representatives of repeated rows come more than once
                low = k if low is None else min(low, k)
                if facts[1] not in seen:
                    seen.add(facts[1])
                    kept.append((low, left, facts))
                    low = None
            if len(kept) > 1 and any(x[2][2] == 1 for x in kept):
                reach = extents([max(0, x[0] - 8) for x in kept], [x[1] for x in kept], length)
                for (left, right), (_, _, facts) in zip(reach, kept, strict=True):
                    if right and facts[2] == 1:
                        at = facts[4] >> 20
                        found.append((facts[3], at - left, at + right))

        for _suffix, share, left, facts in LoserTree(runs):
            if group and group[-1][2][0] != facts[0]:
                close()
                group.clear()
            group.append((share, left, facts))
        if group:
            close()
        cols = list(zip(*found, strict=True)) if found else [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["rk", "from", "to"])

    return run


# -- the whole ---------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, name: str = "rk") -> DataFrame:
    return docs.withColumn(name, F.xxhash64(docs["doc_id"], docs["text"]))


def _gathered(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(rk, text, reps) of the texts that hold representatives."""
    own = common.materialize(reps.groupBy("rk").agg(F.collect_list(F.struct("h", "f", "c", "place")).alias("reps")), "text-representatives")
    return texts.filter(common.sieve(own, "rk")("rk")).join(own.hint("merge"), "rk")


def _split_large(pieces: DataFrame, length: int, gram: int, group_most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Groups too large for a task, split on longer common strings: (spans, members of groups that fit).

    pieces: rk, place, c, bytes. In each round the offsets of a group's windows are cut into SPLIT ranges; pieces
    are counted by the core that all windows of a range share, and by all their bytes. Equal ranges are
    repeated, ranges with a core of their own are not, small groups of a core go to the merge and large ones to the
    next round. At a range of one offset the core is the window, so at most log(length) / log(SPLIT) rounds.
    """
    last = length - gram
    width, at = last + 1, pieces.select("rk", "place").withColumn("a", F.lit(0).cast("long"))
    spans, small = [], []
    while True:
        narrow = -(-width // SPLIT)
        each = pieces.join(at, ["rk", "place"]).mapInArrow(_nodes(width, narrow, last, length), "g long, v long, whole boolean, rk long, place long, c long, a long")
        each = common.materialize(each, "window-ranges")
        kinds = each.groupBy("g", "v").agg(F.count("*").alias("m"), F.max("c").alias("c"), F.min(F.struct("rk", "place", "a", "whole")).alias("rep"))
        kinds = common.materialize(kinds.select("g", "v", "m", F.when(F.col("m") > 1, 2).otherwise(F.col("c")).cast("long").alias("c"), "rep.rk", "rep.place", "rep.a", "rep.whole"), "range-kinds")
        repeated = each.join(kinds.filter("m > 1 AND whole").select("g", "v"), ["g", "v"], "left_semi")
        at_, b = F.shiftright("place", 20), F.least(F.col("a") + narrow - 1, F.lit(last))
        spans.append(common.materialize(repeated.select("rk", (at_ - b).alias("from"), (at_ - F.col("a") + length).alias("to")), "range-spans"))
        common.discard(each)
        cores = kinds.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("least")).filter("n > 1 AND least = 1").select("g", "n")
        open_ = common.materialize(kinds.join(cores, "g").select("g", "v", "c", "rk", "place", "a", "n"), "open-ranges")
        small.append(open_.filter(F.col("n") <= group_most).select("g", "v", "c", "rk", "place", "a", b.alias("b")))
        large = open_.filter(F.col("n") > group_most)
        if narrow == 1 or large.isEmpty():
            return spans, small
        at, width = large.select("rk", "place", "a").distinct(), narrow


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_most: int = GROUP_MOST) -> DataFrame:
    """(rk, from, to): byte spans of repeated strings; they may overlap."""
    texts = _keyed(common.only(docs, "doc_id", "text")).filter(F.octet_length("text") >= length).select("rk", "text")
    every = common.materialize(texts.mapInArrow(_find(length, gram), "h long, f long, rk long, n long, places array<long>"), "anchors")
    shared = every.groupBy("h").agg(F.sum("n").alias("n"), (F.min("f") != F.max("f")).alias("differ")).filter(F.col("n") > 1).select("h", "differ")
    # written first, so that the join may split a frequent h
    shared = common.materialize(shared, "shared-grams")
    some = common.materialize(every.join(shared, "h"), "shared-anchors")
    common.discard(every)
    groups = some.groupBy("h", "f").agg(F.sum("n").alias("c"), F.first("differ").alias("differ"), F.min(F.struct("rk", F.col("places")[0].alias("place"))).alias("rep"))
    groups = common.materialize(groups.select("h", "f", "c", "differ", "rep.rk", "rep.place"), "anchor-groups")
    whole = some.join(groups.filter(F.col("c") > 1).select("h", "f"), ["h", "f"], "left_semi").select("rk", "places")
    found = [common.materialize(whole.mapInArrow(_whole_spans(length), "rk long, from long, to long"), "repeated-anchors")]
    common.discard(shared, some)
    reps = groups.filter("differ").select("h", "f", "c", "rk", "place")
    large = common.materialize(reps.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > group_most).select("h"), "large-groups")
    few, pieces, small = reps, None, []
    if not large.isEmpty():
        few = common.materialize(reps.join(large, "h", "left_anti"), "representatives")
        pieces = _gathered(texts, reps.join(large, "h", "left_semi")).mapInArrow(_cut_out(length), "h long, rk long, place long, c long, bytes binary")
        pieces = common.materialize(pieces.dropDuplicates(["rk", "place"]), "pieces")  # repeated rows give them more than once
        more, small = _split_large(pieces, length, gram, group_most)
        found += more
    n = few.count() + sum(x.count() for x in small)
    parts = max(12, -(-n * 2 * length // PART_BYTES))
    runs = _gathered(texts, few).mapInArrow(_make_runs(parts, length), f"part int, {_RUN_FIELDS}")
    for x in small:
        runs = runs.unionByName(x.join(pieces.select("rk", "place", "bytes"), ["rk", "place"]).mapInArrow(_piece_runs(parts, length), f"part int, {_RUN_FIELDS}"))
    found.append(common.materialize(runs.groupBy("part").applyInArrow(_merge(length), "rk long, from long, to long"), "merged-spans"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_most: int = GROUP_MOST) -> DataFrame:
    """(rk, spans): byte spans [from, to) of repeated strings, for each row that has any; they may overlap."""
    found = spans(docs, length, gram, group_most)
    return common.materialize(found.groupBy("rk").agg(F.collect_set(F.struct("from", "to")).alias("spans")), "spans-by-text")


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _apply(names: list[str], digest: bool):
    def run(batches):
        for batch in batches:
            raw, offs = tb.raw_texts(batch.column("text"))
            column = batch.column(_SPANS)
            at = column.offsets.to_numpy()
            lows, highs = (column.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            sizes, removed, counts, shas, kept_texts = [], [], [], [], []
            for i in range(batch.num_rows):
                text = raw[offs[i] : offs[i + 1]].tobytes()
                runs = union_of(list(zip(lows[at[i] : at[i + 1]].tolist(), highs[at[i] : at[i + 1]].tolist(), strict=True)))
                kept, last = [], 0
                for a, b in runs:
                    kept.append(text[last:a])
                    last = b
                left = b"".join([*kept, text[last:]])
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                counts.append(len(runs))
                if digest:
                    shas.append(hashlib.sha256(left).hexdigest())
                else:
                    kept_texts.append(left.decode("utf-8", "ignore"))
            if digest:
                made = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                text = pa.array(kept_texts, pa.string())
                yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in names], names=names)

    return run


def _with_spans(docs: DataFrame, keep: list[str], length: int, group_most: int = GROUP_MOST) -> tuple[DataFrame, DataFrame]:
    """(rows with their spans, rows without any): only texts that may have spans are shuffled."""
    rows = _keyed(docs.select(*[docs[c] for c in dict.fromkeys([*keep, "doc_id", "text"])]), _KEY)
    found = repeated(docs, length, group_most=group_most).toDF(_KEY, _SPANS)
    maybe = common.sieve(found, _KEY)(_KEY)
    met = rows.filter(maybe).join(found.hint("merge"), _KEY, "left")
    hit = met.filter(F.col(_SPANS).isNotNull()).drop(_KEY)
    return hit, rows.filter(~maybe).drop(_KEY).unionByName(met.filter(F.col(_SPANS).isNull()).drop(_KEY, _SPANS))


def digest(docs: DataFrame, length: int = LENGTH, group_most: int = GROUP_MOST) -> DataFrame:
    hit, clean = _with_spans(docs, ["doc_id"], length, group_most)
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = F.lit(0).cast("long")
    whole = clean.select("doc_id", F.coalesce(F.octet_length("text"), none).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    return hit.mapInArrow(_apply(["doc_id"], True), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").unionByName(whole)


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut from text (a character cut in two goes whole) and n_chars set anew."""
    hit, clean = _with_spans(docs, docs.columns, length)
    cut = hit.mapInArrow(_apply(docs.columns, False), docs.schema).union(clean.select(*docs.columns))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))


def brute(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Removed runs of each text by looking at every window, for tests."""
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [union_of([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]) for t in texts]
