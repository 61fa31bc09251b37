"""N-gram Jaccard join: count-vector R-trees over buckets of shared shingles, then exact comparison.

A text's set is its distinct `SHINGLE`-word runs (of fewer words: the whole sequence as one). Two
sets link when 100 * |intersection| >= 80 * |union|; the result is the components of the links.

 1. Equal sets become one (a hash of the set), so copies cost one aggregation. Every set has a
    count vector: its shingles hashed into `GROUPS` groups, and how many fell into each.
 2. Linked sets share one of their n - ceil(0.8 n) + 1 first shingles under any one order of all
    shingles. The order used is rare first, by a sketch of `CELLS` counters over all documents (its size
    does not depend on the input; the order only decides how long buckets are, never what is found).
 3. In every bucket of sets that share such a shingle, all are compared with the most central
    one (that with most company in all its buckets: among copies of one text, mostly the text itself).
    What is connected by then, within two links, needs no further comparison.
 4. Buckets that still hold different components are gathered by the smallest of their components,
    so that a pair is met about once. The count vectors of such a group form an R-tree, whose boxes
    (and points) bound the intersection by the sum of the smaller coordinates; pairs of different
    components that survive the bound are compared exactly. Members of the component that most of the
    group belongs to are not searched against each other. Large groups are searched in pairs of blocks.
 5. Components by alternating stars over all links.

Defined results: null and empty texts, and texts without words, have empty sets and are their own
component; component_id is the smallest non-null doc_id of the component (null if there is none);
repeated rows are rows of one set; an empty table gives no rows; other columns are ignored. Sets are
told apart by 64-bit hashes, shingles by 64-bit hashes within a pair.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import common
from touchline.llm import textbytes as tb
from touchline.llm.components import components, nearby

SHINGLE = 5
GROUPS = 256
CELLS = 1 << 21
_CHUNK = 1 << 15
#: A group of c sets is searched in blocks of 32 * sqrt(c) sets, between these bounds: larger groups in larger blocks, so that fewer rows are repeated.
BLOCK_LEAST, BLOCK_MOST = 4096, 16384
LEAF = 32


def shingles(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by both."""
    starts, ends, first = tb.words(buf, offs, tb.SPACED)
    h = tb.word_hashes(buf, starts, ends)
    counts = np.diff(first)
    rows, found = [], []
    for k in range(1, size + 1):
        if k < size:
            at = first[:-1][counts == k]
        else:
            at = tb.window_starts(first, size)
        if len(at):
            found.append(tb.window_hashes(h, k)[at])
            rows.append(np.searchsorted(first, at, "right") - 1)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, value = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def set_hashes(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles, hash of the set) of each of n rows."""
    counts = np.bincount(row, minlength=n)
    out = np.zeros(n, np.uint64)
    live = np.flatnonzero(counts)
    if len(live):
        at = np.concatenate(([0], np.cumsum(counts)))[live]
        out[live] = tb.mix(np.add.reduceat(tb.mix(value ^ np.uint64(0x5851F42D4C957F2D)), at) + counts[live].astype(np.uint64))
    return counts, out.view(np.int64)


def count_vectors(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    group = (value >> np.uint64(56)).astype(np.int64)
    return np.bincount(row * GROUPS + group, minlength=n * GROUPS).reshape(n, GROUPS)


def cell(value: np.ndarray) -> np.ndarray:
    return ((value >> np.uint64(8)) & np.uint64(CELLS - 1)).astype(np.int64)


def prefix_size(n):
    return n - (4 * n + 4) // 5 + 1


def enough(shared, a, b):
    """100 * shared >= 80 * union."""
    return 9 * shared >= 4 * (a + b)


_FEATURES = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("n", pa.int32()), ("k", pa.int64()), ("cv", pa.binary()), ("chunk", pa.int32()), ("cells", pa.binary())])


def _features(batches):
    total = np.zeros(CELLS, np.uint32)
    for batch in batches:
        for lo, hi, buf, offs in tb.slices(batch.column("text")):
            row, value = shingles(buf, offs)
            counts, key = set_hashes(row, value, hi - lo)
            seen, times = np.unique(cell(value), return_counts=True)
            total[seen] += times.astype(np.uint32)
            cv = count_vectors(row, value, hi - lo)
            packed = cv.astype(np.uint8).tobytes()
            wide = cv.max(1, initial=0) > 255
            cvs = [None if wide[i] else packed[i * GROUPS : (i + 1) * GROUPS] for i in range(hi - lo)]
            none = pa.nulls(hi - lo, pa.int32())
            ids = batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, batch.column("rk").slice(lo, hi - lo), pa.array(counts, pa.int32()), pa.array(key), pa.array(cvs, pa.binary()), none, pa.nulls(hi - lo, pa.binary())], schema=_FEATURES)
    for c in range(CELLS // _CHUNK):
        own = total[c * _CHUNK : (c + 1) * _CHUNK]
        if own.any():
            yield pa.RecordBatch.from_pydict({"doc_id": [None], "rk": [None], "n": [None], "k": [None], "cv": [None], "chunk": [c], "cells": [zlib.compress(own.tobytes(), 1)]}, schema=_FEATURES)


def _add_cells(table):
    total = np.zeros(_CHUNK, np.uint32)
    for x in table.column("cells"):
        total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "cells": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _signatures(shipped):
    def run(batches):
        sketch = shipped.value
        for batch in batches:
            for lo, hi, buf, offs in tb.slices(batch.column("text")):
                row, value = shingles(buf, offs)
                counts, key = set_hashes(row, value, hi - lo)
                order = np.lexsort((value, sketch[cell(value)], row))
                row, value = row[order], value[order]
                begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
                take = np.arange(len(row)) - begin[row] < prefix_size(counts)[row]
                yield pa.RecordBatch.from_arrays([pa.array(value[take].view(np.int64)), pa.array(key[row[take]])], names=["sig", "k"])

    return run


def _buckets(batches):
    """From rows sorted by (sig, k): (sig, lead, k) for buckets of two sets or more. A bucket is never held as a whole."""
    last_sig = lead = last_k = None
    waiting = False  # the bucket's first set is not written yet
    for batch in batches:
        sig, k = batch.column("sig").to_numpy(), batch.column("k").to_numpy()
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        carried = last_sig is not None and sig[0] == last_sig
        new[0] = not carried
        fresh = np.ones(len(sig), bool)
        fresh[1:] = new[1:] | (k[1:] != k[:-1])
        if carried:
            fresh[0] = k[0] != last_k
        at = np.flatnonzero(new)
        bucket = np.cumsum(new) - 1
        leads = np.where(bucket < 0, lead if carried else 0, k[at][np.maximum(bucket, 0)] if len(at) else 0)
        more = fresh & ~new  # a further set of its bucket
        write = more.copy()
        owners = np.unique(bucket[more])
        write[at[owners[owners >= 0]]] = True
        out_sig, out_lead, out_k = sig[write], leads[write], k[write]
        if carried and waiting and (owners == -1).any():
            out_sig, out_lead, out_k = np.append(out_sig, last_sig), np.append(out_lead, lead), np.append(out_k, lead)
            waiting = False
        if len(at):
            waiting = not (owners == len(at) - 1).any()
            lead = k[at[-1]]
        last_sig, last_k = sig[-1], k[-1]
        if len(out_sig):
            yield pa.RecordBatch.from_arrays([pa.array(out_sig), pa.array(out_lead), pa.array(out_k)], names=["sig", "lead", "k"])


class CountTree:
    """An R-tree of count vectors, packed by recursive halving along the widest coordinate.

    A node keeps the largest count of each group and the least number of shingles below it: no set below can
    share more with x than sum(min(x, largest)).
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rows: np.ndarray | None = None):
        self.rows = np.arange(len(points)) if rows is None else rows
        own = points[self.rows]
        self.top, self.least, self.most = own.max(0), int(sizes[self.rows].min()), int(sizes[self.rows].max())
        self.parts: list[CountTree] = []
        if len(self.rows) > LEAF:
            spread = own.max(0) - own.min(0)
            key = sizes[self.rows] if self.most * 4 > self.least * 5 else own[:, int(spread.argmax())]
            order = np.argsort(key, kind="stable")
            half = len(order) // 2
            self.parts = [CountTree(points, sizes, self.rows[order[:half]]), CountTree(points, sizes, self.rows[order[half:]])]

    def search(self, x: np.ndarray, n: int, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows whose bound allows a link with the set (x, n)."""
        if 5 * n < 4 * self.least or 5 * self.most < 4 * n or not enough(int(np.minimum(x, self.top).sum()), n, self.least):
            return np.zeros(0, np.int64)
        if self.parts:
            return np.concatenate([p.search(x, n, points, sizes) for p in self.parts])
        return self.rows[enough(np.minimum(points[self.rows], x).sum(1), n, sizes[self.rows])]


def _vectors(column, sizes: np.ndarray) -> np.ndarray:
    """Count vectors; a set without one (over 255 in a group) may have all its shingles in any group."""
    out = np.zeros((len(sizes), GROUPS), np.int32)
    for i, x in enumerate(column):
        raw = x.as_py()
        out[i] = np.frombuffer(raw, np.uint8) if raw is not None else sizes[i]
    return out


def _bounded(batches):
    """Pairs (a, b) that the bound on count vectors lets through."""
    for batch in batches:
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        shared = np.minimum(_vectors(batch.column("cva"), na), _vectors(batch.column("cvb"), nb)).sum(1)
        ok = pa.array(enough(np.minimum(shared, np.minimum(na, nb)), na.astype(np.int64), nb.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])


def _search_group(table):
    """Pairs of sets of one group (or of two of its blocks) that lie in different components and may link."""
    k, label, n, side = (table.column(c).to_numpy() for c in ("k", "label", "n", "side"))
    n = n.astype(np.int64)
    kinds, counts = np.unique(label, return_counts=True)
    minor = label != kinds[counts.argmax()]
    left, right = side != 2, side != 1  # 0: a block with itself; 1 and 2: one of two blocks
    points = _vectors(table.column("cv"), n)
    found: list[list[np.ndarray]] = [[], []]
    waiting = 0
    # pairs inside the largest component are not asked for, so one side of every pair is minor
    for asking, among in ((left & minor, right), (left & ~minor, right & minor)):
        if not asking.any() or not among.any():
            continue
        tree = CountTree(points, n, np.flatnonzero(among))
        for i in np.flatnonzero(asking):
            got = tree.search(points[i], int(n[i]), points, n)
            got = got[label[got] != label[i]]
            if side[i] == 0:  # met from both ends: kept from one
                got = got[~minor[got] | (k[got] > k[i])] if minor[i] else got[:0]
            found[0].append(np.minimum(k[got], k[i]))
            found[1].append(np.maximum(k[got], k[i]))
            waiting += len(got)
            if waiting > 1 << 16:
                yield _pairs(found)
                found, waiting = [[], []], 0
    yield _pairs(found)


def _pairs(found):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in found], names=["a", "b"])


def _one_text(batches):
    """(k, text) from rows sorted by rk: repeated rows once."""
    last = None
    for batch in batches:
        rk = batch.column("rk").to_numpy()
        new = np.ones(len(rk), bool)
        new[1:] = rk[1:] != rk[:-1]
        if len(rk):
            new[0] = rk[0] != last
            last = rk[-1]
        mask = pa.array(new)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("k", "text")], names=["k", "text"])


def _verify(batches):
    """Pairs (a, b) that link, from their texts."""
    last, known = None, None
    for batch in batches:
        a, b, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        for i in range(batch.num_rows):
            if a[i] != last:
                last, known = a[i], _set_of(batch.column("ta").slice(i, 1))
            other = _set_of(batch.column("tb").slice(i, 1))
            both = len(np.intersect1d(known, other, assume_unique=True))
            if enough(both, len(known), len(other)):
                out.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(out, pa.int64())) for c in ("a", "b")], names=["a", "b"])


def _set_of(text: pa.Array) -> np.ndarray:
    buf, offs = tb.raw_texts(text)
    return shingles(buf, offs)[1]


class Join:
    """The join over documents (doc_id, text), step by step."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.texts = docs.select(docs["doc_id"], docs["text"]).withColumn("rk", F.xxhash64("doc_id", "text"))
        made = self.texts.mapInArrow(_features, "doc_id long, rk long, n int, k long, cv binary, chunk int, cells binary")
        made = common.materialize(made, "shingle-sets")
        self.rows = made.filter(F.col("chunk").isNull()).select("doc_id", "rk", "n", "k", "cv")
        cells = made.filter(F.col("chunk").isNotNull()).select("chunk", "cells").groupBy("chunk").applyInArrow(_add_cells, "chunk int, cells binary")
        self.sketch = np.zeros(CELLS, np.uint32)
        for r in cells.collect():  # CELLS counters, whatever the input
            self.sketch[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(zlib.decompress(r.cells), np.uint32)
        sets = self.rows.filter(F.col("n") > 0).groupBy("k").agg(F.min("rk").alias("rk"), F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("cv").alias("cv"))
        self.sets = common.materialize(sets, "distinct-sets")

    def buckets(self) -> DataFrame:
        """(sig, k, w): members of buckets of two sets or more; w is the company that a set has in all its buckets."""
        shipped = self.spark.sparkContext.broadcast(self.sketch)
        parts = max(12, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows = self.texts.select("text").filter(F.col("text") != "").mapInArrow(_signatures(shipped), "sig long, k long")
        rows = rows.repartition(parts, "sig").sortWithinPartitions("sig", "k")
        met = common.materialize(rows.mapInArrow(_buckets, "sig long, lead long, k long").select("sig", "k"), "buckets")
        sizes = common.materialize(met.groupBy("sig").agg(F.count("*").alias("n")), "bucket-sizes")
        company = common.materialize(met.join(sizes, "sig").groupBy("k").agg(F.sum("n").alias("w")), "company")
        common.discard(sizes)
        ranked = common.materialize(met.join(company, "k").select("sig", "k", "w"), "ranked-buckets")
        common.discard(met, company)
        return ranked

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) whose sets link."""
        own = self.sets.select("k", "n", "cv")
        pairs = pairs.join(own.toDF("a", "na", "cva"), "a").join(own.toDF("b", "nb", "cvb"), "b")
        pairs = pairs.filter((F.col("na") * 5 >= F.col("nb") * 4) & (F.col("nb") * 5 >= F.col("na") * 4))
        pairs = common.materialize(pairs.mapInArrow(_bounded, "a long, b long"), "pairs")
        # only texts that the bound left to compare are moved
        asked = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        asked = common.materialize(asked.join(self.sets.select("k", "rk"), "k"), "compared")
        texts = self.texts.select("rk", "text").filter(common.sieve(asked, "rk")("rk")).join(asked.hint("merge"), "rk")
        texts = common.materialize(texts.select("rk", "k", "text").mapInArrow(_one_text, "k long, text string"), "compared-texts")
        met = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta").hint("merge"), "a").select("a", "b", "ta", "tb")
        links = common.materialize(met.mapInArrow(_verify, "a long, b long").distinct(), "links")
        common.discard(pairs, asked, texts)
        return links

    def first_pairs(self, buckets: DataFrame) -> DataFrame:
        """Every member of a bucket with its most central one."""
        lead = buckets.groupBy("sig").agg(F.max(F.struct("w", "k"))["k"].alias("a"))
        return buckets.join(lead, "sig").filter("a <> k").select("a", F.col("k").alias("b")).distinct()

    def _mixed(self, buckets: DataFrame, labels: DataFrame) -> DataFrame:
        """(sig, k, w, label, lo) of the buckets that hold different components; lo is the smallest of them."""
        known = buckets.join(labels.toDF("k", "label"), "k", "left").withColumn("label", F.coalesce("label", "k"))
        mixed = known.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("sig", "lo")
        mixed = common.materialize(mixed, "mixed-buckets")
        made = common.materialize(known.join(mixed, "sig").select("sig", "k", "w", "label", "lo"), "mixed")
        common.discard(mixed)
        return made

    def rest(self, mixed: DataFrame) -> DataFrame:
        """Pairs of different components that share a bucket and pass the bound."""
        members = common.materialize(mixed.select("lo", "k", "label").distinct(), "rest-members")
        sizes = members.groupBy("lo").agg(F.count("*").alias("c")).withColumn("blocks", F.ceil(F.col("c") / F.least(F.lit(BLOCK_MOST), F.greatest(F.lit(BLOCK_LEAST), 32 * F.sqrt("c")))).cast("int")).select("lo", "blocks")
        rows = members.join(common.materialize(sizes, "rest-sizes"), "lo").join(self.sets.select("k", "n", "cv"), "k")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        rows = rows.select("lo", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "k", "label", "n", "cv", side.alias("side"))
        return rows.repartition("lo", "x", "y").sortWithinPartitions("lo", "x", "y").mapInArrow(_by_group, "a long, b long").distinct()

    def labels(self) -> DataFrame:
        """(node, label) of every set that links with another."""
        buckets = self.buckets()
        links = self.linked(self.first_pairs(buckets))
        known = common.materialize(nearby(links), "nearby")
        rest = self.linked(self.rest(self._mixed(buckets, known)))
        return common.materialize(components(links.union(rest)), "labels")

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        labels = self.labels()
        placed = self.sets.select("k", "doc_id").join(labels.toDF("k", "label"), "k", "left").withColumn("label", F.coalesce("label", "k"))
        least = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = placed.join(least, "label").select("k", "component_id")
        rows = self.rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("k")).alias("k"))
        alone = rows.filter(F.col("k").isNull()).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return rows.filter(F.col("k").isNotNull()).join(named, "k").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").union(alone)

    def chosen(self) -> DataFrame:
        """(rk, copies): the row hash chosen of each component, and how many rows have it."""
        rows = self.rows.groupBy("rk").agg(F.first("k").alias("k"), F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
        rows = common.materialize(rows, "distinct-rows")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", "copies")
        sets = rows.filter(F.col("n") > 0).groupBy("k").agg(F.min(order).alias("least"))
        placed = sets.join(self.labels().toDF("k", "label"), "k", "left").withColumn("label", F.coalesce("label", "k"))
        least = placed.groupBy("label").agg(F.min("least").alias("least")).select("least.rk", "least.copies")
        return least.union(rows.filter(F.col("n") == 0).select("rk", "copies"))


def _by_group(batches):
    """Streams rows sorted by group into one search a group."""
    held: list[pa.Table] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("lo", "x", "y")], 1)
        cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(keys[a])
            if key is not None and own != key:
                yield from _search_group(pa.concat_tables(held))
                held = []
            key = own
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield from _search_group(pa.concat_tables(held))


def keep_one(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """docs with one (doc_id, text) of each component: that of the smallest id (null ids last), and of its smallest row hash.

    Texts without words are each their own component. repeats: whether further rows of the chosen (doc_id, text)
    stay as well; without them every component keeps one row, that of the smallest hash over all its columns.
    """
    rk, n, mark = f"{common.OWN}rk", f"{common.OWN}n", f"{common.OWN}row"
    keyed = docs.select("*", F.xxhash64(docs["doc_id"], docs["text"]).alias(rk))
    kept = keyed.join(Join(docs).chosen().toDF(rk, n), rk)
    if repeats:
        return kept.select(*[kept[c] for c in docs.columns])
    one = kept.filter(F.col(n) == 1).select(*docs.columns)
    more = kept.filter(F.col(n) > 1).select(rk, F.xxhash64(*docs.columns).alias(mark), F.struct(*docs.columns).alias(f"{common.OWN}all"))
    first = more.groupBy(rk).agg(F.min_by(f"{common.OWN}all", mark).alias(f"{common.OWN}all"))
    return one.union(first.select(f"{common.OWN}all.*"))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return Join(common.table(spark, sf_dir, "documents")).result()


OP7_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS x FROM d, LATERAL (SELECT unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, CASE WHEN e.a = r.v THEN e.b ELSE e.a END FROM r JOIN e ON e.a = r.v OR e.b = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT u, min(v) AS component_id FROM r GROUP BY 1) c ON c.u = d.doc_id
"""


def brute(texts: list[str | None], size: int = SHINGLE) -> list[tuple[int, int]]:
    """(set size, number of the first text of the component) by comparing all pairs, for tests."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for t in texts:
        ws = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set())
    owner = list(range(len(sets)))

    def top(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and enough(len(a & b), len(a), len(b)):
                x, y = top(i), top(j)
                owner[max(x, y)] = min(x, y)
    return [(len(s), top(i)) for i, s in enumerate(sets)]
