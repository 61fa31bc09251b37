"""Quality scores from a factorisation machine.

Inputs of a text: hashed words (their counts, scaled to unit length), structure statistics
(`STATISTICS`) and the n_chars column as metadata. The machine adds to a linear model all pairwise
interactions of its inputs through `RANK` factors per input, scored in linear time by

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

It is fitted by AdaGrad on at most `TRAIN_ROWS` labelled rows, those with the smallest hash of
their id in folds 1 to 4; fold 0 is held out. Label, language, source and id are never inputs. The
model is `BUCKETS` x (RANK + 1) floats whatever the input, so it is broadcast; scoring is one scan.

Defined results: null or empty texts have all inputs 0 (and are scored); a null n_chars is taken
from the text; repeated labels of an id count once (the larger); without labels of both classes
every score is the smoothed share of good labels; repeated rows are scored one by one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import common
from touchline.llm import textbytes as tb

HASHED = 1 << 16
RANK = 8
TRAIN_ROWS = 8_000
EPOCHS = 8
BATCH = 128
STATISTICS = ("words", "distinct", "word_length", "letters", "upper", "digits", "space", "breaks", "stops", "pipes", "marks", "high", "same_next", "top_word", "lone", "n_chars")
BUCKETS = HASHED + len(STATISTICS)

_CLASS = np.zeros(256, np.uint8)  # 1 lower or non-ASCII, 2 upper, 3 digit, 4 space, 5 break, 6 stop, 7 pipe, 8 mark
_CLASS[:] = 8
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9]] = 4
_CLASS[[10, 13, 11, 12]] = 5
_CLASS[[33, 44, 45, 46, 58, 59, 63, 39, 34, 40, 41]] = 6
_CLASS[124] = 7


def inputs(buf: np.ndarray, offs: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, input, value) of all nonzero inputs, sorted by row."""
    n = len(offs) - 1
    starts, ends, first = tb.words(buf, offs, tb.SPACED)
    counts = np.diff(first)
    row = np.repeat(np.arange(n), counts)
    h = tb.word_hashes(buf, starts, ends)
    key, times = np.unique((row.astype(np.int64) << 16) | (h & np.uint64(HASHED - 1)).astype(np.int64), return_counts=True)
    at, bucket = key >> 16, key & (HASHED - 1)
    norm = np.sqrt(np.bincount(at, times.astype(float) ** 2, n))
    size = np.diff(offs)
    full = np.maximum(size, 1)
    kinds = np.zeros((n, 9))
    cls = _CLASS[buf]
    live = np.flatnonzero(size)
    for k in range(1, 9):
        if len(live):
            kinds[live, k] = np.add.reduceat(cls == k, offs[:-1][live], dtype=np.int64)
    some = np.maximum(counts, 1)
    distinct = np.bincount(at, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, at, times)
    lone = np.bincount(at, times == 1, n)
    same = np.zeros(n)
    if len(h) > 1:
        pair = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        same = np.bincount(row[1:], pair, n)
    stats = np.stack(
        [
            np.log1p(counts) / 8, distinct / some, np.minimum((np.bincount(row, ends - starts, n)) / some / 12, 3), kinds[:, 1] / full, 4 * kinds[:, 2] / full, 4 * kinds[:, 3] / full,
            4 * kinds[:, 4] / full, 8 * kinds[:, 5] / full, 8 * kinds[:, 6] / full, 8 * kinds[:, 7] / full, 4 * kinds[:, 8] / full, np.log1p(size / some) / 4, 4 * same / some,
            2 * top / some, lone / some, np.log1p(np.maximum(n_chars, 0)) / 10,
        ],
        1,
    )
    stats[size == 0] = 0
    r, c = np.nonzero(stats)
    rows = np.concatenate([at, r])
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate([bucket, c + HASHED])[order], np.concatenate([times / np.maximum(norm[at], 1e-9), stats[r, c]])[order]


def raw_scores(row, col, val, n: int, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The machine's output for n rows, in linear time."""
    out = w0 + np.bincount(row, w[col] * val, n)
    for f in range(v.shape[1]):
        part = v[col, f] * val
        out += 0.5 * (np.bincount(row, part, n) ** 2 - np.bincount(row, part * part, n))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """(constant, weights, factors) from the (inputs, values) of each row."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(BUCKETS), rng.normal(0, 0.02, (BUCKETS, RANK))
    w0 = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    gw, gv, g0 = np.full(BUCKETS, 1e-3), np.full((BUCKETS, RANK), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            size = np.array([len(rows[i][0]) for i in own])
            col = np.concatenate([rows[i][0] for i in own])
            val = np.concatenate([rows[i][1] for i in own])
            row = np.repeat(np.arange(len(own)), size)
            part = v[col] * val[:, None]
            sums = np.stack([np.bincount(row, part[:, f], len(own)) for f in range(RANK)], 1)
            out = w0 + np.bincount(row, w[col] * val, len(own)) + 0.5 * (sums**2 - np.stack([np.bincount(row, part[:, f] ** 2, len(own)) for f in range(RANK)], 1)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[own]) / len(own)
            used, slot = np.unique(col, return_inverse=True)
            dw = np.bincount(slot, err[row] * val, len(used)) + 1e-6 * w[used]
            each = (err[row] * val)[:, None] * (sums[row] - part)
            dv = np.stack([np.bincount(slot, each[:, f], len(used)) for f in range(RANK)], 1) + 1e-5 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= 0.1 * dw / np.sqrt(gw[used])
            v[used] -= 0.05 * dv / np.sqrt(gv[used])
            g0 += err.sum() ** 2
            w0 -= 0.1 * err.sum() / np.sqrt(g0)
    return w0, w, v


def _inputs_rows(batches):
    for batch in batches:
        labels = batch.column("quality").to_pylist()
        n_chars = _chars(batch)
        for lo, hi, buf, offs in tb.slices(batch.column("text")):
            row, col, val = inputs(buf, offs, n_chars[lo:hi])
            cuts = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(labels[lo:hi], pa.int32()),
                    pa.array([zlib.compress(np.diff(col[a:b], prepend=0).astype(np.int32).tobytes(), 1) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([zlib.compress(val[a:b].astype(np.float32).tobytes(), 1) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                ],
                names=["quality", "col", "val"],
            )


def _chars(batch) -> np.ndarray:
    return batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False)


def _score_rows(shipped, names):
    def run(batches):
        w0, w, v = shipped.value
        for batch in batches:
            n_chars = _chars(batch)
            parts = []
            for lo, hi, buf, offs in tb.slices(batch.column("text")):
                row, col, val = inputs(buf, offs, n_chars[lo:hi])
                parts.append(raw_scores(row, col, val, hi - lo, w0, w, v))
            x = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], names=[*names, f"{common.OWN}score"])

    return run


def score(docs: DataFrame, labels: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` of docs and the score, under `name`, for every row. labels: doc_id, quality."""
    spark = docs.sparkSession
    given = labels.select(labels["doc_id"], labels["quality"]).na.drop().groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    few = given.filter(common.crc_fold("doc_id") != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    length = F.coalesce(docs["n_chars"].cast("double"), F.length(docs["text"]).cast("double"), F.lit(0.0)) if "n_chars" in docs.columns else F.coalesce(F.length(docs["text"]).cast("double"), F.lit(0.0))
    sample = docs.select(docs["doc_id"], docs["text"], length.alias("n_chars")).join(F.broadcast(few), "doc_id").select("quality", "text", "n_chars")
    got = sample.mapInArrow(_inputs_rows, "quality int, col binary, val binary").toArrow()  # TRAIN_ROWS rows at most, but for repeated ids
    y = got.column("quality").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return docs.select(*[docs[c] for c in keep], F.lit(float(share)).alias(name))
    unpack = lambda x, kind: np.frombuffer(zlib.decompress(x.as_py()), kind)
    rows = [(np.cumsum(unpack(c, np.int32)).astype(np.int32), unpack(v, np.float32).astype(float)) for c, v in zip(got.column("col"), got.column("val"), strict=True)]
    order = np.lexsort((y, [len(c) for c, _ in rows], [float(v.sum()) for _, v in rows]))  # whatever order the rows came in
    w0, w, v = fit([rows[i] for i in order], y[order])
    shipped = spark.sparkContext.broadcast((w0, w.astype(np.float32), v.astype(np.float32)))
    wide = docs.select(*[docs[c] for c in keep if c not in ("text", "n_chars")], *([docs["text"].alias(f"{common.OWN}text")] if "text" in keep else []), *([docs["n_chars"].alias(f"{common.OWN}chars")] if "n_chars" in keep else []), docs["text"], length.alias("n_chars"))
    names = [{"text": f"{common.OWN}text", "n_chars": f"{common.OWN}chars"}.get(c, c) for c in keep]
    out = wide.mapInArrow(_score_rows(shipped, names), ", ".join(f"`{c}` {wide.schema[c].dataType.simpleString()}" for c in names) + f", {common.OWN}score double")
    return out.toDF(*keep, name)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    scored = score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", (common.crc_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
