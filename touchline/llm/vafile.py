"""Exact top-k inner-product search with a vector-approximation file.

The file has two parts. Cells: per chunk and dimension a uniform grid of at most 256 cells between the chunk's
smallest and largest value of floor(1024 * x), one byte per component. Vectors: the exact ones, each
distinct vector once, with the smallest ids that carry it, so a vector that a third of all rows share is one row.

 1. Scan: the cells alone meet the blocks of queries, keyed by (part, block), so a task holds at most `PART_ROWS`
    cells rows and `BLOCK_QUERIES` queries at any input size. A cell's corners bound the inner product from both
    sides; vectors whose upper bound lies under the k-th best lower bound met so far are out.
 2. The k-th best lower bound of each query over all parts removes more of them.
 3. Read: exact vectors are fetched for the survivors only, in the order of their upper bounds: first the best
    `FIRST` * k of each query, then those whose bound is not under the k-th exact score found.

Components are whole numbers of any size: bounds are taken in floating point and widened by more than its error,
scores are summed in 64-bit integers where these are wide enough, otherwise in Python's.

Defined results: vectors that are null, or hold null or non-finite components, or rows without an id, take no part;
vectors meet only vectors of as many components; a query meets every row but those with its own id; of
repeated query ids the smallest vector asks; repeated candidate rows are rows of their own; ties go to
the smaller id; a score beyond 64 bits is ranked exactly and shown as the nearest 64-bit number; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import common

SCALE = 1024
CHUNK_ROWS = 8192
PART_ROWS = 1 << 15
BLOCK_QUERIES = 4096
FIRST = 4
#: Bounds are widened by this share of the largest sum of products; the error of a sum of d terms is under d * 2**-52 of it.
SLACK = 2.0**-36


class Index(NamedTuple):
    """cells: the chunks of the approximation file; vectors: (row, vector, ids)."""

    cells: DataFrame
    vectors: DataFrame


def _matrix(column: pa.Array):
    """(rows, matrix of floor(1024 * x) as floats) for each number of components in a column of finite vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    with np.errstate(over="ignore"):
        flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    at = np.concatenate(([0], np.cumsum(sizes)))
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, flat[(at[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)


def grid(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower edge, cell width, codes) of each component of a matrix; a value lies at most width - 1 above its cell's edge."""
    if not m.size:
        return np.zeros(m.shape[1]), np.ones(m.shape[1]), np.zeros(m.shape, np.uint8)
    with np.errstate(over="ignore", invalid="ignore"):
        low = m.min(0)
        width = np.floor((m.max(0) - low) / 256) + 1
        codes = np.floor((m - low) / width)
    return low, width, np.clip(np.nan_to_num(codes), 0, 255).astype(np.uint8)


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of each query with each coded vector."""
    with np.errstate(over="ignore", invalid="ignore"):
        edge = (q * width) @ codes.T.astype(np.float64) + (q @ low)[:, None]
        most = np.maximum(np.abs(low), np.abs(low + 256 * width))
        slack = (np.abs(q) @ most)[:, None] * SLACK
        up = edge + (np.maximum(q, 0) @ (width - 1))[:, None] + slack
        down = edge + (np.minimum(q, 0) @ (width - 1))[:, None] - slack
    return np.where(np.isfinite(down), down, -np.inf), np.where(np.isfinite(up), up, np.inf)


def _pack(batches):
    """Chunks of cells."""
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK_ROWS):
            own = batch.slice(lo, CHUNK_ROWS)
            row, sole = (own.column(c).to_numpy(zero_copy_only=False) for c in ("row", "sole"))
            alone = own.column("alone").to_numpy(zero_copy_only=False)
            for d, rows, m in _matrix(own.column("vector")):
                low, width, codes = grid(m)
                yield pa.RecordBatch.from_pydict(
                    {"dim": [d], "n": [len(rows)], "rows": [row[rows].tobytes()], "sole": [sole[rows].tobytes()], "alone": [alone[rows].astype(np.uint8).tobytes()], "low": [low.tobytes()], "width": [width.tobytes()], "codes": [codes.tobytes()]},
                    schema=_CELLS_ARROW,
                )


_CELLS_ARROW = pa.schema([("dim", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("rows", "sole", "alone", "low", "width", "codes"))])
_CELLS = "dim int, n int, rows binary, sole binary, alone binary, low binary, width binary, codes binary"
_FOUND = pa.schema([("query_id", pa.int64()), ("row", pa.int64()), ("down", pa.float64()), ("up", pa.float64())])


def _sound(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = df[vector_col].cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.filter(df[id_col].isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False))).select(df[id_col].cast("long").alias("id"), x.alias("vector"))


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k_most: int = 64) -> Index:
    """The file of every sound vector, written to shared storage, for searches of up to k_most results.

    A distinct vector keeps its k_most + 1 smallest ids and how many rows each has: no search can return more of it.
    """
    each = _sound(vectors, id_col, vector_col).groupBy("vector", "id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = each.withColumn("r", rank).filter(F.col("r") <= k_most + 1)
    distinct = few.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids"))
    exact = common.materialize(distinct.select(F.monotonically_increasing_id().alias("row"), "vector", "ids"), "va-vectors")
    packed = exact.select("row", "vector", F.col("ids")[0]["id"].alias("sole"), (F.size("ids") == 1).alias("alone")).mapInArrow(_pack, _CELLS)
    return Index(common.materialize(packed, "va-cells"), exact)


def search_chunk(chunk: dict, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query ids, vector ids, scores) of the k best of one chunk that is at hand with its exact vectors; also how many of these were read."""
    d, ids = chunk["dim"], np.frombuffer(chunk["ids"], np.int64)
    low, width = (np.frombuffer(chunk[c], np.int64).astype(float) for c in ("low", "width"))
    codes = np.frombuffer(chunk["codes"], np.uint8).reshape(len(ids), d)
    exact = np.frombuffer(chunk["exact"], np.int32).reshape(len(ids), d)
    down, up = bounds(queries.astype(float), low, width, codes)
    out, read = [], 0
    for j, qid in enumerate(query_ids):
        open_ = np.flatnonzero(ids != qid)
        if len(open_) > k:
            open_ = open_[up[j][open_] >= np.partition(down[j][open_], len(open_) - k)[len(open_) - k]]
        open_ = open_[np.argsort(-up[j][open_], kind="stable")]
        best, rows, step = np.zeros(0, np.int64), np.zeros(0, np.int64), FIRST * k
        for at in range(0, len(open_), step):
            if len(best) == k and best[-1] > up[j][open_[at]]:
                break
            take = open_[at : at + step]
            read += len(take)
            best, rows = np.concatenate([best, exact[take].astype(np.int64) @ queries[j]]), np.concatenate([rows, take])
            keep = np.lexsort((ids[rows], -best))[:k]
            best, rows = best[keep], rows[keep]
        out.append((np.full(len(best), qid), ids[rows], best))
    return out, read


def _scan(k: int):
    """(query_id, row, down, up) of the vectors of a part that no k others of it shut out."""

    def run(_, cells: pa.Table, blocks: pa.Table):
        found = []
        chunks = cells.to_pylist()
        for c in chunks:
            c |= {"rows": np.frombuffer(c["rows"], np.int64), "sole": np.frombuffer(c["sole"], np.int64), "alone": np.frombuffer(c["alone"], np.uint8) > 0, "low": np.frombuffer(c["low"]), "width": np.frombuffer(c["width"])}
            c["codes"] = np.frombuffer(c["codes"], np.uint8).reshape(c["n"], c["dim"])
        for d, rows, q in _matrix(blocks.column("vector").combine_chunks()):
            qids = blocks.column("id").to_numpy()[rows]
            for lo in range(0, len(qids), 256):
                own, best = qids[lo : lo + 256], np.full((len(qids[lo : lo + 256]), k), -np.inf)
                open_ = []
                for c in chunks:
                    if c["dim"] != d:
                        continue
                    down, up = bounds(q[lo : lo + 256], c["low"], c["width"], c["codes"])
                    self_ = (own[:, None] == c["sole"]) & c["alone"]  # nobody else has this vector
                    down[self_], up[self_] = -np.inf, np.nan
                    best = np.partition(np.concatenate([best, down], 1), down.shape[1], 1)[:, down.shape[1] :]
                    j, i = np.nonzero(up >= best.min(1)[:, None])
                    open_.append((own[j], c["rows"][i], down[j, i], up[j, i], best.min(1)[j]))
                if open_:
                    last = best.min(1)
                    at = {int(x): v for x, v in zip(own, last, strict=True)}
                    cols = [np.concatenate([x[n] for x in open_]) for n in range(4)]
                    keep = cols[3] >= np.array([at[int(x)] for x in cols[0]]) if len(cols[0]) else np.zeros(0, bool)
                    found.append([x[keep] for x in cols])
        cols = [np.concatenate([f[n] for f in found]) if found else np.zeros(0) for n in range(4)]
        return pa.table([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int64, float, float), strict=True)], schema=_FOUND)

    return run


def _whole(x: float) -> int:
    """floor(1024 * x), exactly."""
    y = SCALE * x
    return math.floor(y) if math.isfinite(y) else SCALE * int(x)


def _rank_key(score: int) -> bytes:
    """Bytes in the order of whole numbers of any size."""
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + raw if score >= 0 else b"\0" + bytes(255 - x for x in raw) + b"\xff"


def _exact(batches):
    """(query_id, score, key, least, ids): the exact score of each pair; least is a floating-point number not above it."""
    for batch in batches:
        scores: list[int] = []
        a, b = batch.column("asked"), batch.column("vector")
        size = np.diff(b.offsets.to_numpy())
        cut = np.concatenate(([0], np.cumsum(size)))
        x, y = (c.flatten().to_numpy(zero_copy_only=False) for c in (a, b))
        with np.errstate(over="ignore"):
            most = (max(np.abs(x).max(initial=0), 1.0) * SCALE + 1) * (max(np.abs(y).max(initial=0), 1.0) * SCALE + 1) * max(size.max(initial=0), 1)
        if most < 2.0**62:
            products = np.append(np.floor(SCALE * x).astype(np.int64) * np.floor(SCALE * y).astype(np.int64), 0)
            sums = np.concatenate(([0], np.cumsum(products)))  # wraps around, and differences wrap back
            scores = (sums[cut[1:]] - sums[cut[:-1]]).tolist()
        else:
            scores = [sum(_whole(u) * _whole(v) for u, v in zip(x[i:j].tolist(), y[i:j].tolist(), strict=True)) for i, j in zip(cut, cut[1:])]
        top = sys.float_info.max
        least = [math.nextafter(float(s), -math.inf) if abs(s) < 1 << 1000 else (top if s > 0 else -math.inf) for s in scores]
        shown = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores]
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(shown, pa.int64()), pa.array([_rank_key(s) for s in scores], pa.binary()), pa.array(least, pa.float64()), batch.column("ids")], names=["query_id", "score", "key", "least", "ids"])


def search(index: Index, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of the index for each query."""
    cells, vectors = index
    asked = _sound(queries, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = common.materialize(asked, "va-queries")
    rows, asking = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], asked.count()
    parts, n_blocks = max(1, -(-int(rows) // PART_ROWS), min(12, -(-int(rows) // 1024))), max(1, -(-int(asking) // BLOCK_QUERIES))
    left = cells.withColumn("part", F.pmod(F.xxhash64("rows"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_scan(k), "query_id long, row long, down double, up double")
    of_query = Window.partitionBy("query_id")
    found = found.withColumn("r_down", F.row_number().over(of_query.orderBy(F.col("down").desc(), "row"))).withColumn("r_up", F.row_number().over(of_query.orderBy(F.col("up").desc(), "row")))
    kth = F.max(F.when(F.col("r_down") == k, F.col("down"))).over(of_query)
    open_ = common.materialize(found.withColumn("kth", kth).filter(F.col("kth").isNull() | (F.col("up") >= F.col("kth"))).select("query_id", "row", "up", "r_up"), "va-candidates")

    def read(pairs: DataFrame) -> DataFrame:
        met = pairs.select("query_id", "row").join(vectors, "row").join(asked.toDF("query_id", "asked"), "query_id").select("query_id", "asked", "vector", "ids")
        return common.materialize(met.mapInArrow(_exact, "query_id long, score long, key binary, least double, ids array<struct<id:long,n:long>>"), "va-scores")

    first = read(open_.filter(F.col("r_up") <= FIRST * k))
    kth = first.withColumn("r", F.row_number().over(of_query.orderBy(F.col("key").desc()))).filter(F.col("r") == k).select("query_id", "least")
    later = open_.filter(F.col("r_up") > FIRST * k).join(kth, "query_id", "left").filter(F.col("least").isNull() | (F.col("up") >= F.col("least")))
    every = first.unionByName(read(later)).withColumn("x", F.explode("ids")).filter(F.col("x.id") != F.col("query_id"))
    every = every.select("query_id", F.col("x.id").alias("vec_id"), "score", "key", F.explode(F.sequence(F.lit(1), F.least(F.col("x.n"), F.lit(k)))).alias("copy"))
    best = F.row_number().over(of_query.orderBy(F.col("key").desc(), "vec_id"))
    return every.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_vafile(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(build(vectors, k_most=10), vectors.filter(vectors["vec_id"] % 100 == 0), 10)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
