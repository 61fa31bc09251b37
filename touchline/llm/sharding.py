"""Shards of bounded bytes by extendible hashing.

A row's key is hashed to 60 bits; a shard is a prefix of them. The directory starts with one empty
prefix, and only prefixes whose rows exceed the byte limit split on another bit. Splitting needs no
pass over the rows for each bit: one aggregation gives the bytes of all cells of `LEVELS[0]` bits, at most 65,536, from
which the first part of the directory is computed; it is broadcast. Cells that are still too large are counted by more
bits, level by level. Those parts of the directory stay tables of a row a cell, computed in groups of one
cell of the level before (at most 4096 rows, however hot a key is) and met by joins, so no part that grows with
the input comes to the driver. Most inputs need one level: 65,536 shards of 16 MiB are a terabyte.

Rows that no bit separates (equal keys, or one row over the limit) overflow into pages: tasks fill
pages of at most the limit in scan order, so a hot key needs no group. A single row larger than the limit has
a page of its own, the only kind of shard over the limit.

Defined results: null or empty texts weigh 0 bytes; a null key is the text "null"; repeated rows
are rows; an empty table has no shards; columns of the table with the names of new ones (shard, depth, n_bytes) are
kept apart by `prefix`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import common

BITS = 60
LEVELS = (16, 28, 40, 52, 60)
LIMIT_BYTES = 16 << 20
#: The registered query's limit; small, so that small tables split as well.
QUERY_LIMIT_BYTES = 256 << 10
_H, _DEPTH, _OVER = f"{common.OWN}hash", f"{common.OWN}depth", f"{common.OWN}over"


def key_hash(col) -> object:
    """The first 60 bits of the md5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("null")).cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def split(cell: np.ndarray, size: np.ndarray, bits: int, depth: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(depth of its shard, whether that is over the limit) of each cell of `bits` bits, of which the first `depth` are split already."""
    found, over = np.full(len(cell), bits, np.int32), np.zeros(len(cell), bool)
    open_ = np.ones(len(cell), bool)
    for d in range(depth, bits + 1):
        if not open_.any():
            break
        _, slot = np.unique(cell[open_] >> (bits - d), return_inverse=True)
        total = np.bincount(slot, size[open_])
        at = np.flatnonzero(open_)
        done = total[slot] <= limit
        found[at[done]] = d
        open_[at[done]] = False
        if d == bits:
            over[at[~done]] = True
    return found, over


_PART = "cell long, depth int, over boolean"


def _parts(cells: pa.Table, bits: int, depth: int, limit: int) -> pa.Table:
    cell = cells.column("cell").to_numpy()
    found, over = split(cell, cells.column("size").to_numpy().astype(float), bits, depth, limit)
    return pa.table({"cell": cell, "depth": pa.array(found), "over": pa.array(over)})


def _splitter(bits: int, depth: int, limit: int):
    def run(cells: pa.Table) -> pa.Table:
        return _parts(cells, bits, depth, limit)

    return run


def directory(hashes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """[(bits, table of (cell, depth, over))]: the directory by levels; over: cells that the next level splits, if there is one.

    hashes: h and n_bytes.
    """
    made: list[tuple[int, DataFrame]] = []
    rows, before = hashes, 0
    for bits in LEVELS:
        cells = rows.groupBy(F.shiftright("h", BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("size"))
        if not made:
            part = _parts(cells.toArrow(), bits, 0, limit)  # at most 2 ** LEVELS[0] rows
            own = hashes.sparkSession.createDataFrame(part)
        else:
            own = common.materialize(cells.groupBy(F.shiftright("cell", bits - before).alias("base")).applyInArrow(_splitter(bits, before, limit), _PART), "shard-cells")
        made.append((bits, own))
        large = own.filter("over").select(F.col("cell").alias("large"))
        if large.isEmpty():
            break
        rows, before = rows.join(large, F.shiftright("h", BITS - bits) == F.col("large"), "left_semi"), bits
    return made


def _pages(limit: int, shard: str, n_bytes: str):
    def run(batches):
        from pyspark import TaskContext

        task, page, used = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            out = []
            for base, n in zip(batch.column(shard).to_pylist(), batch.column(n_bytes).to_pylist(), strict=True):
                if base in used and used[base] + n > limit:
                    page[base] = page.get(base, 0) + 1
                    used[base] = 0
                used[base] = used.get(base, 0) + n
                out.append(f"{base}+{task}.{page.get(base, 0)}")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == shard else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return run


def assign(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES, prefix: str = "") -> DataFrame:
    """The columns `keep`, shard (its bits; overflow pages carry "+task.page"), depth and n_bytes. prefix: put before these three names."""
    shard, depth, n_bytes = (f"{prefix}{c}" for c in ("shard", "depth", "n_bytes"))
    sizes = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("bigint")
    levels = directory(docs.select(key_hash(docs[key]).alias("h"), sizes.alias("n_bytes")), limit)
    rows = docs.select(*[docs[c] for c in keep], key_hash(docs[key]).alias(_H), sizes.alias(n_bytes))
    found = over = None
    for i, (bits, part) in enumerate(levels):
        cell, d, o = (f"{common.OWN}{c}{i}" for c in ("cell", "depth", "over"))
        last = i == len(levels) - 1
        part = part.select(F.col("cell").alias(cell), F.col("depth").alias(d), F.col("over").alias(o))
        part = part if last else part.filter(~F.col(o))
        rows = rows.join(F.broadcast(part) if i == 0 else part, F.shiftright(rows[_H], BITS - bits) == part[cell], "left")
        found = F.col(d) if found is None else F.coalesce(found, F.col(d))
        over = F.coalesce(F.col(o), F.lit(False)) if last else None
    bits = F.lpad(F.bin(_H), BITS, "0")
    rows = rows.withColumns({_DEPTH: found, _OVER: over})
    rows = rows.select(*keep, F.substring(bits, F.lit(1), F.col(_DEPTH)).alias(shard), F.col(_DEPTH).alias(depth), n_bytes, _OVER)
    whole = rows.filter(~F.col(_OVER)).drop(_OVER)
    if len(levels) < len(LEVELS):
        return whole
    pages = rows.filter(F.col(_OVER)).drop(_OVER)
    return whole.unionByName(pages.mapInArrow(_pages(limit, shard, n_bytes), whole.schema))


def write(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, text: str = "text", **names) -> DataFrame:
    """Writes docs as one folder a shard and returns (shard, n_rows, n_bytes), counted in what was written."""
    made = assign(docs, docs.columns, limit=limit, text=text, prefix=common.OWN, **names).drop(f"{common.OWN}depth", f"{common.OWN}n_bytes")
    folder = f"{common.OWN}shard" if "shard" in (c.lower() for c in docs.columns) else "shard"
    made = made.withColumnRenamed(f"{common.OWN}shard", folder)
    made.repartition(folder).write.partitionBy(folder).parquet(path)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    back = docs.sparkSession.read.schema(kinds).parquet(path)
    return back.groupBy(back[folder].alias("shard")).agg(F.count("*").alias("n_rows"), F.sum(F.coalesce(F.octet_length(back[text]), F.lit(0)).cast("long")).alias("n_bytes"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(common.table(spark, sf_dir, "documents"), ["doc_id"], limit=QUERY_LIMIT_BYTES)


OP6_SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
cell AS (SELECT d::INTEGER AS d, h >> (60 - d::INTEGER) AS p, sum(n_bytes) AS s FROM r, range(0, 21) t(d) GROUP BY 1, 2),
leaf AS (
  SELECT r.doc_id, r.n_bytes, r.h, min(c.d) AS depth FROM r JOIN cell c ON c.p = r.h >> (60 - c.d) AND c.s <= {QUERY_LIMIT_BYTES} GROUP BY 1, 2, 3)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard, depth, n_bytes FROM leaf
"""
