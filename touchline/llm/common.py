"""Shared plumbing of the training-data operators: tables, shared storage and Arrow helpers."""

from __future__ import annotations

import importlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions sent to executors travel by value, so executors need no copy of this package; nor may a module of it
# hold the name of a package above this one.
cloudpickle.register_pickle_by_value(importlib.import_module(__package__))

HELD_OUT_FOLDS = 5
#: Columns that an operator adds for itself start so; tables bring no such names.
OWN = "_touchline_"
BATCH_BYTES = 8 << 20
#: Share of the driver's heap by which garbage may grow between two tables that are written.
HEAP_SHARE = 0.15
_collected = {"used": 0}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker is handed at once by bytes, whatever the length of texts (a longer row comes alone)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="touchline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to shared storage and read again: cuts lineage and survives lost executors."""
    small_batches(df.sparkSession)
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    tidy(df.sparkSession)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.touchline_path = path
    return made


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage once that has grown by HEAP_SHARE of its heap.

    Operators run many short plans. Left alone, the heap fills up with them to its limit before it is collected, and shuffle
    files and broadcasts of plans that nothing holds any more stay until then.
    """
    jvm = spark._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > _collected["used"] + HEAP_SHARE * heap.maxMemory():
        jvm.java.lang.System.gc()
        _collected["used"] = heap.totalMemory() - heap.freeMemory()


def discard(*made: DataFrame) -> None:
    """Deletes what `materialize` wrote, once nothing that is still to be computed reads it."""
    for df in made:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.touchline_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sieve(keys: DataFrame, key: str, most_bits: int = 1 << 26):
    """A test of a column of 64-bit hashes: false only for those that are surely not among keys.

    A bitmap of 16 bits a key, of at most `most_bits` bits (8 MB) whatever the input, is broadcast. It only saves
    the shuffle of rows that a join would drop: with more keys it lets more rows through, and the join decides.
    """
    spark = keys.sparkSession
    bits = min(most_bits, 1 << max(16, (16 * keys.count()).bit_length()))
    at = F.pmod(F.col(key), F.lit(bits))
    words = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    shipped = spark.sparkContext.broadcast(table.tobytes())

    @F.arrow_udf("boolean")
    def maybe(k: pa.Array) -> pa.Array:
        own = k.to_numpy(zero_copy_only=False) % bits
        word = np.frombuffer(shipped.value, np.uint64)[own >> 6]
        return pa.array((word >> (own & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return maybe


def crc_fold(col) -> object:
    """crc32 of the id's decimal text, modulo 5; fold 0 is held out. Null ids are never learned from."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % HELD_OUT_FOLDS, F.lit(0))


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns, whatever else (in whatever letter case) the table carries."""
    return df.select(*[df[c] for c in cols])


def batch_of(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type) for f in schema],
        schema=schema,
    )
