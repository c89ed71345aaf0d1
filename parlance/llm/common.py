"""What the operators share on the driver's side: reading tables, folders that all executors see, broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch, where the session has no setting of its own; whole texts are large rows.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches for Python small in this session, unless it has a setting of its own. For callers; operators set nothing."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Without that setting a local one is set, on one machine only: a cluster's
    executors would not see each other's files there."""
    found = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "parlance-checkpoints"))
    return named or spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator or pipeline has written in the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of tables that have been cut off; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # the bridge to the JVM lets go of Python's objects a moment after they are collected
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


#: Words of 64 bits of the filter on ids.
FILTER_WORDS = 1 << 20


def near_ids(docs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of docs whose id may be one of ids (id): a filter of fixed size goes to all workers, and no row is shuffled.

    Rows of other ids pass by chance, so a join has the last word; rows without id do not pass."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * FILTER_WORDS))
    bits = ids.where("id is not null").select((spot("id") / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {64 * FILTER_WORDS}) % 64 as int))").alias("b"))
    words = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(FILTER_WORDS, np.int64)
    table[words["w"].to_numpy()] = words["b"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy()
            hit = np.flatnonzero((shared.value[at >> 6] >> (at & 63)) & 1)
            if len(hit):
                got = b.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays(got.columns[1:], got.schema.names[1:])

    return docs.where(F.col(id_col).isNotNull()).select(spot(id_col).alias("_spot"), *docs.columns).mapInArrow(scan, docs.schema)


def share_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Writes content to the shared folder and hands it to every executor, also to later ones; gives the name to look up with SparkFiles."""
    unique = f"{name}-{uuid.uuid4().hex}"
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{unique}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    sc.addFile(path.toString())
    return unique


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
