"""Tables that must outlive the executors that wrote them."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without that
    setting (tests) gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "local-cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Rows that a Python worker holds at once; texts can be long.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches that go to Python have ``BATCH_ROWS`` rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def release() -> None:
    """Give a worker's free memory back: workers stay for later stages, beside others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def without(df: DataFrame, results: list[str], needed: list[str] = ()) -> DataFrame:
    """``df`` without the columns that a result will be named like, however the name is
    cased: the result replaces them. A column that the operator reads can't be one."""
    names = {n.lower() for n in results}
    if clash := [n for n in needed if n.lower() in names]:
        raise ValueError(f"{clash[0]} is both read and a result")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here. The
    files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list, name: str, row: str) -> DataFrame:
    """``rows``, written, with ``row`` LONG: their places in ``order`` from 0. Equal rows
    are dealt over several partitions; what is collected is a count for each partition."""
    given = rows.withColumn("_tie", F.monotonically_increasing_id())
    spread = [*order, F.col("_tie")]
    ranged = given.repartitionByRange(*spread).sortWithinPartitions(*spread).drop("_tie")
    placed = write_table(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    start, starts = 0, []
    for p, n in sorted(placed.groupBy(part.alias("p")).count().collect()):
        starts.append((p, start))
        start += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint"))
    at = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(row, at).drop("_part", "_start", "_at")
