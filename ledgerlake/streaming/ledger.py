"""The ledger kept up to date from a stream of journal files.

Each micro-batch is reduced to the last write of each of its keys and written beside the
others; a reader merges them by the same rule, so a late row with a lower number loses and
no watermark is needed. Every ``COMPACT`` batches the parts become one base, so a batch
costs what it holds and the whole is rewritten seldom. A batch that is run twice writes
the same part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.operators.store import last_writes, writes
from ledgerlake.sources.journal import SCHEMA

COMPACT = 32


def parts(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """Complete parts of the state that count: the last base and what came after it."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(there):
        return []
    found = []
    for x in fs.listStatus(there):
        kind, _, number = x.getPath().getName().partition("-")
        if kind in ("base", "part") and fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")) and (before is None or int(number) < before):
            found.append((int(number), kind))
    base = max((n for n, kind in found if kind == "base"), default=-1)
    after = [f"{path}/part-{n}" for n, kind in sorted(found) if kind == "part" and n > base]
    return [f"{path}/base-{base}", *after] if base >= 0 else after


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last write of each key so far, tombstones included."""
    known = parts(spark, path, before)
    return last_writes(reduce(DataFrame.unionByName, map(spark.read.parquet, known))) if known else None


def maintain(spark: SparkSession, journal: str, state: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Run over all journal files that are there now, and stop."""

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last_writes(writes(batch)).write.mode("overwrite").parquet(f"{state}/part-{number}")
        if number % COMPACT == COMPACT - 1:
            current(session, state, number + 1).write.mode("overwrite").parquet(f"{state}/base-{number}")

    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(journal)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
