"""The journal: an append-only change log, and layouts of what derives from it.

A journal row is one write: sequence number, kind (``stnd`` object, ``tomb`` delete,
``mput`` head-only batch, ``keyd`` index changes only), ledger key, body, head fields and
index changes. Numbers order writes; a batch of head-only rows shares one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPEC = T.StructType([T.StructField("op", T.StringType()), T.StructField("field", T.StringType()), T.StructField("term_s", T.StringType()), T.StructField("term_i", T.LongType())])
_NUMBERS = ("sqn", "size", "obj_hash", "lmd", "ttl")
SCHEMA = T.StructType(
    [
        T.StructField(n, T.ArrayType(_SPEC) if n == "idx" else T.LongType() if n in _NUMBERS else T.StringType())
        for n in ("sqn", "kind", "tag", "bucket_type", "bucket", "key", "sub_key", "value", "size", "obj_hash", "lmd", "ttl", "idx")
    ]
)
KEY = ["tag", "bucket_type", "bucket", "key", "sub_key"]
#: Seconds from year 0 to 1970, the epoch of TTLs.
GREGORIAN = 62167219200


def value_hash(value: Column) -> Column:
    """Hash of a body: the first four bytes of its MD5."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")


def rows(df: DataFrame, **columns: Column) -> DataFrame:
    """Journal rows from ``df``; what isn't given is null, and size and hash follow from
    the body."""
    given = {"kind": F.lit("stnd"), "tag": F.lit("o")} | columns
    if "value" in given:
        given = {"size": F.octet_length(given["value"]).cast("bigint"), "obj_hash": value_hash(given["value"])} | given
    return df.select([given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields])


def spec(op: str, field: str, text: Column | None = None, number: Column | None = None) -> Column:
    """One index change."""
    none = F.lit(None)
    return F.struct(F.lit(op).alias("op"), F.lit(field).alias("field"), (none if text is None else text).cast("string").alias("term_s"), (none if number is None else number).cast("bigint").alias("term_i"))


def append(batch: DataFrame, path: str, order: list[str], base: int | None = None) -> int:
    """Number the rows of ``batch`` in the order of ``order`` after ``base`` (else after
    the journal's last), append them, and return the last number. One writer at a time.

    Numbers come from counts of range partitions, so no task sees all rows; gaps don't
    matter to a journal, and none arise here."""
    spark = batch.sparkSession
    if base is None:
        try:
            base = spark.read.schema(SCHEMA).parquet(path).agg(F.max("sqn")).head()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            base = 0
    # What is numbered is read from files, so a lost executor can't deal the rows anew.
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = batch.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumns({"_part": F.spark_partition_id(), "_at": at}).write.parquet(staging)
    staged = spark.read.parquet(staging)
    start, offsets = base, []
    for part, n in sorted(staged.groupBy("_part").count().collect()):  # one row a partition
        offsets.append((part, start))
        start += n
    if offsets:
        begin = F.broadcast(spark.createDataFrame(offsets, "_part int, _start bigint"))
        numbered = staged.join(begin, "_part").withColumn("sqn", F.col("_start") + F.col("_at") + 1)
        numbered.select(SCHEMA.names).write.mode("append").parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
    return start


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def write_index(index: DataFrame, path: str, files: int = 200) -> None:
    """Index rows in key ranges and sorted inside, so a term range reads few row groups."""
    order = ["bucket_type", "bucket", "field", "term_i", "term_s", "key"]
    index.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_heads(heads: DataFrame, path: str) -> None:
    """Heads by tag, sorted by bucket and key, with a bloom filter for point reads."""
    out = heads.repartitionByRange("tag", "bucket_type", "bucket", "key").sortWithinPartitions("bucket_type", "bucket", "key")
    out.write.mode("overwrite").partitionBy("tag").option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def backup(journal: DataFrame, path: str) -> None:
    """A copy of the journal as it is."""
    journal.write.mode("error").parquet(path)
