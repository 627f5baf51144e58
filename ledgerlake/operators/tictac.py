"""Hash trees of a store's state, to compare two stores.

A tree is a frame (segment, hash): the exclusive or of the hashes of all keys in a
segment. Exclusive or has a partial and a final step, so a tree of any store costs one
shuffle of at most one row a segment and task, and trees merge like partial results.
"""

from __future__ import annotations

import base64
import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import hashing as H
from ledgerlake.operators.store import Bucket, Store
from ledgerlake.sources.journal import value_hash


def leaf(canonical: Column, hashed: Column) -> list[Column]:
    """(hash32, hash) of one key and what is known of its value."""
    s = H.segment48(canonical)
    return [H.segment32(s["seg"], s["extra"]).alias("hash32"), s["alt"].bitwiseXOR(hashed).alias("hash")]


def tree(leaves: DataFrame, size: str) -> DataFrame:
    return leaves.groupBy(H.tree_segment(F.col("hash32"), size).alias("segment")).agg(F.bit_xor("hash").alias("hash")).filter("hash <> 0")


def of_objects(store: Store, tag: str, bucket: Bucket | None, size: str, keys: tuple[str | None, str | None] = (None, None), keep: Column | None = None) -> DataFrame:
    """Tree over live objects by their hashes; ``keep`` passes rows over."""
    rows = store.head_fold(tag, bucket=bucket, keys=keys)
    rows = rows if keep is None else rows.filter(keep)
    return tree(rows.select(*leaf(store.tags.of(tag).canonical(F.col), F.col("obj_hash"))), size)


def of_index(store: Store, bucket: Bucket, field: str, start: str, end: str, size: str) -> DataFrame:
    """Tree over index entries by their terms."""
    rows = store.index_fold(bucket, field, start, end, returns=True)
    term = F.coalesce("term_s", F.col("term_i").cast("string"))
    return tree(rows.select(*leaf(F.concat(F.lit(bucket if isinstance(bucket, str) else "".join(bucket)), F.col("key")), value_hash(term))), size)


def branches(of: DataFrame) -> DataFrame:
    """The upper level: one hash for each 256 leaves."""
    return of.groupBy(F.floor(F.col("segment") / H.LEAVES).cast("bigint").alias("branch")).agg(F.bit_xor("hash").alias("hash"))


def leaves_of(of: DataFrame, branch: list[int]) -> DataFrame:
    return of.filter(F.floor(F.col("segment") / H.LEAVES).isin(branch)).withColumn("branch", F.floor(F.col("segment") / H.LEAVES).cast("bigint"))


def merge(one: DataFrame, *others: DataFrame) -> DataFrame:
    for x in others:
        one = one.unionByName(x)
    return one.groupBy("segment").agg(F.bit_xor("hash").alias("hash")).filter("hash <> 0")


def diff(one: DataFrame, other: DataFrame) -> DataFrame:
    """Segments whose hashes differ: those that don't cancel out in a merge."""
    return merge(one, other).select("segment")


def alter(of: DataFrame, segment: int, hashed: int) -> DataFrame:
    """The tree with one segment's hash set."""
    row = of.sparkSession.range(1).select(F.lit(segment).cast("bigint").alias("segment"), F.lit(hashed).cast("bigint").alias("hash"))
    return of.filter(F.col("segment") != segment).unionByName(row).filter("hash <> 0")


def add(of: DataFrame, canonical: str, value: str, size: str) -> DataFrame:
    """The tree with one more key and value."""
    row = of.sparkSession.range(1).select(*leaf(F.lit(canonical), value_hash(F.lit(value))))
    return merge(of, tree(row, size))


def export(of: DataFrame, size: str) -> str:
    """A tree as text. Its rows are bounded by its size."""
    rows = sorted((r["segment"], r["hash"]) for r in of.collect())
    return json.dumps({"size": size, "tree": base64.b64encode(zlib.compress(json.dumps(rows).encode())).decode()})


def load(spark: SparkSession, text: str) -> tuple[DataFrame, str]:
    got = json.loads(text)
    if got["size"] not in H.WIDTHS:
        raise ValueError(f"no tree size {got['size']}")
    rows = json.loads(zlib.decompress(base64.b64decode(got["tree"])))
    return spark.createDataFrame(rows or [], "segment bigint, hash bigint"), got["size"]


def count_estimate(store: Store, tag: str, n_segments: int, of: int, bucket: Bucket | None = None) -> DataFrame:
    """A count from the keys of ``n_segments`` of every ``of`` segments, scaled up. The
    choice follows the keys' hashes, so it is the same every time."""
    rows = store.head_fold(tag, bucket=bucket)
    seg = H.segment48(store.tags.of(tag).canonical(F.col))["seg"].bitwiseAND(32767)
    return rows.filter((seg % of) < n_segments).agg((F.count("*") * F.lit(of // n_segments)).cast("bigint").alias("n_estimate"))
