"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered by the order of their columns, through a range partitioning and the
row counts of its partitions. A keyed Feistel network permutes the numbers; where it
leaves the range it is applied again (cycle walking). Shard and slot follow from the
permuted number alone: ``number mod n_shards`` and ``number div n_shards``, so shards
differ by one row at most, slots have no gap, and anyone who knows a row's number, the
count and the key can compute both.

Nulls sort last. Rows that are equal in every column are interchangeable: they get
different slots, and the set of slots they get is fixed. No rows give no rows. Texts of
any length may travel with a row, though they are better left out. A column that has the
name of a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.hashing import mix
from ledgerlake.llm.store import without, write_table

ROUNDS = 6


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A bijection of 0..n-1. The network works on pairs (left, right) of a near-square
    grid of ``a * b >= n`` cells and changes one half by a hash of the other each round."""
    a = max(1, int(np.ceil(np.sqrt(n))))
    b = max(1, -(-n // a))
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key % (1 << 64)))

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v // np.uint64(b), v % np.uint64(b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + mix(left ^ keys[i]) % np.uint64(b)) % np.uint64(b)
            else:
                left = (left + mix(right ^ keys[i]) % np.uint64(a)) % np.uint64(a)
        return left * np.uint64(b) + right

    out = network(x.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def assign(rows: DataFrame, n_shards: int, key: int = 0) -> DataFrame:
    """``rows`` with ``row_number``, ``shard`` and ``slot``. ``rows`` should be narrow:
    an id and what must travel with it."""
    rows = without(rows, ["row_number", "shard", "slot"])
    names = rows.columns
    inner = [f"c{i}" for i in range(len(names))]
    rows = rows.toDF(*inner)
    order = [F.col(c).asc_nulls_last() for c in inner]
    spread = [*order, F.col("tie")]  # equal rows too are dealt over several partitions
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*spread).sortWithinPartitions(*spread).drop("tie")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield batch.append_column("part", pa.array(np.full(n, part, np.int32))).append_column("at", pa.array(np.arange(at, at + n)))
            at += n

    placed = write_table(ranged.mapInArrow(count, T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])), "shard")
    counts = sorted((r[0], r[1]) for r in placed.groupBy("part").agg(F.count("*")).collect())  # one row a partition
    n = sum(c for _, c in counts)
    offsets = dict(zip((p for p, _ in counts), np.cumsum([0] + [c for _, c in counts]).tolist(), strict=False))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = np.fromiter(map(offsets.__getitem__, batch.column("part").to_pylist()), np.int64, batch.num_rows)
            row = base + batch.column("at").to_numpy()
            to = permute(row, n, key)
            batch = batch.select(inner)
            for name, values in {"row_number": row, "shard": (to % n_shards).astype(np.int32), "slot": to // n_shards}.items():
                batch = batch.append_column(name, pa.array(values))
            yield batch

    made = placed.mapInArrow(number, T.StructType([*rows.schema.fields, T.StructField("row_number", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))
    return made.toDF(*names, "row_number", "shard", "slot")
