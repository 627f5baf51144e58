"""Exchange between blocks of documents and buckets of keys.

Documents are cut into blocks of a few MB, shuffled once; both uses below read that one
exchange. Each block sends every distinct key (word, n-gram, window) once to the bucket
of the key's hash, all keys of a bucket in one row; a bucket answers each block that sent
it something; the answers meet their block again. A key that a third of all rows hold is
one entry for each block, so no bucket outgrows the others, and what a task holds is a
block or a bucket, both of bounded size. Only a single text larger than a block makes a
larger one.

Rows grow with the input and not with blocks times buckets: nothing is sent to a bucket
that a block has no key for, so there are at most as many rows as distinct keys of blocks,
as in a join of plain rows. A row has no schema inside; its numbers are packed into one
compressed run with five bytes for each array besides, so even a row of one key takes
about what a plain row of the same numbers takes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.store import bounded_batches, release


def pack_table(table: pa.Table, level: int = 3) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def pack(*arrays: np.ndarray, ascending: int = 0, rest: bytes = b"") -> bytes:
    """Arrays of unsigned numbers and some bytes as one run. Of each number the bytes that
    the array needs are kept, plane by plane; the first ``ascending`` arrays as differences."""
    head, body = [bytes([len(arrays)])], []
    for i, x in enumerate(arrays):
        x = np.ascontiguousarray(x, "<u8")
        if i < ascending and len(x):
            x = np.diff(x, prepend=np.uint64(0))
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        head.append(struct.pack("<IB", len(x), width))
        body.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.ZstdCompressor(1, write_content_size=True).compress(b"".join([*head, *body, rest]))


def unpack(data: bytes, ascending: int = 0) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(data)
    at, out = 1 + 5 * raw[0], []
    for i in range(raw[0]):
        n, width = struct.unpack_from("<IB", raw, 1 + 5 * i)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        x = wide.view("<u8").reshape(-1)
        out.append(np.cumsum(x, dtype=np.uint64) if i < ascending else x)
        at += n * width
    return out, raw[at:]


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).head()[0] or 0


def make_blocks(docs: DataFrame, text: str, block_bytes: int) -> DataFrame:
    """Rows (block, data), dealt out by block: ``data`` holds rows of ``docs``. A block's
    number is its input partition and its place there, so a lost one is made anew alike."""

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            data = pack_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_pydict({"block": [part << 32 | k], "data": [data]}, pa.schema([("block", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), np.int64))
            start = 0
            while start < batch.num_rows:
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + block_bytes - size, "right")))
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - done)
                if stop < batch.num_rows or size >= block_bytes:
                    yield block()
                    k, held, size = k + 1, [], 0
                start = stop
        if held:
            yield block()
        held = []
        release()

    return docs.mapInArrow(run, "block long, data binary").repartition("block")


def exchange(
    blocks: DataFrame,
    emit: Callable[[pa.Table], Iterator[tuple[int, bytes]]],
    reduce: Callable[[int, list[bytes]], list[bytes]],
    finish: Callable[[pa.Table, dict[int, bytes]], pa.Table],
    schema: str,
) -> DataFrame:
    """``emit`` gives a block's (bucket, message) pairs; ``reduce`` gets all messages of
    a bucket and answers each; ``finish`` gets a block's rows and its answers by bucket."""
    sent = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                made = list(emit(unpack_table(data.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int64()), pa.array([block] * len(made), pa.int64()), pa.array([m for _, m in made], pa.binary())], schema=sent)
            release()

    def answer(table: pa.Table) -> pa.Table:
        made = reduce(table["bucket"][0].as_py(), table["data"].to_pylist())
        release()
        return pa.table({"bucket": table["bucket"], "block": table["block"], "data": pa.array(made, pa.binary())})

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right["bucket"].to_pylist(), right["data"].to_pylist(), strict=True))
        out = [finish(unpack_table(x.as_py()), answers) for x in left["data"]]
        release()
        return pa.concat_tables(out)

    kept = "bucket long, block long, data binary"
    answers = blocks.mapInArrow(send, kept).groupBy("bucket").applyInArrow(answer, kept)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)
