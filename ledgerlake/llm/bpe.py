"""Byte-level BPE encoding and decoding.

Each block of documents sends its distinct pre-tokens once to the bucket of their
hash. There every distinct pre-token is encoded once for the whole corpus, and the ids
go back to the blocks, where they are put in place by position. Decoding joins the ids
with the table of token bytes, which is as large as the vocabulary and no larger.

A pre-token that is a token is that token; any other starts as its bytes, and of all
neighbours that make a token together those with the lowest rank, the leftmost of them,
are merged until none do. Pre-tokens of one length are merged side by side in numpy, long
ones by a heap.

Null text encodes as an empty text: no ids. Rows are independent of each other, so
repeated rows, ties and null ids of documents stay as they are; texts of any length are
encoded whole; no row is dropped, no rows give no rows. A column of ``docs`` that has the
name of a result is replaced by it.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm import blocks as B
from ledgerlake.llm.store import release, without

#: Bytes of text for each block and for each bucket of pre-tokens.
BLOCK_BYTES, BUCKET_BYTES = 5 << 20, 8 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """Which two tokens make a third, from a table of ranks, and encoding by it."""

    #: Bytes of a pre-token beyond which a heap is faster than looking at all pairs.
    LONG = 40
    NONE = np.int64(1) << 40

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, pairs = ranks, {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(left.shape, self.NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], self.NONE)

    def side_by_side(self, words: list[bytes]) -> list[list[int]]:
        """Of words of one length."""
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        length = np.full(len(words), ids.shape[1])
        out: list[list[int]] = [[]] * len(words)
        name = np.arange(len(words))
        while True:
            row = np.arange(len(ids))
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            best = rank[row, at] if rank.shape[1] else np.full(len(ids), self.NONE)
            done = best == self.NONE
            for i, n, tokens in zip(name[done].tolist(), length[done].tolist(), ids[done].tolist(), strict=True):
                out[i] = tokens[:n]
            if done.all():
                return out
            ids, rank, length, name, at, best = (x[~done] for x in (ids, rank, length, name, at, best))
            row = np.arange(len(ids))
            # The merged token takes the left one's place, and all that follow move up.
            after = np.arange(ids.shape[1] - 1)[None, :] > at[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[row, at] = best
            rank = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            length -= 1
            if rank.shape[1]:
                right = np.flatnonzero(at < length - 1)
                rank[right, at[right]] = self.rank_of(ids[right, at[right]], ids[right, at[right] + 1])
                ends = np.flatnonzero((at >= length - 1) & (at < rank.shape[1]))
                rank[ends, at[ends]] = self.NONE
                left = np.flatnonzero(at > 0)
                rank[left, at[left] - 1] = self.rank_of(ids[left, at[left] - 1], ids[left, at[left]])

    def by_heap(self, word: bytes) -> list[int]:
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, find = len(ids), self.pairs.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := find(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or find(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := find(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := find(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (rank := self.ranks.get(w)) is not None:
                out[i] = [rank]
            elif len(w) > self.LONG:
                out[i] = self.by_heap(w)
            elif w:
                by_length.setdefault(len(w), []).append(i)
        for some in by_length.values():
            for a in range(0, len(some), 20_000):
                for i, ids in zip(some[a : a + 20_000], self.side_by_side([words[i] for i in some[a : a + 20_000]]), strict=True):
                    out[i] = ids
        return out


def ragged(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists number ``at`` of a list array, one after the other, and their ends."""
    starts, lengths = offsets[at], offsets[at + 1] - offsets[at]
    ends = np.cumsum(lengths, dtype=np.int64)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(at) else 0)], ends


class _Numbers(dict):
    """Numbers what it is asked for in order of first use."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _token_bytes(batch_ids: pa.Array, token: list[bytes | None]) -> pa.Array:
    flat, offsets = np.asarray(batch_ids.values), np.asarray(batch_ids.offsets).tolist()
    valid = batch_ids.is_valid().to_pylist()
    look = token.__getitem__
    return pa.array([b"".join(map(look, flat[a:b].tolist())) if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)], pa.binary())


def _tokens(ranks: dict[bytes, int]) -> dict[int, bytes]:
    return {i: b for b, i in ranks.items()}


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with its ``text`` column replaced by ``ids`` ARRAY<INT>, and by the bytes
    that the ids decode to if ``decoded`` names a column for them."""
    spark = docs.sparkSession
    docs = without(docs, [ids, *([decoded] if decoded else [])], [text])
    held = spark.sparkContext.broadcast(Merges(load_ranks(ranks_path)))
    tokens = spark.sparkContext.broadcast(_tokens(held.value.ranks)) if decoded else None
    n_buckets = B.text_bytes(docs, text) // BUCKET_BYTES + 1
    blocks = B.make_blocks(docs, text, BLOCK_BYTES)
    extra = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    out = T.StructType([f for f in docs.schema.fields if f.name != text] + extra)

    def pieces(table: pa.Table) -> tuple[list[np.ndarray], dict[int, list[bytes]], np.ndarray]:
        """The pre-tokens of each document as numbers; the distinct ones of each bucket, in
        order of first use; the place of each number in the buckets' sequence."""
        find, numbers = regex.compile(pattern).findall, _Numbers()
        each = []
        for x in table[text]:
            words = find(x.as_py() or "")
            each.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        words = [w.encode("utf-8", "surrogatepass") for w in numbers]
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        by: dict[int, list[bytes]] = {}
        for k, i in zip(bucket[order].tolist(), order.tolist(), strict=True):
            by.setdefault(k, []).append(words[i])
        return each, by, place

    def emit(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        for k, words in pieces(table)[1].items():
            yield k, B.pack(np.fromiter(map(len, words), np.uint64, len(words)), rest=b"".join(words))

    def reduce(_: int, messages: list[bytes]) -> list[bytes]:
        numbers, sent = _Numbers(), []
        for m in messages:
            (lengths,), data = B.unpack(m)
            ends = np.cumsum(lengths).tolist()
            sent.append(np.fromiter((numbers[data[a:b]] for a, b in zip([0, *ends], ends, strict=False)), np.int64, len(ends)))
        each = held.value.encode(list(numbers))
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))])
        flat = np.fromiter((i for x in each for i in x), np.uint64, offsets[-1])
        answers = []
        for at in sent:
            ids, ends = ragged(flat, offsets, at)
            answers.append(B.pack(np.diff(ends, prepend=0).astype(np.uint64), ids))
        return answers

    def finish(table: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        each, by, place = pieces(table)
        got = [B.unpack(answers[k])[0] for k in by]
        n, flat = (np.concatenate([np.empty(0, np.uint64), *(x[i] for x in got)]).astype(np.int64) for i in (0, 1))
        offsets = np.concatenate([[0], np.cumsum(n)])
        at = place[np.concatenate([np.empty(0, np.int32), *each])]
        ids_out, ends = ragged(flat.astype(np.int32), offsets, at)
        words_to = np.cumsum([0] + [len(x) for x in each])
        doc_to = np.concatenate([[0], ends])[words_to].astype(np.int32)
        made = pa.ListArray.from_arrays(pa.array(doc_to), pa.array(ids_out, pa.int32()))
        rest = table.drop_columns([text]).append_column(ids, made)
        return rest.append_column(decoded, _token_bytes(made, tokens.value)) if decoded else rest

    return B.exchange(blocks, emit, reduce, finish, out)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out`` BINARY, the bytes of the tokens in ``ids``. An id that the
    vocabulary lacks fails the job; null ids give null."""
    df = without(df, [out], [ids])
    tokens = df.sparkSession.sparkContext.broadcast(_tokens(load_ranks(ranks_path)))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(out, _token_bytes(batch.column(ids), tokens.value))
        release()

    return df.mapInArrow(run, schema)


def digest(ids: str = "ids", decoded: str = "decoded") -> list:
    """Columns that sum up an encoding: token count and the two SHA-256 values."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
