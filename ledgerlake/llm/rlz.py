"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id, cut into blocks. Each
block is indexed by the hash of every phrase of ``width`` consecutive words, with the
phrase's first place in the block: the smallest document id, and the first word there. The
indexes meet in buckets of the hash, where each phrase gets its first place in the whole
reference, so a document is looked up in every block at once and yet only sends its own
phrases.

A document is then parsed greedily from its first word: at a phrase that the reference
holds a factor (source document, first word there, number of words) starts, and it grows
word by word as long as the next phrase is found at the next place of the same source. At
its boundary the phrases that straddle it are looked up too, for the reference may hold
them elsewhere, and so a next factor may begin inside the one before. All else is literal.
Factors have ``width`` words at least and become the spans to remove: together they cover
a word if and only if some held phrase does.

Phrases are compared by 64-bit hashes: among n phrases, two different ones are taken for
equal with probability below n**2 / 2**65.

Null text has no words. Documents with a null id come after all others and, like
documents with equal ids, are no reference for one another; to others, documents that
share an id are one source. Repeated rows are thus kept alike. Ids must be integers
(``ValueError`` else). Texts of any length are parsed whole; one longer than a block is a
block of its own. No row is dropped, no rows give no rows. A column of ``docs`` that has
the name of a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlake.llm import blocks as B
from ledgerlake.llm.hashing import Powers, WordHashes, bucket_of, windows
from ledgerlake.llm.store import without

#: Bytes of text for each block, phrases for each bucket.
BLOCK_BYTES, BUCKET_PHRASES = 3 << 20, 1_000_000
_LAST = np.iinfo(np.int64).max
SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "words", "source", "at")])


def factors(source: np.ndarray, at: np.ndarray, held: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """Factors (first word, words, source, first word there), given for each phrase of a
    document whether the reference holds it, and its first place there."""
    if not held.any():
        return []
    goes_on = held[1:] & held[:-1] & (source[1:] == source[:-1]) & (at[1:] == at[:-1] + 1)
    first = np.flatnonzero(held & ~np.concatenate([[False], goes_on]))
    last = np.flatnonzero(held & ~np.concatenate([goes_on, [False]]))
    return list(zip(first.tolist(), (last - first + width).tolist(), source[first].tolist(), at[first].tolist(), strict=True))


class Index:
    """A block's distinct phrases in order of hash, and the first place of each."""

    def __init__(self, ids: np.ndarray, each: list[np.ndarray]):
        turn = np.argsort(ids, kind="stable")
        lengths = np.array([len(each[i]) for i in turn], np.int64)
        flat = np.concatenate([each[i] for i in turn]) if len(turn) else np.empty(0, np.uint64)
        order = np.argsort(flat)
        sorted_ = flat[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(flat) else np.empty(0, np.int64)
        # Documents follow each other by id, so the least index is the first place.
        place = np.minimum.reduceat(order, first) if len(first) else first
        ends = np.cumsum(lengths)
        doc = np.searchsorted(ends, place, "right")
        self.keys, self.doc, self.ids = sorted_[first], doc, ids[turn]
        self.at = place - (ends - lengths)[doc] if len(first) else place


def parse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50, text_as: str = "both") -> DataFrame:
    """``docs`` with ``n_words`` LONG, ``spans`` ARRAY<STRUCT<start, words, source, at>>
    (factors: word positions here, and the same words in the document ``source`` from word
    ``at``), ``n_removed`` LONG (words that they cover) and ``kept`` STRING (the other
    words, joined by a space). With ``text_as`` "kept" the text is left out, with "cut"
    there is no ``kept`` and the text is what is kept, but as it was if nothing is removed."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise ValueError(f"{doc_id} must be an integer column")
    extra = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("n_removed", T.LongType())]
    if text_as != "cut":
        extra.append(T.StructField("kept", T.StringType()))
    docs = without(docs, [f.name for f in extra], [doc_id, text])
    n_buckets = B.text_bytes(docs, text) // (6 * BUCKET_PHRASES) + 1
    blocks = B.make_blocks(docs, text, BLOCK_BYTES)
    schema = T.StructType([f for f in docs.schema.fields if f.name != text or text_as != "kept"] + extra)
    hashes, powers = WordHashes(), Powers()

    def split(x: pa.StringScalar) -> list[bytes]:
        return (x.as_py() or "").encode("utf-8", "surrogatepass").split()

    def index(table: pa.Table) -> tuple[Index, np.ndarray, list[np.ndarray]]:
        ids = np.array([_LAST if x is None else x for x in table[doc_id].to_pylist()], np.int64)
        each = [windows(hashes.of(split(x)), width, powers) for x in table[text]]
        return Index(ids, each), ids, each

    def emit(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        ix, _, _ = index(table)
        bucket = bucket_of(ix.keys, n_buckets)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            used, at = np.unique(ix.doc[a:b], return_inverse=True)
            yield int(bucket[a]), B.pack(ix.keys[a:b], ix.ids[used].view(np.uint64), at, ix.at[a:b], ascending=1)

    def reduce(_: int, messages: list[bytes]) -> list[bytes]:
        keys, owners, places = [], [], []
        for m in messages:
            (k, used, which, at), _ = B.unpack(m, 1)
            keys.append(k)
            owners.append(used.view(np.int64)[which.astype(np.int64)])
            places.append(at.astype(np.int64))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        flat, owner, place = np.concatenate(keys), np.concatenate(owners), np.concatenate(places)
        order = np.argsort(flat)
        sorted_ = flat[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        owner_s = owner[order]
        least = np.minimum.reduceat(owner_s, first)
        at = np.minimum.reduceat(np.where(owner_s == least[group], place[order], _LAST), first)
        to = np.empty(len(flat), np.int64)
        to[order] = group
        answers = []
        for own, of in zip(np.split(owner, cuts), np.split(to, cuts), strict=True):
            earlier = least[of] < own
            used, which = np.unique(least[of[earlier]], return_inverse=True)
            answers.append(B.pack(used.view(np.uint64), which, at[of[earlier]], rest=np.packbits(earlier).tobytes()))
        return answers

    def finish(table: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        ix, ids, each = index(table)
        source, at = ix.ids[ix.doc] if len(ix.keys) else np.empty(0, np.int64), ix.at.astype(np.int64)
        bucket = bucket_of(ix.keys, n_buckets)
        for k, data in answers.items():
            a, b = np.searchsorted(bucket, [k, k + 1])
            (used, which, place), bits = B.unpack(data)
            earlier = a + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a))
            source[earlier], at[earlier] = used.view(np.int64)[which.astype(np.int64)], place.astype(np.int64)
        n_words, spans, n_removed, kept = [], [], [], []
        for x, d, h in zip(table[text], ids, each, strict=True):
            places = np.searchsorted(ix.keys, h)
            found = factors(source[places], at[places], source[places] < d, width) if len(h) else []
            n = len(h) + width - 1
            if not len(h) or found or text_as != "cut":
                w = split(x)
                n = len(w)
            gone = np.zeros(n, bool)
            for a, m, _, _ in found:
                gone[a : a + m] = True
            n_words.append(n)
            spans.append([dict(zip(SPAN.names, f, strict=True)) for f in found])
            n_removed.append(int(gone.sum()))
            if found:
                w = [word for word, g in zip(w, gone.tolist(), strict=True) if not g]
            kept.append(x.as_py() if text_as == "cut" and not found else b" ".join(w).decode("utf-8", "surrogatepass"))
        if text_as == "cut":
            table = table.set_column(table.column_names.index(text), text, pa.array(kept, pa.string()))
        elif text_as == "kept":
            table = table.drop_columns([text])
        span = pa.struct([(n, pa.int64()) for n in SPAN.names])
        for field, made, kind in zip(extra, (n_words, spans, n_removed, kept), [pa.int64(), pa.list_(span), pa.int64(), pa.string()], strict=False):
            table = table.append_column(field.name, pa.array(made, kind))
        return table

    return B.exchange(blocks, emit, reduce, finish, schema)
