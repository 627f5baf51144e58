"""Language-model scoring by stupid backoff.

The n-gram counts of all documents are tables partitioned by the n-gram's hash, one for
each order; a block of documents sends its n-grams with their counts to the tables, and
the totals are joined back to it by n-gram and summed for each document. The rows of both
joins are packed, all n-grams that a block has for a partition in one, as ``blocks`` tells. The score of a word is
the count of the longest n-gram that ends with it over the count of its context, with a
factor ``alpha`` for each shorter length; a word that no other document has gets the
share of one word. A document's own n-grams are left out of the counts it is scored
by, so a text isn't likely merely because it is in the corpus.

N-grams are compared by 56 bits of a hash: of n different ones a given one is counted
together with another with probability n / 2**56. Words are lower-cased, split at white space.
Null texts and texts without a word have no words and a null score. Repeated rows are
documents of their own and count as such, ties of count don't matter. Texts of any length
are scored whole. No row is dropped, no rows give no rows. A column of ``docs`` that has
the name of a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlake.llm import blocks as B
from ledgerlake.llm.hashing import Powers, WordHashes, bucket_of, mix, windows
from ledgerlake.llm.store import without

#: Bytes of text for each block, n-grams for each bucket, roughly.
BLOCK_BYTES, BUCKET_GRAMS = 6 << 20, 1_500_000
#: The bucket that adds up the words of all blocks; it gets one number from each.
TOTAL = -1


def score(docs: DataFrame, text: str = "text", order: int = 3, alpha: float = 0.4) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n_words`` LONG, ``n_backoff`` LONG
    (words scored by a shorter n-gram than their place allows), ``lm_score`` DOUBLE (mean
    natural logarithm of the words' scores)."""
    extra = [T.StructField("n_words", T.LongType()), T.StructField("n_backoff", T.LongType()), T.StructField("lm_score", T.DoubleType())]
    docs = without(docs, [f.name for f in extra], [text])
    n_bytes = B.text_bytes(docs, text)
    n_buckets = n_bytes * order // (6 * BUCKET_GRAMS) + 1
    blocks = B.make_blocks(docs, text, BLOCK_BYTES)
    schema = T.StructType([f for f in docs.schema.fields if f.name != text] + extra)
    hashes, powers = WordHashes(), Powers()

    def grams(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        """Words of each document; all n-grams of each order, document by document."""
        each = []
        for x in table[text]:
            each.append(hashes.of((x.as_py() or "").lower().split()))
        salt = [mix(np.array([n], np.uint64)) for n in range(order + 1)]
        by_order = []
        for n in range(1, order + 1):
            made = [windows(h, n, powers) for h in each]
            by_order.append(((np.concatenate(made) if made else np.empty(0, np.uint64)) ^ salt[n]) & ~np.uint64(255))
        return np.array([len(h) for h in each], np.int64), by_order

    def emit(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        n_words, by_order = grams(table)
        yield TOTAL, B.pack(np.array([n_words.sum()], np.uint64))
        sent = []
        for g in by_order:
            keys, counts = np.unique(g, return_counts=True)
            sent.append((keys >> np.uint64(8), counts, bucket_of(keys, n_buckets)))
        for k in np.unique(np.concatenate([b for _, _, b in sent])):
            cuts = [np.searchsorted(b, [k, k + np.uint64(1)]) for _, _, b in sent]
            yield int(k), B.pack(*[keys[x:y] for (keys, _, _), (x, y) in zip(sent, cuts, strict=True)], *[counts[x:y] for (_, counts, _), (x, y) in zip(sent, cuts, strict=True)], ascending=order)

    def reduce(bucket: int, messages: list[bytes]) -> list[bytes]:
        rows = [B.unpack(m, 0 if bucket == TOTAL else order)[0] for m in messages]
        if bucket == TOTAL:
            return [B.pack(np.array([sum(int(r[0][0]) for r in rows)], np.uint64))] * len(rows)
        out: list[list[np.ndarray]] = [[] for _ in rows]
        for i in range(order):
            keys = [r[i] for r in rows]
            counts, flat = np.concatenate([r[order + i] for r in rows]), np.concatenate(keys)
            turn = np.argsort(flat)
            first = np.concatenate([[True], flat[turn][1:] != flat[turn][:-1]]) if len(flat) else np.empty(0, bool)
            sums = np.add.reduceat(counts[turn], np.flatnonzero(first)) if len(flat) else counts
            totals = np.empty(len(flat), np.uint64)
            totals[turn] = sums[np.cumsum(first) - 1]
            for x, t in zip(out, np.split(totals, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
                x.append(t)
        return [B.pack(*x) for x in out]

    def finish(table: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        n_words, by_order = grams(table)
        all_words = int(B.unpack(answers.pop(TOTAL))[0][0][0])
        rows = [B.unpack(answers[k])[0] for k in sorted(answers)]
        n_docs = len(n_words)
        ends = np.cumsum(n_words)
        rest = all_words - np.repeat(n_words, n_words)  # words of the other documents
        place = np.arange(len(rest)) - np.repeat(ends - n_words, n_words)  # of a word in its document
        counts = []  # of the n-gram that ends at each word, without its own document
        for n, g in enumerate(by_order, 1):
            keys, at = np.unique(g, return_inverse=True)
            total = np.concatenate([r[n - 1] for r in rows]).astype(np.int64) if rows else np.empty(0, np.int64)
            owner = np.repeat(np.arange(n_docs), np.maximum(n_words - n + 1, 0))
            _, same, own = np.unique(owner * max(1, len(keys)) + at, return_inverse=True, return_counts=True)
            c = np.zeros(len(rest), np.int64)
            c[place >= n - 1] = total[at] - own[same]
            counts.append(c)
        value = np.log(np.where(counts[0] > 0, counts[0], 1) / np.maximum(rest, 1))
        level = np.ones(len(rest), np.int64)
        for n in range(2, order + 1):
            context = np.concatenate([[0], counts[n - 2][:-1]]) if len(rest) else counts[n - 2]
            known = (place >= n - 1) & (counts[n - 1] > 0) & (context > 0)
            backed = value + np.log(alpha)
            value = np.where(known, np.log(np.maximum(counts[n - 1], 1) / np.maximum(context, 1)), np.where(place >= n - 1, backed, value))
            level = np.where(known, n, level)
        sums = np.add.reduceat(np.append(value, 0), np.minimum(ends - n_words, len(value))) if n_docs else value
        short = level < np.minimum(place + 1, order)
        back = np.concatenate([[0], np.cumsum(short)])
        made = [pa.array(n_words), pa.array(back[ends] - back[ends - n_words], pa.int64()), pa.array([s / n if n else None for s, n in zip(sums.tolist(), n_words.tolist(), strict=True)], pa.float64())]
        table = table.drop_columns([text])
        for field, x in zip(extra, made, strict=True):
            table = table.append_column(field.name, x)
        return table

    return B.exchange(blocks, emit, reduce, finish, schema)
