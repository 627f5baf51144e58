"""Quality classifier: supervised subword embeddings.

A text is the mean of learned vectors of its words, its character n-grams (3 and 4 bytes
of UTF-8) and its repetitions (a word equal to the one ``g`` words before, for small
``g``, is the feature of that gap), each hashed to one of ``N_FEATURES`` rows; a softmax
output follows. Vectors and output are trained together by stochastic gradient descent
in numpy, in batches of ``BATCH`` rows, on ``MAX_ROWS`` distinct labelled texts at most and
``LEAST`` of each label at least, chosen by a hash of the text. Whole texts are scored.

Null and empty texts have no feature: their mean is the zero vector, so their score is
that of the output's bias. Without labelled rows every score is 0.5. Repeated rows get
equal scores and count once in training, but a text with both labels counts for both; ties
can't arise. No rows give no rows. A column of ``docs`` that has the name of a result is
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm import blocks as B
from ledgerlake.llm.hashing import WordHashes
from ledgerlake.llm.sampling import distinct_texts
from ledgerlake.llm.store import bounded_batches, without

BITS = 16
N_FEATURES = 1 << BITS
DIM, EPOCHS, RATE, BATCH = 8, 8, 2.0, 16
#: Labelled texts trained on, and those of each label at least, if there are as many.
MAX_ROWS, LEAST = 6000, 200
#: Gaps at which an equal word is a repetition.
GAPS = 16
_PIECE = 1 << 20
_SHIFT = np.uint64(64 - BITS)


def features(text: str | None, hashes: WordHashes) -> Iterator[np.ndarray]:
    """Feature rows of the whole text, a bounded piece at a time."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data.strip():
        return
    b = np.frombuffer(data, np.uint8)
    for a in range(0, len(b), _PIECE):
        c = b[a : a + _PIECE + 3].astype(np.uint32)
        three = c[:-2] | c[1:-1] << np.uint32(8) | c[2:] << np.uint32(16)
        yield (three[:_PIECE] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        four = three[:-1] | c[3:] << np.uint32(24)
        yield (four[:_PIECE] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
    words = data.split()
    for a in range(0, len(words), _PIECE):
        h = hashes.of(words[max(0, a - GAPS) : a + _PIECE])
        yield (h[min(a, GAPS) :] >> _SHIFT).astype(np.uint32)
        for g in range(1, GAPS + 1):
            n = int((h[g:] == h[:-g])[max(0, min(a, GAPS) - g) :].sum()) if len(h) > g else 0
            if n:
                yield np.full(n, (g * 0x9E37 + 0x51ED) % N_FEATURES, np.uint32)


def counted(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    parts = list(features(text, hashes))
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint32), np.empty(0, np.int64))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors (features x dim), output (dim x 2), bias (2)."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (N_FEATURES, DIM)).astype(np.float32)
    w = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    prior = (y.mean() * len(y) + 1) / (len(y) + 2)
    bias = np.log(np.array([1 - prior, prior], np.float32))
    squares = np.full(N_FEATURES, 1e-4, np.float32)
    weights = [(c / max(1, c.sum())).astype(np.float32) for _, c in rows]
    turn = rng.permutation(len(rows))
    batches = []
    for a in range(0, len(rows), BATCH):
        some = turn[a : a + BATCH]
        used, place = np.unique(np.concatenate([rows[i][0] for i in some]), return_inverse=True)
        owner = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
        batches.append((used, (owner * len(used) + place).astype(np.int32), np.concatenate([weights[i] for i in some]), np.eye(2, dtype=np.float32)[y[some]]))
    del weights
    steps, done = EPOCHS * len(batches), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            used, at, share, target = batches[k]
            # Rows by the features they use: the batch's part of the matrix of weights.
            x = np.zeros((len(target), len(used)), np.float32)
            x.reshape(-1)[at] = share
            rate = RATE * (1 - done / steps)
            mean = x @ e[used]
            z = mean @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            error = p / p.sum(1, keepdims=True) - target  # of the softmax
            back = error @ w.T
            w -= 0.05 * rate * mean.T @ error
            bias -= 0.005 * rate * error.sum(0)
            g = x.T @ back
            squares[used] += (g * g).mean(1)
            e[used] -= 0.1 * rate * g / np.sqrt(squares[used])[:, None]
            done += 1
    return e, w, bias


def train(labelled: DataFrame, text: str, label: str, max_rows: int = MAX_ROWS, hashed: str | None = None) -> tuple | None:
    """Fit on a sample of the rows whose label is 0 or 1; ``hashed`` as in the sampling."""
    known = labelled.withColumn(label, F.col(f"`{label}`").cast("int")).filter(F.col(f"`{label}`").isin(0, 1))
    sample = distinct_texts(known, text, label, max_rows, LEAST, even=False, hashed=hashed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            made = [B.pack(*counted(t, hashes), ascending=1) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "h": batch.column("h"), "x": pa.array(made, pa.binary())})

    got = sorted(sample.mapInArrow(count, "y string, h long, x binary").collect(), key=lambda r: (r["h"], r["y"]))
    if not got:
        return None
    x = [(i.astype(np.uint16), n.astype(np.float32)) for (i, n), _ in (B.unpack(r["x"], 1) for r in got)]
    return fit(x, np.array([int(r["y"]) for r in got]))


def score(docs: DataFrame, model: tuple | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the softmax output for label 1; only ``text`` is looked at."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, ["score"], [text])
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for t in batch.column(text).to_pylist():
                if held.value is None:
                    out.append(0.5)
                    continue
                e, w, bias = held.value
                total, n = np.zeros(DIM), 0
                for ids in features(t, hashes):
                    total += np.bincount(ids, minlength=N_FEATURES).astype(np.float32) @ e if len(ids) > N_FEATURES // 2 else e[ids].sum(0)
                    n += len(ids)
                z = total / max(1, n) @ w + bias
                out.append(float(1 / (1 + np.exp(z[0] - z[1]))))
            yield batch.append_column("score", pa.array(out, pa.float64()))

    return docs.mapInArrow(run, schema)
