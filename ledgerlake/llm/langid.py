"""Language identification by string kernels.

The kernel of two texts is a blended-spectrum presence kernel: character n-grams of
lengths 1 to 4 that both texts hold, each counted once however often it occurs, over the
geometric mean of the two texts' numbers of n-grams. N-grams are runs of lower-cased
letters and single spaces for all else, and are hashed to ``N_FEATURES`` buckets. A
Nystrom map on labelled landmarks and one-versus-rest kernel ridge regression give the
weights; whole texts are scored in batches by two matrix products.

The model is fitted on a bounded sample of distinct texts, ``MAX_ROWS`` in all: an equal
number of each language, ``PER_CLASS`` at most and ``LEAST`` at least, so every language
that labels name is learned. Landmarks are taken from the languages in turn.

Null texts and texts without a letter are ``und`` with score 0, as are all texts if no
labelled row has a letter. Repeated rows get equal results and count once in training; of
languages with equal scores the first by name wins. Texts of any length are read whole. No
rows give no rows. A column of ``docs`` that has the name of a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.sampling import distinct_texts
from ledgerlake.llm.store import bounded_batches, release, without

BITS = 15
N_FEATURES = 1 << BITS
ORDERS = 4
#: Labelled texts fitted on: in all, for each language; landmarks among them, in all and
#: for each language.
MAX_ROWS, PER_CLASS, LEAST = 12_800, 800, 8
LANDMARKS, LANDMARKS_EACH = 192, 3
RIDGE = 1e-3
_PIECE = 1 << 20
_ROWS = 128


def _letters() -> np.ndarray:
    """Lower-cased letter of each code point up to U+FFFF, a space for what is none."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def presence(text: str | None, letters: np.ndarray, out: np.ndarray) -> bool:
    """Set the n-gram buckets of ``text`` in ``out``; false if it has no letter. Long
    texts go in pieces that overlap, whole."""
    some = False
    for a in range(0, len(text or ""), _PIECE):
        codes = np.frombuffer(text[a : a + _PIECE + ORDERS].encode("utf-32-le", "surrogatepass"), np.uint32)
        beyond = codes >= 1 << 16
        low = letters[np.where(beyond, 32, codes)]
        if beyond.any():
            found, at = np.unique(codes[beyond], return_inverse=True)
            low[beyond] = np.array([_lower_one(chr(c)) for c in found.tolist()], np.uint32)[at]
        codes = low
        space = codes == 32
        some |= not space.all()
        codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
        h = np.zeros(len(codes), np.uint32)
        for n in range(ORDERS):
            h = (h[: len(codes) - n] * np.uint32(0x01000193) ^ codes[n:]) * np.uint32(0x85EBCA6B)
            out[(h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)] = 1
            if len(h) < 2:
                break
            h = h[:-1]
    return bool(some)


def _lower_one(x: str) -> int:
    return ord(x.lower()[0]) if x.isalpha() else 32


def fit(bits: list[bytes], y: np.ndarray, n_landmarks: int = LANDMARKS) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Classes, landmarks (features x m), weights (m x classes), bias, from the feature
    bits of the rows."""
    unpacked = lambda rows: np.stack([np.unpackbits(np.frombuffer(r, np.uint8)) for r in rows]).astype(np.float32)
    classes = sorted(set(y.tolist()))
    members = [np.flatnonzero(y == c) for c in classes]
    turn = np.argsort(np.concatenate([np.arange(len(m)) for m in members]), kind="stable")
    chosen = np.concatenate(members)[turn[: max(n_landmarks, LANDMARKS_EACH * len(classes))]]
    marks = unpacked([bits[i] for i in chosen])
    marks = marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
    k_nm = []
    for a in range(0, len(bits), _ROWS):
        x = unpacked(bits[a : a + _ROWS])
        k_nm.append(x @ marks.T / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)))
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.concatenate(k_nm) @ root
    mean = z.mean(0)
    target = np.where(y[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    size = np.empty(len(y))
    for m in members:
        size[m] = len(m)
    weight = 1 / size[:, None]
    shift = (target * weight).sum(0) / weight.sum()
    zc = z - mean
    w = np.linalg.solve(zc.T @ (zc * weight) + RIDGE * np.eye(z.shape[1]), zc.T @ ((target - shift) * weight))
    return classes, marks.T.astype(np.float32), (root @ w).astype(np.float32), (shift - mean @ w).astype(np.float32)


def train(labelled: DataFrame, text: str, label: str, max_rows: int = MAX_ROWS, per_class: int = PER_CLASS) -> tuple | None:
    """Fit on a sample of the rows with text and label; None if there is none."""
    n_classes = labelled.select(F.approx_count_distinct(F.col(f"`{label}`"))).head()[0]
    sample = distinct_texts(labelled, text, label, min(max_rows, per_class * n_classes), LEAST, even=True)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            bits, some = [], []
            for t in batch.column("t").to_pylist():
                row = np.zeros(N_FEATURES, np.uint8)
                some.append(presence(t, letters, row))
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "h": batch.column("h"), "some": some, "bits": pa.array(bits, pa.binary())})

    got = sorted(sample.mapInArrow(features, "y string, h long, some boolean, bits binary").filter("some").collect(), key=lambda r: (r["h"], r["y"]))
    if not got:
        return None
    return fit([r["bits"] for r in got], np.array([r["y"] for r in got]))


def predict(docs: DataFrame, model: tuple | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; of ``docs`` only ``text`` is looked at."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, ["lang_pred", "score"], [text])
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            n = batch.num_rows
            pred, score = ["und"] * n, [0.0] * n
            for a in range(0, n, _ROWS) if held.value else ():
                classes, marks, weights, bias = held.value
                texts = batch.column(text).slice(a, _ROWS).to_pylist()
                x = np.zeros((len(texts), N_FEATURES), np.uint8)
                some = [presence(t, letters, row) for t, row in zip(texts, x, strict=True)]
                size = np.sqrt(np.maximum(x.sum(1, dtype=np.float32), 1))
                margin = (x.astype(np.float32) @ marks / size[:, None]) @ weights + bias
                p = np.exp(4 * (margin - margin.max(1, keepdims=True)))
                p /= p.sum(1, keepdims=True)
                for i, (k, ok) in enumerate(zip(p.argmax(1).tolist(), some, strict=True)):
                    if ok:
                        pred[a + i], score[a + i] = classes[k], float(p[i, k])
            yield batch.append_column("lang_pred", pa.array(pred, pa.string())).append_column("score", pa.array(score, pa.float64()))
        release()

    return docs.mapInArrow(run, schema)
