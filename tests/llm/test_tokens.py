from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from ledgerlake.llm import bpe, queries
from tests.llm.helpers import ODD, SF, docs, no, sample, words

RANKS = bpe.load_ranks(queries.RANKS)


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_ragged_lists():
    flat, offsets = np.array([1, 2, 3, 4, 5, 6]), np.array([0, 1, 1, 4, 6])
    ids, ends = bpe.ragged(flat, offsets, np.array([3, 1, 0, 2, 3]))
    assert ids.tolist() == [5, 6, 1, 2, 3, 4, 5, 6] and ends.tolist() == [2, 2, 3, 6, 8]
    assert bpe.ragged(flat, offsets, np.array([], int))[0].tolist() == []


def test_pieces_alone_stay_pieces(oracle):
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("ab'sd 's12²  \n\t\u2003.!é漢🙂\u0301\x1c") for _ in range(60))
        pieces = regex.findall(public_tokenizers.PATTERN, text)
        assert sum((oracle.encode_ordinary(p) for p in pieces), []) == oracle.encode_ordinary(text)


def plain_merges(word: bytes) -> list[int]:
    """Of a word's parts the two that make the lowest token together, again and again."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while word not in RANKS and (found := [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in RANKS]):
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [RANKS[word]] if word in RANKS else [RANKS[x] for x in parts]


def test_merges(oracle):
    r = random.Random(4)
    made = ["".join(r.choice("aeinorst aeinorstäé漢字🙂'.\n") for _ in range(r.randint(1, 70))).encode() for _ in range(1500)]
    made += [bytes([i]) for i in range(256)] + [bytes(r.randrange(256) for _ in range(r.randint(1, 50))) for _ in range(300)] + [b"ab" * 300]
    m = bpe.Merges(RANKS)
    assert m.encode(made) == [plain_merges(w) for w in made]
    assert m.encode([w for w in made if len(w) > m.LONG]) == [oracle._core_bpe.encode_single_piece(w) for w in made if len(w) > m.LONG]
    long = (b"z" * 70_000, " ".join(["lorem ipsum"] * 4000).encode())
    assert m.encode([*long]) == [oracle._core_bpe.encode_single_piece(w) for w in long]
    few = bpe.Merges({bytes([i]): i for i in range(256)})
    assert few.encode([b"abc", b"x", b"q" * 90]) == [[97, 98, 99], [120], [113] * 90]


def test_encode_and_decode(spark, oracle):
    rows = [*ODD, *sample(40), (1, "a\r\n\n  b  　x 12345 it's I'LL"), (2, "z" * 50_000), (3, words(30_000, 4)), (4, "<|endoftext|> é́ 🙂🙂 漢字")]
    df = docs(spark, rows, extra=True).repartition(3)
    ids = bpe.encode(df, queries.RANKS, public_tokenizers.PATTERN)
    got = bpe.decode(ids, queries.RANKS)
    assert set(got.columns) == (set(df.columns) - {"text"}) | {"ids", "decoded"}
    expected = sorted((no(i), oracle.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((no(r["doc_id"]), list(r["ids"])) for r in got.collect()) == expected
    expected_bytes = sorted((no(i), (t or "").encode()) for i, t in rows)
    assert sorted((no(r["doc_id"]), bytes(r["decoded"])) for r in got.collect()) == expected_bytes
    both = bpe.encode(df, queries.RANKS, public_tokenizers.PATTERN, decoded="decoded").collect()
    assert sorted((no(r["doc_id"]), list(r["ids"])) for r in both) == expected and sorted((no(r["doc_id"]), bytes(r["decoded"])) for r in both) == expected_bytes


def test_no_rows_and_null_ids(spark):
    df = docs(spark, [(1, "x")]).filter("doc_id = 2")
    assert bpe.decode(bpe.encode(df, queries.RANKS, public_tokenizers.PATTERN), queries.RANKS).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(nothing, queries.RANKS).orderBy("doc_id").collect()] == [None, b""]


def test_query(spark, oracle):
    got = {r["doc_id"]: r for r in queries.op7_byte_bpe(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for i, t in texts:
        ids = oracle.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
