"""The pipeline against a version that compares everything with everything."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

from ledgerlake.llm import bpe, queries
from tests.llm.helpers import no, sample, words
from tests.llm.test_dedup import brute_classes, brute_spans, edited, planted_group
from tests.llm.test_others import WORD, brute_hits, lowered

BENCH = [(1, words(20, 901)), (2, words(25, 902)), (3, "tiny item")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Documents with planted cases of every stage."""
    r = random.Random(11)
    rows = [(i, t) for i, t in sample(80)]
    base = words(200, 50)
    rows += [(1000 + i, edited(base, i % 3, r)) for i in range(12)]
    passage = words(60, 51)
    rows += [(2000 + i, f"{words(80, 100 + i)} {passage} {words(30, 200 + i)}") for i in range(10)]
    rows += [(3000, f"{words(40, 300)} {BENCH[0][1]} {words(40, 301)} {BENCH[1][1]}"), (3001, f"{words(40, 302)}, {BENCH[0][1].upper()}. {words(40, 303)}"), (3002, "Tiny, item and more words")]
    rows += [(4000, None), (4001, ""), (4002, "12 ?!"), (4003, passage), (4004, "plain words stay")]
    r.shuffle(rows)
    to = tmp_path_factory.mktemp("tables")
    n = len(rows)
    columns = {"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "lang": ["en"] * n, "source": ["s"] * n, "n_chars": [len(t or "") for _, t in rows]}
    pq.write_table(pa.table(columns), to / "documents.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in BENCH], "text": [t for _, t in BENCH]}), to / "benchmark.parquet")
    return str(to), rows


def cut_words(text: str, hits: list[int]) -> str:
    """Without the hit words and what is between each and the word before it."""
    spans = [m.span() for m in WORD.finditer("".join(lowered(c) for c in text))]
    out, at = [], 0
    for k, (_, end) in enumerate(spans, 1):
        if k not in hits:
            out.append(text[at:end])
        at = end
    return "".join(out) + text[at:]


def brute_run(rows: list[tuple]) -> dict[int, str]:
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    classes = dict(brute_classes(kept, 0.8))
    kept = [(i, t) for i, t in kept if classes[i] == i]
    spans = {i: (n, gone, text) for i, n, gone, text in brute_spans(kept, 50)}
    kept = [(i, t if not spans[i][1] else spans[i][2]) for i, t in kept if spans[i][1] < max(1, spans[i][0])]
    hits = {i: (h, found) for i, _, h, found in brute_hits(kept, BENCH)}
    return {i: cut_words(t, hits[i][0]) if hits[i][0] else t for i, t in kept if len(hits[i][1]) < 2}


def test_run_against_brute_force(spark, folder):
    path, rows = folder
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.RANKS), special_tokens={})
    got = {r["doc_id"]: (list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, path).collect()}
    expected = brute_run(rows)
    assert set(got) == set(expected)
    for i, t in expected.items():
        assert got[i] == (oracle.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest())
    assert {4000, 4001, 4002, 4003, 3000}.isdisjoint(got) and {3001, 4004, 2000}.issubset(got)


def test_stages_take_and_return_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == corpus_pipeline.COLUMNS
    none = docs.filter("doc_id = -1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0


def test_entry_lists_all(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.QUERIES} <= names and len(queries.QUERIES) == 10
    assert set(__spark_entry__.oracle_sql()) <= names


def documents(spark, rows: list[tuple]):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_near_dedup_of_a_large_group_around_the_threshold(spark):
    rows, classes = planted_group(1200, 7)
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows).repartition(4), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(classes.values()))


def test_near_dedup_without_ids_and_of_equal_ids(spark):
    r, a, b, c = random.Random(2), words(100, 1), words(100, 2), words(100, 3)
    rows = [(None, a), (None, a), (None, edited(a, 1, r)), (5, b), (None, b), (3, c), (7, c), (7, "a text of its own")]
    kept = [(x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()]
    assert len(kept) == 4 and {(5, b), (3, c), (7, "a text of its own")} < set(kept)


def test_decontamination_without_ids_and_of_equal_ids(spark, folder):
    path, _ = folder
    one, two = BENCH[0][1], BENCH[1][1]
    rows = [(None, f"before {one} after"), (None, f"{one} and {two}"), (None, "clean"), (6, f"some words {two} end"), (6, f"{one} start"), (6, "clean as well")]
    kept = corpus_pipeline.decontamination(spark, documents(spark, rows), path).collect()
    assert sorted((no(x["doc_id"]), x["text"], x["n_chars"]) for x in kept) == sorted((no(i), t, len(t)) for i, t in [(None, "before after"), (None, "clean"), (6, "some words end"), (6, " start"), (6, "clean as well")])
