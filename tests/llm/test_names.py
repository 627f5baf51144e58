"""Columns of the input that are named like results, however they are cased."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import bagminhash, bpe, chat, decontaminate, langid, lm, quality, queries, rlz, shard, tiff
from ledgerlake.llm.store import without
from tests.llm.helpers import ODD, docs

ROWS = [*ODD, (1, "der hund und die katze"), (2, "the cat and the dog")]


def clashing(spark, *names: str):
    df = docs(spark, ROWS)
    for n in names:
        df = df.withColumn(n, F.lit("given"))
    return df.withColumn("other", F.lit("kept"))


CASES = {
    "language": (lambda df, s: langid.predict(df, langid.train(df.withColumn("l", F.lit("x")), "text", "l")), ["lang_pred", "Score"]),
    "lm": (lambda df, s: lm.score(df), ["n_words", "N_BACKOFF", "lm_score", "block", "data", "bucket"]),
    "substrings": (lambda df, s: rlz.parse(df, width=2), ["n_words", "spans", "n_removed", "Kept", "block"]),
    "quality": (lambda df, s: quality.score(df, quality.train(df.withColumn("y", F.lit(1)), "text", "y")), ["score"]),
    "decontamination": (lambda df, s: decontaminate.scan(df, s.createDataFrame([(1, "the cat")], "item_id int, text string")), ["n_words", "hits", "Items", "_row", "_w", "gram", "len", "at"]),
    "bpe": (lambda df, s: bpe.encode(df, queries.RANKS, public_tokenizers.PATTERN, decoded="decoded"), ["ids", "Decoded", "block"]),
    "decoding": (lambda df, s: bpe.decode(df.withColumn("ids", F.array(F.lit(5))), queries.RANKS), ["decoded"]),
    "tiff": (lambda df, s: tiff.pages(tiff.store(df)), ["n_bytes", "media", "page", "Width", "height", "samples", "bits", "compression", "predictor", "tiled", "data", "error"]),
    "shards": (lambda df, s: shard.assign(df, 3), ["row_number", "Shard", "slot", "part", "at", "tie", "c0"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_names_of_results(spark, name):
    run, names = CASES[name]
    got = run(clashing(spark, *names), spark)
    lowered = [c.lower() for c in got.columns]
    assert len(lowered) == len(set(lowered))
    rows = got.collect()
    assert len(rows) >= len(ROWS) and all(r["other"] == "kept" for r in rows)
    results = {n.lower() for n in names} & set(run(clashing(spark), spark).schema.names)
    assert results and all(r[n] != "given" for r in rows for n in results)


def test_other_operators_take_named_columns_only(spark):
    df = clashing(spark, "node", "sig", "text_id", "class_id", "doc", "band", "root")
    assert len(bagminhash.near_duplicates(df).collect()) == len(ROWS)
    lines = clashing(spark, "role_pred", "opens", "rendered", "key", "pos", "conv", "h", "row", "chunk").withColumn("turn", F.lit(1))
    assert len(chat.format_chat(lines, "doc_id").collect()) == len(ROWS)


def test_a_column_cant_be_read_and_replaced(spark):
    with pytest.raises(ValueError):
        without(docs(spark, ROWS), ["Text"], ["text"])
