"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bagminhash, bpe, decontaminate, langid, rlz
from ledgerlake.llm.queries import RANKS, held_out
from ledgerlake.llm.store import write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    model = langid.train(docs.filter(~held_out("doc_id", 3, 1)), "text", "lang")
    return langid.predict(docs.select(COLUMNS), model).filter("lang_pred <> 'und'").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays, once if
    its row is repeated. Documents without an id come after all others, and of texts with
    one id that with the smallest hash comes first. Null texts without an id stay."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("id"), F.coalesce(F.md5("text"), F.lit("")).alias("h"))
    found = bagminhash.near_duplicates(docs.select(key.alias("key"), "text"), "key")
    keep = found.filter("key = class_id").select("key.*").distinct()
    rows = docs.select(*COLUMNS, key.alias("key")).select(*COLUMNS, "key.*")
    once = rows.join(keep, ["no_id", "id", "h"], "left_semi").filter("NOT no_id OR text IS NOT NULL").dropDuplicates(["no_id", "id", "h"])
    return once.unionByName(rows.filter("no_id AND text IS NULL")).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has are cut out; documents of which
    nothing stays go. Documents without such a passage keep their text as it is."""
    parsed = rlz.parse(docs.select(COLUMNS), text_as="cut").filter("n_removed = 0 OR n_removed < n_words")
    return parsed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two or more benchmark items go; words inside a window of
    one item are cut out. Hits depend on the text alone, so they come back by its hash,
    whatever the ids are."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    scanned = decontaminate.scan(docs.select(F.md5("text").alias("h"), "text"), benchmark)
    found = scanned.filter(F.size("hits") > 0).groupBy("h").agg(F.max(F.size("items")).alias("n_items"), F.first("hits").alias("hits"))
    found = write_table(found, "hits")
    rows = docs.select(*COLUMNS, F.md5("text").alias("h")).join(found, "h", "left").filter("n_items IS NULL OR n_items < 2")
    text = F.when(F.col("hits").isNotNull(), decontaminate.cut(F.col("text"), F.col("hits"))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    return rows.withColumn("n_chars", F.when(F.col("hits").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with proof that they decode to its text."""
    return bpe.encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN, decoded="decoded").select("doc_id", "ids", *bpe.digest())


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: SQL can't express the kernel classifier, the signatures or the merges; the tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"stage{k}")
    return docs
