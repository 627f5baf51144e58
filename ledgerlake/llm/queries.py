"""One query for each operator, over its whole table, and their SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bagminhash, bpe, chat, decontaminate, langid, lm, quality, rlz, shard, tiff

#: The rank file of op7; a parameter of the operator.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

N_SHARDS, SHARD_KEY = 24, 20240229


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, mod: int, rest: int) -> Column:
    """Whether a row is held out by its id; a row without an id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == rest, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 3, 1))
    model = langid.train(docs.filter(~F.col("held_out")), "text", "lang")
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.withColumn("lm_score", F.round("lm_score", 6))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rlz.parse(docs, text_as="kept").select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    hashed = docs.filter(~F.col("held_out")).withColumn("h", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    model = quality.train(hashed.join(labels, "doc_id"), "text", "quality", hashed="h")
    return quality.score(docs, model).drop("text").withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations")
    model = chat.train(lines.filter(~held_out("conv_id", 5, 0)), "conv_id", "turn", "text", "role")
    return chat.format_chat(lines.select("conv_id", "turn", "text"), model=model)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="decoded").select("doc_id", *bpe.digest())


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file from its page rows, which follow each other in order."""
    names = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    held: list = []
    sha, n, tail, count, kinds = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), []

    def row() -> list:
        share = count[count > 0] / max(1, n)
        feature = f"pages={len(kinds)};compressions={','.join(map(str, sorted(set(kinds))))};mean={(count @ np.arange(256)) / max(1, n):.4f};entropy={-(share @ np.log2(share)):.4f}"
        return [*held, n, sha.hexdigest(), zlib.crc32(tail), feature]

    def batch_of(rows: list) -> pa.RecordBatch:
        kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())])
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in names]
        for i, (page, data, how, error) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page", "data", "compression", "error")), strict=True)):
            if error:
                raise ValueError(f"page {page} of document {cols[0][i]}: {error}")
            if page == 0:
                if kinds:
                    out.append(row())
                held = [c[i] for c in cols]
                sha, n, tail, count, kinds = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), []
            sha.update(data)
            n, tail = n + len(data), data[-16:]
            count += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            kinds.append(how)
        if out:
            yield batch_of(out)
    if kinds:
        yield batch_of([row()])


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.store(table(spark, sf_dir, "documents").select("doc_id", "text"))
    files = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    folded = tiff.pages(files).mapInArrow(_fold_pages, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    return folded.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard.assign(rows, N_SHARDS, SHARD_KEY)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_lm_score": op2_lm_score,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_chat_format": op6_chat_format,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_tiff": op9_tiff,
    "op10_feistel_shards": op10_feistel_shards,
}

SQL: dict[str, str] = {
    "op2_lm_score": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT r, i, n, array_to_string(w[i - n + 1 : i], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), (VALUES (1), (2), (3)) AS v(n) WHERE i >= n
), k AS (
  SELECT r, i, n, count(*) OVER (PARTITION BY n, s) - count(*) OVER (PARTITION BY r, n, s) AS k FROM g
), p AS (
  SELECT r, i, max(k) FILTER (n = 1) AS k1, max(k) FILTER (n = 2) AS k2, max(k) FILTER (n = 3) AS k3 FROM k GROUP BY r, i
), b AS (SELECT *, lag(k1) OVER o AS p1, lag(k2) OVER o AS p2 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, doc_id, len(w) AS n, sum(len(w)) OVER () - len(w) AS rest FROM d),
l AS (
  SELECT r, least(i, 3) AS most, CASE WHEN i >= 3 AND k3 > 0 AND p2 > 0 THEN 3 WHEN i >= 2 AND k2 > 0 AND p1 > 0 THEN 2 ELSE 1 END AS level,
    k1, k2, k3, p1, p2, rest FROM b JOIN t USING (r)
), f AS (
  SELECT r, sum((most - level) * ln(0.4) + CASE level WHEN 3 THEN ln(k3 / p2) WHEN 2 THEN ln(k2 / p1) ELSE ln(greatest(k1, 1) / greatest(rest, 1)) END) AS score,
    count(*) FILTER (level < most) AS n_backoff FROM l GROUP BY r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(score / n, 6) AS lm_score FROM t LEFT JOIN f USING (r)""",
    "op3_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, doc_id, i, array_to_string(w[i : i + 49], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), m AS (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM g),
c AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM m WHERE least < doc_id) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ps, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (r)""",
    "op5_decontaminate": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 8) AS k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), s AS (
  SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)
), h AS (SELECT r, i, k, item FROM s JOIN g USING (k, gram)),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
m AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(m.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)""",
}
