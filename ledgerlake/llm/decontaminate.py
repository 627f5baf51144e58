"""Benchmark decontamination with DataFrame functions alone.

The normalised n-grams of the benchmark, a table whose size is checked, make a hash set
that every task holds. A document's windows are scanned against it inside the row;
windows that hit are verified by their words against the benchmark's own, and mark the
words they cover. A benchmark with more than ``MAX_SET`` n-grams, or whose n-grams name
more items than that, counted with repetitions, is joined by n-gram instead, after
exploding the windows; there an n-gram has a row for each item, so none grows with the
number of items that share it.

Words are runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased, so ASCII letters, digits and everything beyond ASCII. Null texts have no
words; items without words have no windows; an item with a null id still marks words but
isn't counted. Repeated rows are judged each for itself, repeated items count by their id.
Texts of any length are scanned whole. No row is dropped by ``scan``, no rows give no rows,
without items nothing is hit. A column of ``docs`` that has the name of a result is replaced
by it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.store import without, write_table

#: n-grams in the set that tasks hold, and ids of items with them; about 100 bytes each.
MAX_SET = 100_000
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in the original case.
SEPARATOR_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def ngrams(benchmark: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """Rows (gram, len, item): the distinct windows of each item."""
    w = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), words(F.col(f"`{text}`")).alias("w")).filter(F.size("w") > 0)
    starts = F.expr(f"sequence(1, greatest(size(w) - {n - 1}, 1))")
    grams = w.select("item", F.least(F.size("w"), F.lit(n)).alias("len"), "w", F.explode(starts).alias("i"))
    return grams.select(F.array_join(F.slice("w", F.col("i"), F.col("len")), " ").alias("gram"), "len", "item").distinct()


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 8, max_set: int = MAX_SET) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n_words`` LONG, ``hits`` ARRAY<INT>
    (positions, from 1, of words inside an occurrence of a window) and ``items``
    ARRAY<STRING> (sorted ids of the items with an occurrence)."""
    docs = without(docs, ["n_words", "hits", "items"], [text])
    grams = write_table(ngrams(benchmark, item_id, item_text, n), "grams")
    small = grams.limit(max_set + 1).count() <= max_set
    hashed = F.xxhash64(F.split("gram", " ")).alias("h")
    known = grams.select("len", hashed).distinct().collect() if small else []
    lengths = sorted({r["len"] for r in (known if small else grams.select("len").distinct().collect())})
    kept = [c for c in docs.columns if c != text]
    inner = [f"_c{i}" for i in range(len(kept))]
    base = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(kept, inner, strict=True)], F.monotonically_increasing_id().alias("_row"), words(F.col(f"`{text}`")).alias("_w"))
    parts = []
    for k in lengths:
        spots = f"CASE WHEN size(_w) >= {k} THEN sequence(1, size(_w) - {k - 1}) ELSE array() END"
        if small:
            values = ",".join(f"{r['h']}L" if r["h"] > -(1 << 63) else "CAST(-9223372036854775808 AS BIGINT)" for r in known if r["len"] == k)
            spots = f"filter({spots}, i -> xxhash64(slice(_w, i, {k})) IN ({values}))"
        parts.append(f"transform({spots}, i -> named_struct('at', i, 'len', {k}, 'gram', array_join(slice(_w, i, {k}), ' ')))")
    found = F.expr(f"concat({', '.join(parts)})" if parts else "CAST(array() AS array<struct<at:int,len:int,gram:string>>)")
    rows = base.select(*inner, "_row", F.size("_w").cast("long").alias("n_words"), found.alias("_found"))
    rows = rows.select(*inner, "_row", "n_words", F.explode_outer("_found").alias("_f")).select(*inner, "_row", "n_words", "_f.at", "_f.len", "_f.gram")
    if small:
        right = F.broadcast(grams.groupBy("gram", "len").agg(F.collect_set("item").alias("items")))
    else:
        right = grams.select("gram", "len", F.when(F.col("item").isNull(), F.array().cast("array<string>")).otherwise(F.array("item")).alias("items"))
    joined = rows.join(right, ["gram", "len"], "left")
    spots = F.collect_set(F.when(F.col("items").isNotNull(), F.struct("at", "len")))
    covered = F.array_distinct(F.flatten(F.transform(spots, lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    out = joined.groupBy("_row").agg(*[F.first(c).alias(c) for c in inner], F.first("n_words").alias("n_words"), covered.alias("hits"), items.alias("items"))
    return out.select(*[F.col(x).alias(c) for c, x in zip(kept, inner, strict=True)], "n_words", "hits", "items")


def cut(text: Column, hits: Column) -> Column:
    """``text`` without the words at the positions ``hits`` and what separates each from
    the word before it."""
    w = F.array_remove(F.split(text, SEPARATOR_CASED), "")
    lead = F.regexp_extract(text, f"^{SEPARATOR_CASED}", 0)
    gaps = F.regexp_extract_all(text, F.lit(f"({SEPARATOR_CASED})"), 1)
    gaps = F.when(lead == "", F.concat(F.array(F.lit("")), gaps)).otherwise(gaps)
    # Arguments of a lambda's function are made once, what stands inside for each element.
    both = F.arrays_zip(gaps.alias("g"), w.alias("w"))
    kept = F.filter(both, lambda x, i: x["w"].isNotNull() & ~F.array_contains(hits, i + 1))
    body = F.array_join(F.transform(kept, lambda x: F.concat(x["g"], x["w"])), "")
    tail = F.coalesce(F.get(gaps, F.size(w)), F.lit(""))
    return F.when(F.size(w) == 0, text).otherwise(F.concat(body, tail))
