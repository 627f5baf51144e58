"""Bounded samples of labelled texts to fit a model on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_texts(labelled: DataFrame, text: str, label: str, max_rows: int, least: int, even: bool, hashed: str | None = None) -> DataFrame:
    """(t, y, h): distinct texts with their label (as text), ``max_rows`` of them at most
    or ``least`` for each class, if that is more. A class gets an ``even`` share of the rows
    or one by its number of distinct texts, but ``least`` at any rate, or all that it has: so
    copies of a text count once, however many there are, and no class is lost. Which ones is
    decided by a hash of the text. Null texts and labels are left out.

    Only hashes and labels are looked at until the texts are known. If ``labelled`` is a
    join, ``hashed`` should name a column that held the texts' ``xxhash64`` before it (null
    for null texts): then the texts that aren't wanted don't take part in it. What is collected is a row for each
    class and the hashes of a sample half as large again."""
    rows = labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").cast("string").alias("y"), (F.col(f"`{hashed}`") if hashed else F.xxhash64(F.col(f"`{text}`"))).alias("h"))
    rows = rows.filter(("h" if hashed else "t") + " IS NOT NULL AND y IS NOT NULL")
    narrow = rows.select("y", "h")
    sizes = {r["y"]: r["n"] for r in narrow.groupBy("y").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return rows.filter("false")
    total = sum(sizes.values())
    wanted = {y: max(least, max_rows // len(sizes) if even else max_rows * n // total) for y, n in sizes.items()}
    shares = [(y, min(1.0, (1.5 * wanted[y] + 50) / n)) for y, n in sizes.items()]
    given = F.broadcast(labelled.sparkSession.createDataFrame(shares, "y string, share double"))
    drawn = narrow.join(given, "y").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * float(1 << 30)).select("y", "h").distinct()
    chosen: dict[str, list[int]] = {}
    for r in sorted(drawn.collect()):
        if len(some := chosen.setdefault(r["y"], [])) < wanted[r["y"]]:
            some.append(r["h"])
    pairs = labelled.sparkSession.createDataFrame([(y, h) for y, some in chosen.items() for h in some], "y string, h bigint")
    # A list of constants is looked at where the texts are read, below any join.
    constants = ",".join(f"{h}L" if h > -(1 << 63) else "CAST(-9223372036854775808 AS BIGINT)" for h in {h for some in chosen.values() for h in some})
    of_hash = rows.filter(F.expr(f"h IN ({constants})"))
    return of_hash.join(F.broadcast(pairs), ["y", "h"], "left_semi").groupBy("y", "h").agg(F.first("t").alias("t")).select("t", "y", "h")
