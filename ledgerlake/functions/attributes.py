"""Attributes: values that are text, a whole number, a list of texts or absent.

An attribute is a struct (s, i, l) with at most one field that isn't null; all null means
absent. Comparisons of unlike types come out null by themselves, and a coalesce at each
leaf keeps the logic two-valued.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<s:string,i:bigint,l:array<string>>"


def text(c: Column) -> Column:
    return F.struct(c.cast("string").alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("array<string>").alias("l"))


def number(c: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("s"), c.cast("bigint").alias("i"), F.lit(None).cast("array<string>").alias("l"))


def texts(c: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("bigint").alias("i"), c.cast("array<string>").alias("l"))


def absent() -> Column:
    return text(F.lit(None))


def term(s: Column, i: Column) -> Column:
    """The attribute of an index term, which is text or a number."""
    return F.struct(s.cast("string").alias("s"), i.cast("bigint").alias("i"), F.lit(None).cast("array<string>").alias("l"))


def literal(value: str | int) -> Column:
    return text(F.lit(value)) if isinstance(value, str) else number(F.lit(value))


def exists(a: Column) -> Column:
    return a["s"].isNotNull() | a["i"].isNotNull() | a["l"].isNotNull()


def when(condition: Column, new: Column, old: Column) -> Column:
    """``new`` where ``condition`` is true, else what was there."""
    return F.when(F.coalesce(condition, F.lit(False)), new).otherwise(old)
