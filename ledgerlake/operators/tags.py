"""What an application may define for a tag of its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(row: Callable[[str], Column]) -> Column:
    """Bytes that stand for a ledger key in hash trees."""
    return F.concat(F.coalesce(row("bucket_type"), F.lit("")), row("bucket"), row("key"))


def canonical_with_sub_key(row: Callable[[str], Column]) -> Column:
    return F.concat(canonical(row), F.coalesce(row("sub_key"), F.lit("")))


def diff_specs(old: Column, new: Column) -> Column:
    """Index changes from the old terms to the new ones: removals, then additions."""
    mark = lambda xs, op: F.transform(xs, lambda x: F.struct(F.lit(op).alias("op"), x["field"].alias("field"), x["term_s"].alias("term_s"), x["term_i"].alias("term_i")))
    return F.concat(mark(F.array_except(old, new), "remove"), mark(F.array_except(new, old), "add"))


@dataclass
class Tag:
    canonical: Callable[[Callable[[str], Column]], Column] = canonical
    build_head: Callable[[Callable[[str], Column]], Column] | None = None
    extract_metadata: Callable[[Column], dict[str, Column]] | None = None
    diff: Callable[[Column, Column], Column] = diff_specs
    #: The terms (field, term_s, term_i) that a body should be indexed by, if it tells them.
    index_terms: Callable[[Column], Column] | None = None
    strategy: str = "retain"


@dataclass
class Tags:
    """Tags by name; the built-in ones can be replaced."""

    known: dict[str, Tag] = field(default_factory=lambda: {"o": Tag(), "o_rkv": Tag(), "h": Tag(canonical=canonical_with_sub_key)})

    def of(self, tag: str) -> Tag:
        return self.known.get(tag, Tag())
