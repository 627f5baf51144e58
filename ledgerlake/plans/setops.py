"""The set language: UNION, INTERSECT and SUBTRACT of numbered key sets.

All sets meet in one aggregation by key: membership of each set is a boolean, and the
expression becomes a boolean formula of them. So any expression costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.plans.tokens import Cursor, reader

_read = reader(["UNION", "INTERSECT", "SUBTRACT"], ["(", ")"], {}, identifier=r"\$[1-9][0-9]*")
#: Strength, and whether the right side binds first among equals.
STRENGTH = {"UNION": (100, False), "INTERSECT": (150, False), "SUBTRACT": (200, True)}

Tree = int | tuple


def parse(program: str) -> Tree:
    c = Cursor(_read(program))
    tree = _climb(c, 0)
    c.done()
    return tree


def _climb(c: Cursor, least: int) -> Tree:
    if c.peek() == "(":
        c.take("(")
        left = _climb(c, 0)
        c.take(")")
    else:
        left = int(c.take("identifier"))
    while (op := c.peek()) in STRENGTH and STRENGTH[op][0] >= least:
        c.take(op)
        strength, right_first = STRENGTH[op]
        left = (op, left, _climb(c, strength if right_first else strength + 1))
    return left


def ids(tree: Tree) -> set[int]:
    return {tree} if isinstance(tree, int) else ids(tree[1]) | ids(tree[2])


def combine(tree: Tree, sets: dict[int, DataFrame], key: str = "key") -> DataFrame:
    """Distinct keys of the expression over one-column frames; an unknown set is empty."""
    used = sorted(ids(tree) & set(sets))
    member = {k: F.bool_or(F.col("_set") == k) for k in used}

    def build(t: Tree) -> Column:
        if isinstance(t, int):
            return F.col(f"_in{t}") if t in member else F.lit(False)
        left, right = build(t[1]), build(t[2])
        return {"UNION": left | right, "INTERSECT": left & right, "SUBTRACT": left & ~right}[t[0]]

    if not used:
        any_ = next(iter(sets.values()))
        return any_.select(key).filter(F.lit(False))
    rows = None
    for k in used:
        one = sets[k].select(key, F.lit(k).alias("_set"))
        rows = one if rows is None else rows.unionByName(one)
    grouped = rows.groupBy(key).agg(*[c.alias(f"_in{k}") for k, c in member.items()])
    return grouped.filter(build(tree)).select(key)
