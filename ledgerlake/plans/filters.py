"""The filter language: conditions on attributes, compiled to one non-null boolean."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions import attributes as A
from ledgerlake.plans.tokens import Cursor, LanguageError, bind, reader

COMPARE = {"=": operator.eq, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "<>": operator.ne}
TEXT = {"contains": "contains", "begins_with": "startswith", "ends_with": "endswith"}
PRESENCE = ("attribute_exists", "attribute_not_exists", "attribute_empty")

_read = reader(
    ["NOT", "AND", "OR", "BETWEEN", "IN", *TEXT, *PRESENCE],
    ["(", ")", ",", *COMPARE],
    {"integer": r"-?[0-9]+"},
)


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple


Operand = Name | str | int


def parse(program: str, values: dict[str, str | int] | None = None) -> Node:
    """The tree of ``program`` with its substitutions bound."""
    c = Cursor(bind(_read(program), values or {}, "integer"))
    tree = _either(c)
    c.done()
    return tree


def _either(c: Cursor) -> Node:
    left = _both(c)
    while c.peek() == "OR":
        c.take("OR")
        left = Node("OR", (left, _both(c)))
    return left


def _both(c: Cursor) -> Node:
    left = _one(c)
    while c.peek() == "AND":
        c.take("AND")
        left = Node("AND", (left, _one(c)))
    return left


def _operand(c: Cursor) -> Operand:
    named = c.peek() == "identifier"
    value = c.take("identifier", "integer", "string")
    return Name(value) if named else value


def _one(c: Cursor) -> Node:
    kind = c.peek()
    if kind == "NOT":
        c.take("NOT")
        return Node("NOT", (_one(c),))
    if kind == "(":
        c.take("(")
        inside = _either(c)
        c.take(")")
        return inside
    if kind in TEXT:
        c.take(kind)
        c.take("(")
        name = Name(c.take("identifier"))
        c.take(",")
        part = c.take("string")
        c.take(")")
        return Node(kind, (name, part))
    if kind in PRESENCE:
        c.take(kind)
        c.take("(")
        name = Name(c.take("identifier"))
        c.take(")")
        return Node(kind, (name,))
    left = _operand(c)
    if c.peek() == "BETWEEN":
        c.take("BETWEEN")
        low = _operand(c)
        c.take("AND")
        return Node("BETWEEN", (left, low, _operand(c)))
    if c.peek() == "IN":
        c.take("IN")
        if isinstance(left, Name):
            c.take("(")
            items = [c.take("string")]
            while c.peek() == ",":
                c.take(",")
                items.append(c.take("string"))
            c.take(")")
            return Node("IN", (left, tuple(items)))
        if isinstance(left, str):
            return Node("IN LIST", (left, Name(c.take("identifier"))))
        raise LanguageError("a number can't be sought in a list")
    return Node(c.take(*COMPARE), (left, _operand(c)))


def names(tree: Node | Name | object) -> set[str]:
    if isinstance(tree, Name):
        return {tree.name}
    return set().union(*map(names, tree.args)) if isinstance(tree, Node) else set()


def condition(tree: Node, attribute: Callable[[str], Column | None]) -> Column:
    """``tree`` as a boolean that is never null. ``attribute`` gives a name's struct, or
    None for a name that nothing sets."""

    def value(x: Operand) -> Column:
        if not isinstance(x, Name):
            return A.literal(x)
        got = attribute(x.name)
        return A.absent() if got is None else got

    def sure(*options: Column) -> Column:
        return F.coalesce(*options, F.lit(False))

    def build(node: Node) -> Column:
        op, args = node.op, node.args
        if op == "NOT":
            return ~build(args[0])
        if op in ("AND", "OR"):
            left, right = map(build, args)
            return left & right if op == "AND" else left | right
        if op in COMPARE:
            left, right = map(value, args)
            return sure(COMPARE[op](left["s"], right["s"]), COMPARE[op](left["i"], right["i"]))
        if op == "BETWEEN":
            x, low, high = map(value, args)
            return sure(_between(x, low, high))
        if op == "IN":
            return sure(value(args[0])["s"].isin(*args[1]))
        if op == "IN LIST":
            return sure(F.array_contains(value(args[1])["l"], args[0]))
        if op in TEXT:
            return sure(getattr(value(args[0])["s"], TEXT[op])(args[1]))
        if op == "attribute_exists":
            return A.exists(value(args[0]))
        if op == "attribute_not_exists":
            return ~A.exists(value(args[0]))
        return sure(value(args[0])["s"] == "")

    return build(tree)


def _between(x: Column, low: Column, high: Column) -> Column:
    """All three of one type; null AND false is false, so each type is tried whole."""

    def of(k: str) -> Column:
        return F.when(x[k].isNotNull() & low[k].isNotNull() & high[k].isNotNull(), (x[k] >= low[k]) & (x[k] <= high[k]))

    return F.coalesce(of("s"), of("i"))
