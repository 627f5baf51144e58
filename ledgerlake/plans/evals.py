"""The eval language: a pipeline that parses index terms into attributes.

Each step is one projection over the attributes made so far. A step that can't apply
leaves its output attributes as they were. Only attributes that something later looks at
are computed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import attributes as A
from ledgerlake.plans.tokens import Cursor, LanguageError, bind, reader

FUNCTIONS = ["delim", "join", "split", "slice", "index", "kvsplit", "regex", "to_integer", "to_string", "add", "subtract", "map"]
COMPARATORS = ["=", "<", ">", "<=", ">="]
_read = reader(
    [*FUNCTIONS, "pcre"],
    ["(", ")", ",", "|", *COMPARATORS],
    {"pos_integer": r"[1-9][0-9]*", "zero": "0", "neg_integer": r"-[0-9]+"},
)
PREFIX = "attr:"


@dataclass(frozen=True)
class Step:
    op: str
    source: str | None = None
    args: tuple = ()
    out: tuple[str, ...] = ()


def parse(program: str, values: dict[str, str | int] | None = None) -> list[Step]:
    """The steps of ``program``. A substitution by a number is a syntax error here, as the
    language has no plain integer token."""
    c = Cursor(bind(_read(program), values or {}, "integer"))
    steps = [_step(c)]
    while c.peek() == "|":
        c.take("|")
        steps.append(_step(c))
    c.done()
    return steps


def _name(c: Cursor) -> str:
    return str(c.take("identifier"))


def _names(c: Cursor) -> tuple[str, ...]:
    c.take("(")
    out = [_name(c)]
    while c.peek() == ",":
        c.take(",")
        out.append(_name(c))
    c.take(")")
    return tuple(out)


def _literal(c: Cursor) -> str | int:
    return c.take("string", "pos_integer", "zero", "neg_integer")


def _maths(c: Cursor) -> tuple[bool, str | int]:
    named = c.peek() == "identifier"
    return named, c.take("identifier", "pos_integer", "zero", "neg_integer")


def _mappings(c: Cursor) -> tuple:
    c.take("(")
    out = []
    while True:
        c.take("(")
        key = _literal(c)
        c.take(",")
        out.append((key, _literal(c)))
        c.take(")")
        if c.peek() != ",":
            break
        c.take(",")
    c.take(")")
    return tuple(out)


def _step(c: Cursor) -> Step:
    op = c.take(*FUNCTIONS)
    c.take("(")
    comma = lambda: c.take(",")
    if op == "join":
        names = _names(c)
        comma()
        by = c.take("string")
        comma()
        step = Step(op, None, (names, by), (_name(c),))
    elif op in ("add", "subtract"):
        x = _maths(c)
        comma()
        y = _maths(c)
        comma()
        step = Step(op, None, (x, y), (_name(c),))
    else:
        source = _name(c)
        comma()
        if op in ("to_integer", "to_string"):
            step = Step(op, source, (), (_name(c),))
        elif op == "delim":
            by = c.take("string")
            comma()
            step = Step(op, source, (by,), _names(c))
        elif op == "split":
            by = c.take("string")
            comma()
            step = Step(op, source, (by,), (_name(c),))
        elif op == "slice":
            width = c.take("pos_integer")
            comma()
            step = Step(op, source, (width,), (_name(c),))
        elif op == "index":
            start = c.take("pos_integer", "zero")
            comma()
            length = c.take("pos_integer")
            comma()
            step = Step(op, source, (start, length), (_name(c),))
        elif op == "kvsplit":
            pair = c.take("string")
            comma()
            step = Step(op, source, (pair, c.take("string")))
        elif op == "regex":
            pattern = java_pattern(str(c.take("string")))
            comma()
            if c.peek() == "pcre":
                c.take("pcre")
                comma()
            step = Step(op, source, (pattern,), _names(c))
        else:
            how = c.take(*COMPARATORS)
            comma()
            mappings = _mappings(c)
            comma()
            default = _literal(c)
            comma()
            step = Step(op, source, (how, mappings, default), (_name(c),))
    c.take(")")
    return step


def java_pattern(pattern: str) -> str:
    """Captures count by position, so named groups become plain ones."""
    if re.search(r"\(\?P=|\\k[<{']|\(\?&|\(\?P>|\(\?R\)", pattern):
        raise LanguageError(f"references by name aren't supported: {pattern}")
    return re.sub(r"\(\?P?<(?![=!])[A-Za-z_][A-Za-z_0-9]*>", "(", pattern)


def groups(pattern: str) -> int:
    """Captures of a pattern."""
    plain = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", pattern, flags=re.DOTALL)
    return len(re.findall(r"\((?!\?)", plain))


def quoted(delimiter: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\s\u0080-\U0010ffff])", r"\\\1", delimiter)


def inputs(step: Step) -> set[str]:
    out = {step.source} if step.source else set()
    if step.op == "join":
        out |= set(step.args[0])
    if step.op in ("add", "subtract"):
        out |= {v for named, v in step.args if named}
    return out


def apply(steps: list[Step], df: DataFrame, term: Column, key: Column, wanted: Iterable[str]) -> tuple[DataFrame, set[str]]:
    """``df`` with a column ``attr:name`` for each attribute in ``wanted`` that a step may
    set, and the set of those names. ``term`` is an attribute struct, ``key`` a string."""
    needed = [set(wanted)]
    for step in reversed(steps):
        needed.append(needed[-1] | inputs(step))
    needed = needed[::-1][1:]  # what is looked at after each step
    have: set[str] = set()
    for step, after in zip(steps, needed, strict=True):
        made = _columns(step, after, have, term, key)
        if made:
            df = df.withColumns({PREFIX + n: c for n, c in made.items()})
            have |= set(made)
    found = have & set(wanted)
    # A filter pushed below the steps would repeat each step as often as the next one looks
    # at it, and grow by a power; one over a column that isn't deterministic stays above.
    here = F.monotonically_increasing_id() >= 0
    return df.withColumns({PREFIX + n: F.when(here, F.col(f"`{PREFIX}{n}`")) for n in sorted(found)}), found


def _columns(step: Step, after: set[str], have: set[str], term: Column, key: Column) -> dict[str, Column]:
    def old(name: str) -> Column:
        return F.col(f"`{PREFIX}{name}`") if name in have else A.absent()

    def source() -> Column:
        return term if step.source == "term" else A.text(key) if step.source == "key" else old(step.source)

    op, args = step.op, step.args
    out = [n for n in step.out if n in after]
    if op == "kvsplit":
        s, pair, kv = source()["s"], *args
        parts = F.transform(F.split(s, quoted(pair), -1), lambda p: F.split(p, quoted(kv), -1))
        last = lambda n: F.try_element_at(F.filter(parts, lambda x: (F.size(x) == 2) & (x[0] == n)), F.lit(-1))[1]
        return {n: A.when(last(n).isNotNull(), A.text(last(n)), old(n)) for n in after}
    if not out:
        return {}
    name = step.out[0]
    if op == "delim":
        p = F.split(source()["s"], quoted(args[0]), -1)
        made = {}
        for i, n in enumerate(step.out):
            if n in after:
                good = (F.size(p) > i) & ((F.lit(i) == F.size(p) - 1) | (p[i] != "")) & source()["s"].isNotNull()
                made[n] = A.when(good, A.text(F.get(p, F.lit(i))), made.get(n, old(n)))
        return made
    if op == "join":
        each = [F.when(A.exists(old(n)), old(n)["s"]).otherwise("") for n in args[0]]
        return {name: A.text(F.array_join(F.array(*each), args[1]))}
    if op == "split":
        s = source()["s"]
        return {name: A.when(s.isNotNull(), A.texts(F.array_remove(F.split(s, quoted(args[0]), -1), "")), old(name))}
    if op == "slice":
        s = source()["s"]
        return {name: A.when(s.isNotNull(), A.texts(F.regexp_extract_all(s, F.lit(rf"(?s)\X{{{args[0]}}}"), 0)), old(name))}
    if op == "index":
        s, (start, length) = source()["s"], args
        pattern = rf"(?s)^\X{{{start}}}(\X{{{length}}})"
        return {name: A.when(s.rlike(pattern), A.text(F.regexp_extract(s, pattern, 1)), old(name))}
    if op == "regex":
        s, (pattern,) = source()["s"], args
        if groups(pattern) != len(step.out):
            return {}
        return {n: A.when(s.rlike(pattern), A.text(F.regexp_extract(s, pattern, i)), old(n)) for i, n in enumerate(step.out, 1) if n in after}
    if op == "map":
        x, (how, mappings, default) = source(), args
        chosen = None
        for k, v in mappings:
            hit = _ordered(x, how, k)
            chosen = F.when(hit, A.literal(v)) if chosen is None else chosen.when(hit, A.literal(v))
        return {name: chosen.otherwise(A.literal(default))}
    if op == "to_integer":
        x = source()
        parsed = F.nullif(F.regexp_extract(x["s"], r"^[+-]?[0-9]+", 0), F.lit("")).try_cast("bigint")
        number = F.coalesce(x["i"], parsed)
        return {name: A.when(number.isNotNull(), A.number(number), old(name))}
    if op == "to_string":
        x = source()
        text = F.coalesce(x["s"], x["i"].cast("string"))
        return {name: A.when(text.isNotNull(), A.text(text), old(name))}

    def side(named: bool, v: str | int) -> Column:
        return F.when(A.exists(old(v)), old(v)["i"]).otherwise(F.lit(0).cast("bigint")) if named else F.lit(v).cast("bigint")

    x, y = (side(*a) for a in args)
    total = F.try_add(x, y) if op == "add" else F.try_subtract(x, y)
    return {name: A.when(total.isNotNull(), A.number(total), old(name))}


def _ordered(x: Column, how: str, k: str | int) -> Column:
    """``x how k`` over all types: numbers come before what is absent, then lists, then
    texts."""
    side = x["s"] if isinstance(k, str) else x["i"]
    same = {"=": side == k, "<": side < k, ">": side > k, "<=": side <= k, ">=": side >= k}[how]
    other = how in ("<", "<=") if isinstance(k, str) else how in (">", ">=")
    return F.coalesce(same, F.lit(other))
