"""Plain Python readings of the filter and eval languages, for comparison."""

from __future__ import annotations

import re

from ledgerlake.plans.evals import Step
from ledgerlake.plans.filters import Name, Node


def check(node: Node, attrs: dict) -> bool:
    def value(x):
        return attrs.get(x.name) if isinstance(x, Name) else x

    def alike(*xs):
        return all(isinstance(x, str) for x in xs) or all(isinstance(x, int) for x in xs)

    def raw(x):
        return x.encode() if isinstance(x, str) else x

    op, args = node.op, node.args
    if op == "NOT":
        return not check(args[0], attrs)
    if op == "AND":
        return check(args[0], attrs) and check(args[1], attrs)
    if op == "OR":
        return check(args[0], attrs) or check(args[1], attrs)
    if op in ("=", "<", ">", "<=", ">=", "<>"):
        a, b = map(value, args)
        if not alike(a, b):
            return False
        a, b = raw(a), raw(b)
        return {"=": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "<>": a != b}[op]
    if op == "BETWEEN":
        x, low, high = map(value, args)
        return alike(x, low, high) and raw(low) <= raw(x) <= raw(high)
    if op == "IN":
        return isinstance(value(args[0]), str) and value(args[0]) in args[1]
    if op == "IN LIST":
        return isinstance(value(args[1]), list) and args[0] in value(args[1])
    if op == "attribute_exists":
        return value(args[0]) is not None
    if op == "attribute_not_exists":
        return value(args[0]) is None
    if op == "attribute_empty":
        return value(args[0]) == ""
    x = value(args[0])
    return isinstance(x, str) and {"contains": args[1] in x, "begins_with": x.startswith(args[1]), "ends_with": x.endswith(args[1])}[op]


def run(steps: list[Step], term, key: str) -> dict:
    attrs: dict = {}
    for s in steps:
        x = term if s.source == "term" else key if s.source == "key" else attrs.get(s.source)
        name = s.out[0] if s.out else None
        if s.op == "delim" and isinstance(x, str):
            parts = x.split(s.args[0])
            for i, n in enumerate(s.out):
                if i < len(parts) and (parts[i] or i == len(parts) - 1):
                    attrs[n] = parts[i]
        elif s.op == "join":
            got = ["" if n not in attrs else attrs[n] for n in s.args[0]]
            attrs[name] = s.args[1].join(g for g in got if isinstance(g, str))
        elif s.op == "split" and isinstance(x, str):
            attrs[name] = [p for p in x.split(s.args[0]) if p]
        elif s.op == "slice" and isinstance(x, str):
            w = s.args[0]
            attrs[name] = [x[i : i + w] for i in range(0, len(x) - w + 1, w)]
        elif s.op == "index" and isinstance(x, str) and len(x) >= sum(s.args):
            attrs[name] = x[s.args[0] : sum(s.args)]
        elif s.op == "kvsplit" and isinstance(x, str):
            for p in x.split(s.args[0]):
                if len(kv := p.split(s.args[1])) == 2:
                    attrs[kv[0]] = kv[1]
        elif s.op == "regex" and isinstance(x, str):
            if (m := re.search(s.args[0], x)) and len(m.groups()) == len(s.out):
                attrs |= dict(zip(s.out, m.groups(), strict=True))
        elif s.op == "map":
            rank = lambda v: (0, v) if isinstance(v, int) else (1, 0) if v is None else (2, 0) if isinstance(v, list) else (3, v.encode())
            how, mappings, default = s.args
            attrs[name] = default
            for k, v in mappings:
                a, b = rank(x), rank(k)
                if {"=": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[how]:
                    attrs[name] = v
                    break
        elif s.op == "to_integer":
            if isinstance(x, int):
                attrs[name] = x
            elif isinstance(x, str) and (m := re.match(r"[+-]?[0-9]+", x)):
                attrs[name] = int(m[0])
        elif s.op == "to_string" and isinstance(x, (int, str)):
            attrs[name] = str(x)
        elif s.op in ("add", "subtract"):
            got = [attrs.get(v, 0) if named else v for named, v in s.args]
            if all(isinstance(g, int) for g in got):
                attrs[name] = got[0] + got[1] if s.op == "add" else got[0] - got[1]
    return attrs
