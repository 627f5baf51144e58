from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerlake.llm import bagminhash, queries, rlz
from ledgerlake.llm.components import components
from tests.llm.helpers import ODD, SF, docs, no, sample, words


def brute_spans(rows: list[tuple], width: int) -> list[tuple]:
    """(doc_id, n_words, removed, kept) by comparing all windows."""
    order = lambda i: 1 << 70 if i is None else i
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            least[g] = min(least.get(g, 1 << 80), order(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < order(i):
                gone[k : k + width] = [True] * width
        out.append((order(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def test_factors():
    held = np.array([0, 1, 1, 0, 0, 1, 1, 1], bool)
    source, at = np.array([9, 1, 1, 9, 9, 2, 2, 3]), np.array([0, 4, 5, 0, 0, 7, 9, 10])
    assert rlz.factors(source, at, held, 3) == [(1, 4, 1, 4), (5, 3, 2, 7), (6, 3, 2, 9), (7, 3, 3, 10)]
    assert rlz.factors(source, at, np.zeros(8, bool), 3) == []


@pytest.mark.parametrize("width", [3, 50])
def test_substrings_against_all_windows(spark, width):
    r = random.Random(width)
    passages = [words(70, s) for s in range(4)]
    rows = [*ODD, (5, words(20_000, 9)), (6, words(20_000, 9) + " tail"), (None, words(20_000, 9))]
    for i in range(60):
        rows.append((r.randrange(1000), " ".join(r.choice([r.choice(passages), words(r.randint(1, 40), i * 7 + k)]) for k in range(r.randint(1, 4)))))
    rows += [(2000 + i, passages[0]) for i in range(30)]
    # Passages that overlap in the reference: a factor begins inside the one before.
    long = words(200, 70).split()
    rows += [(3000, " ".join(long[:120])), (3001, " ".join(long[60:])), (3002, " ".join(long))]
    r.shuffle(rows)
    got = rlz.parse(docs(spark, rows, extra=True).repartition(5), width=width)
    made = got.select("doc_id", "n_words", "n_removed", "kept", "spans", "text", "block").collect()
    assert sorted(((1 << 70) if x["doc_id"] is None else x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in made) == brute_spans(rows, width)
    by: dict[int, list[list[str]]] = {}
    for i, t in rows:
        by.setdefault(i, []).append((t or "").split())
    for x in made:
        mine = (x["text"] or "").split()
        for s in x["spans"]:
            assert s["words"] >= width and (x["doc_id"] is None or s["source"] < x["doc_id"])
            if len(by[s["source"]]) == 1:
                assert mine[s["start"] : s["start"] + s["words"]] == by[s["source"]][0][s["at"] : s["at"] + s["words"]]
    if width == 50:
        (last,) = [x for x in made if x["doc_id"] == 3002]
        assert [tuple(s) for s in last["spans"]] == [(0, 120, 3000, 0), (71, 129, 3001, 11)]


def test_substrings_in_place_of_the_text(spark):
    rows = [(1, "a  b c d"), (2, "x  y a b c"), (3, None), (4, " plain  text ")]
    df = docs(spark, rows)
    cut = {r["doc_id"]: r["text"] for r in rlz.parse(df, width=3, text_as="cut").collect()}
    assert cut == {1: "a  b c d", 2: "x y", 3: None, 4: " plain  text "}
    kept = rlz.parse(df, width=3, text_as="kept")
    assert kept.columns == ["doc_id", "n_words", "spans", "n_removed", "kept"]
    assert {r["doc_id"]: (r["n_words"], r["kept"]) for r in kept.collect()} == {1: (4, "a b c d"), 2: (5, "x y"), 3: (0, ""), 4: (2, "plain text")}
    with pytest.raises(ValueError):
        rlz.parse(df.selectExpr("cast(doc_id as string) doc_id", "text"))


def test_substrings_of_no_rows(spark):
    assert rlz.parse(docs(spark, ODD).filter("doc_id = -1")).count() == 0


def test_substring_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op3_substring_dedup(spark, SF).collect())
    assert got == [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_spans(rows, 50)]


def weights(text: str | None) -> Counter:
    w = (text or "").lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows: list[tuple], threshold: float) -> list[tuple]:
    """(doc_id, class id) by comparing all pairs."""
    texts = list({t for _, t in rows if t is not None})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    w = {t: weights(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if not w[a] or not w[b] or not w[a].keys() & w[b].keys():
                continue
            same = sum((w[a] & w[b]).values())
            if same / (sum(w[a].values()) + sum(w[b].values()) - same) >= threshold:
                root[find(a)] = find(b)
    least: dict = {}
    for i, t in rows:
        if t is not None and i is not None:
            least[find(t)] = min(least.get(find(t), 1 << 70), i)
    return sorted((no(i), no(i if t is None else least.get(find(t)))) for i, t in rows)


def test_signatures_are_unbiased():
    r = np.random.default_rng(3)
    errors = []
    for _ in range(150):
        n = int(r.integers(5, 150))
        keys = np.sort(r.integers(0, 1 << 63, n).astype(np.uint64))
        a = r.integers(0, 9, n)
        b = np.where(r.random(n) < 0.6, a, r.integers(0, 9, n))
        if not a.any() or not b.any():
            continue
        s = bagminhash.signatures(np.concatenate([keys[a > 0], keys[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), 2)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_multisets_count_repetitions():
    h = np.array([5, 5, 5, 9], np.uint64)
    assert len(bagminhash.multiset(h)) == 4
    assert len(np.intersect1d(bagminhash.multiset(h), bagminhash.multiset(h[1:]))) == 3


def edited(text: str, n: int, r: random.Random) -> str:
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(5)
    rows = [(i, t) for i, t in ODD]
    base = words(300, 1)
    rows += [(100 + i, edited(base, r.choice([0, 1, 2, 3, 4, 8, 30]), r)) for i in range(60)]
    chain = words(200, 2)
    for i in range(30):  # each near the last, the first far from the end
        rows.append((300 + i, chain))
        chain = edited(chain, 3, r)
    rows += [(400 + i, "spam " * (100 + 4 * i)) for i in range(8)]
    rows += [(500 + i, words(120, 60 + i)) for i in range(30)] + sample(60)
    rows.append((700, words(40_000, 8)))
    rows.append((701, words(40_000, 8) + " end"))
    r.shuffle(rows)
    got = bagminhash.near_duplicates(docs(spark, rows, extra=True).repartition(4))
    made = sorted((no(x["doc_id"]), no(x["class_id"])) for x in got.collect())
    assert made == brute_classes(rows, 0.8)


def planted_group(n: int, first: int = 0) -> tuple[list[tuple], dict[int, int]]:
    """Texts of one base whose similarity is mostly just under 0.8 and seldom just over it,
    and their classes by comparing all pairs."""
    r, base = random.Random(3), words(300, 77).split()
    rows = []
    for i in range(n):
        w = list(base)
        for k in r.sample(range(len(w)), 5):
            w[k] = f"edit{r.randrange(10**9)}"
        rows.append((first + i, " ".join(w)))
    known: dict[tuple, int] = {}
    held = [[known.setdefault(g, len(known)) for g in weights(t)] for _, t in rows]
    m = np.zeros((n, len(known)), np.float32)
    for row, at in zip(m, held, strict=True):
        row[at] = 1
    size, m = m.sum(1), m[:, m.sum(0) > 1]
    same = m @ m.T
    near = same / (size[:, None] + size - same) >= 0.8
    least = np.arange(n)
    while (lower := np.array([least[x].min() for x in near])).tolist() != least.tolist():
        least = lower
    return rows, {first + i: first + int(k) for i, k in enumerate(least)}


def test_large_group_around_the_threshold_against_all_pairs(spark):
    rows, expected = planted_group(1500)
    made = {x["doc_id"]: x["class_id"] for x in bagminhash.near_duplicates(docs(spark, rows).repartition(4)).collect()}
    assert 1 < len(set(expected.values())) < len(rows) and made == expected


def test_spanning_links_each_component_once():
    r = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([np.arange(20), r.integers(100, 112, 6)])).astype(np.uint32) for _ in range(60)]
    roots = [b"%02d" % (i // 2) for i in range(60)]
    sides = np.arange(60) % 3 == 0
    for left, right in [(np.arange(60), None), (np.flatnonzero(sides), np.flatnonzero(~sides))]:
        root = {x: x for x in roots}

        def find(x):
            while root[x] != x:  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        for a in left:
            for b in left if right is None else right:
                if a != b and len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.85:
                    root[find(roots[a])] = find(roots[b])
        found = list(bagminhash.spanning(roots, sets, left, right, 0.85))
        assert len(found) == len(root) - len({find(x) for x in root}) and all(find(a) == find(b) for a, b in found)


def test_pairs_under_the_floor_are_verified(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "FLOOR", 1.5)
    monkeypatch.setattr(bagminhash, "PART", 7, raising=False)
    r, base = random.Random(6), words(200, 4)
    rows = [(i, edited(base, i % 4, r)) for i in range(40)] + [(100 + i, words(120, 60 + i)) for i in range(5)]
    made = sorted((x["doc_id"], x["class_id"]) for x in bagminhash.near_duplicates(docs(spark, rows)).collect())
    assert made == brute_classes(rows, 0.8)


def test_near_duplicates_of_no_rows_and_of_nulls(spark):
    assert bagminhash.near_duplicates(docs(spark, ODD).filter("doc_id = -1")).count() == 0
    got = bagminhash.near_duplicates(docs(spark, [(1, None), (2, None), (3, ""), (4, "")])).collect()
    assert sorted((x["doc_id"], x["class_id"]) for x in got) == [(1, 1), (2, 2), (3, 3), (4, 3)]


def test_near_duplicate_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((no(x["doc_id"]), no(x["class_id"])) for x in queries.op8_near_duplicates(spark, SF).collect())
    assert got == brute_classes(rows, 0.8)


def test_components(spark):
    r = random.Random(2)
    edges = [(f"{a:03d}", f"{a + 1:03d}") for a in range(0, 40)] + [(f"{r.randrange(50, 90):03d}", f"{r.randrange(50, 90):03d}") for _ in range(25)]
    root = {}
    for a, b in edges:
        root.setdefault(a, {a})
        root.setdefault(b, {b})
        if root[a] is not root[b]:
            root[a] |= root[b]
            for x in root[b]:
                root[x] = root[a]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {k: min(v) for k, v in root.items() if len(v) > 1}
