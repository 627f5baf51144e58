from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import blocks, chat, decontaminate, langid, lm, quality, queries, shard, tiff
from tests.llm.helpers import ODD, SF, docs, no, sample, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# Language ID


def test_language_of_odd_texts(spark):
    model = langid.train(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "xx"), ("no label", None), ("12 !", "yy")] * 5, "text string, lang string"), "text", "lang")
    got = langid.predict(docs(spark, [*ODD, (7, "the dog"), (8, "und der hund"), (9, "the dog " * 300_000), (10, "𝔲𝔫𝔡 \U0001f642")], extra=True), model)
    by = {r["text"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert [by[t] for t in (None, "", " \n\t ", "!!! 123 ...")] == [("und", 0.0)] * 4
    assert by["the dog"][0] == "en" and by["und der hund"][0] == "de" and by["the dog " * 300_000][0] == "en"
    assert all(0 <= s <= 1 for _, s in by.values()) and got.count() == len(ODD) + 4


def test_languages_are_learned_from_distinct_texts_however_many(spark):
    rows = [("the cat and the dog", "en")] * 5000 + [("der hund und die katze", "de")] * 5000
    rows += [(f"{words(12, 1000 + k)} {words(2, 5000 + 9 * k + j)}", f"l{k:02d}") for k in range(70) for j in range(4)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", max_rows=100)
    assert len(model[0]) == 72 and model[1].shape[1] >= 72
    asked = [(0, "the dog and the cat"), (1, "die katze und der hund"), *((10 + k, words(12, 1000 + k)) for k in range(70))]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(spark, asked), model).collect()}
    assert got == {0: "en", 1: "de"} | {10 + k: f"l{k:02d}" for k in range(70)}


def plain_kernel(a: str, b: str) -> float:
    """Presence of the runs of one to four letters, over the geometric mean."""
    of = lambda t: {t[k : k + n] for n in range(1, 5) for k in range(len(t) - n + 1)}
    clean = lambda t: re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in t))
    x, y = of(clean(a)), of(clean(b))
    return len(x & y) / math.sqrt(len(x) * len(y))


def test_language_kernel_and_regression_against_plain_ones():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(pool) for _ in range(12)) for pool in (["alpha", "beta", "gamma", "delta"], ["uno", "dos", "tres", "quatro"]) for _ in range(20)]
    y = np.array(["a"] * 20 + ["b"] * 20)
    letters, bits = langid._letters(), []
    for t in texts:
        row = np.zeros(langid.N_FEATURES, np.uint8)
        langid.presence(t, letters, row)
        bits.append(np.packbits(row).tobytes())
    classes, marks, weights, bias = langid.fit(bits, y, n_landmarks=40)
    kernel = np.array([[plain_kernel(a, b) for b in texts] for a in texts])
    x = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in bits]).astype(float)
    turn = np.argsort(np.concatenate([np.arange(20), np.arange(20)]), kind="stable")
    made = x @ marks / np.sqrt(x.sum(1, keepdims=True))
    assert np.abs(made - kernel[:, turn]).max() < 0.02
    # With every row a landmark this is kernel ridge regression on centred features.
    values, vectors = np.linalg.eigh(kernel)
    z = vectors[:, values > 1e-6] * np.sqrt(values[values > 1e-6])
    zc = z - z.mean(0)
    target = np.where(y[:, None] == np.array(classes), 1.0, -1.0)
    w = np.linalg.solve(zc.T @ zc / 20 + langid.RIDGE * np.eye(z.shape[1]), zc.T @ (target - target.mean(0)) / 20)
    plain = zc @ w + target.mean(0)
    assert np.abs(made @ weights + bias - plain).max() < 0.1 and ((made @ weights + bias).argmax(1) == plain.argmax(1)).all()


def test_language_without_labels_or_rows(spark):
    assert langid.train(spark.createDataFrame([], "text string, lang string"), "text", "lang") is None
    assert {r["lang_pred"] for r in langid.predict(docs(spark, ODD), None).collect()} == {"und"}


def test_long_texts_have_the_features_of_their_pieces():
    letters = langid._letters()
    text = words(400_000, 3)
    assert len(text) > langid._PIECE
    whole, parts = np.zeros(langid.N_FEATURES, np.uint8), np.zeros(langid.N_FEATURES, np.uint8)
    langid.presence(text, letters, whole)
    for a in range(0, len(text), 1000):
        langid.presence(text[a : a + 1004], letters, parts)
    assert not (parts > whole).any()


def test_language_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0]
    assert right > 0.95


# LM scoring


def brute_lm(rows: list[tuple], order: int, alpha: float) -> list[tuple]:
    split = [(t or "").lower().split() for _, t in rows]
    own = [[Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for n in range(order + 1)] for w in split]
    every = [sum((o[n] for o in own), Counter()) for n in range(order + 1)]
    total = sum(map(len, split))
    out = []
    for (i, _), w, o in zip(rows, split, own, strict=True):
        score, back = 0.0, 0
        count = lambda g: every[len(g)][g] - o[len(g)][g]  # noqa: B023, E731
        for k in range(len(w)):
            most = min(order, k + 1)
            for n in range(most, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1:
                    score += math.log(max(count(g), 1) / max(total - len(w), 1))
                    break
                if count(g) > 0 and count(g[:-1]) > 0:
                    score += math.log(count(g) / count(g[:-1]))
                    break
                score += math.log(alpha)
            back += n < most
        out.append((no(i), len(w), back, round(score / len(w), 6) if w else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, order):
    r = random.Random(order)
    rows = [*ODD, *sample(40), *((1000 + i, " ".join(r.choice("abcd") for _ in range(r.randint(1, 60)))) for i in range(40)), (5000, words(30_000, 2))]
    got = lm.score(docs(spark, rows, extra=True).repartition(4), order=order)
    made = sorted(((no(x["doc_id"]), x["n_words"], x["n_backoff"], None if x["lm_score"] is None else round(x["lm_score"], 6)) for x in got.collect()), key=str)
    expected = brute_lm(rows, order, 0.4)
    assert [m[:3] for m in made] == [e[:3] for e in expected]
    assert all(a[3] == b[3] or abs(a[3] - b[3]) < 2e-6 for a, b in zip(made, expected, strict=True))


def test_lm_of_no_rows_and_query(spark):
    assert lm.score(docs(spark, ODD).filter("doc_id = -1")).count() == 0
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((x[0], x[1], x[2], x[3]) for x in queries.op2_lm_score(spark, SF).collect()), key=str)
    expected = brute_lm(rows, 3, 0.4)
    assert [g[:3] for g in got] == [e[:3] for e in expected] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, expected, strict=True))


# Quality


def test_quality_of_odd_texts(spark):
    assert quality.train(spark.createDataFrame([], "text string, y int"), "text", "y") is None
    assert {r["score"] for r in quality.score(docs(spark, ODD), None).collect()} == {0.5}
    rows = [(words(40, i), 1) for i in range(30)] + [("bad bad " * 30 + str(i), 0) for i in range(30)] + [(None, 1), ("x", 7), ("", 0)]
    model = quality.train(spark.createDataFrame(rows, "text string, y int"), "text", "y")
    got = {r["text"]: r["score"] for r in quality.score(docs(spark, [*ODD, (1, words(60, 99)), (2, "bad bad " * 50), (3, "bad " * 400_000)], extra=True), model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert got[words(60, 99)] > 0.5 > got["bad bad " * 50] and got["bad " * 400_000] < 0.5


def test_quality_of_one_text_repeated(spark):
    rows = [("only this text", 1)] * 20_000 + [(words(30, i), 0) for i in range(5)]
    model = quality.train(spark.createDataFrame(rows, "text string, y int"), "text", "y", max_rows=10)
    assert model is not None
    got = {r["text"]: r["score"] for r in quality.score(docs(spark, [(1, "only this text"), (2, words(30, 1))]), model).collect()}
    assert got["only this text"] > got[words(30, 1)]


def test_quality_gradient_against_differences(monkeypatch):
    """One batch, one epoch: the step that training takes is the loss's gradient."""
    r = np.random.default_rng(2)
    rows = [(np.sort(r.choice(50, 6, replace=False)).astype(np.uint16), r.integers(1, 4, 6).astype(np.float32)) for _ in range(4)]
    y = np.array([0, 1, 1, 0])
    monkeypatch.setattr(quality, "EPOCHS", 0)
    e, w, bias = quality.fit(rows, y)
    monkeypatch.setattr(quality, "EPOCHS", 1)
    _, w1, bias1 = quality.fit(rows, y)

    def loss(w, bias):
        out = 0.0
        for (ids, n), k in zip(rows, y, strict=True):
            z = (n / n.sum()) @ e[ids].astype(float) @ w + bias
            out += math.log(np.exp(z).sum()) - z[k]
        return out

    for step, at, rate in ((w1 - w, w, 0.05), (bias1 - bias, bias, 0.005)):
        for k in np.ndindex(at.shape):
            up, down = at.astype(float), at.astype(float)
            up[k] += 1e-4
            down[k] -= 1e-4
            slope = (loss(up, bias) - loss(down, bias) if at is w else loss(w, up) - loss(w, down)) / 2e-4
            assert abs(step[k] + rate * quality.RATE * slope) < 2e-4


def test_quality_query_against_plain_scores(spark):
    got = {r["doc_id"]: r for r in queries.op4_quality(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", queries.held_out("doc_id", 5, 0).alias("held_out"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    e, w, bias = quality.train(texts.filter("NOT held_out").join(labels, "doc_id"), "text", "quality")
    for i, t, held in texts.collect():
        ids, n = quality.counted(t, quality.WordHashes())
        z = (n / max(1, n.sum())) @ e[ids].astype(float) @ w + bias if len(ids) else bias
        p = float(np.exp(z)[1] / np.exp(z).sum())
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) == held
        assert abs(got[i]["score"] - p) < 1e-4 and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    got = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("quality", "predicted").collect()
    assert sum(r[0] == r[1] for r in got) / len(got) > 0.95


# Decontamination


def brute_hits(rows: list[tuple], items: list[tuple], n: int = 8) -> list[tuple]:
    grams: dict[tuple, set] = {}
    for i, t in items:
        w = WORD.findall(lowered(t))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).update([] if i is None else [str(i)])
    lengths = {len(g) for g in grams}
    out = []
    for i, t in rows:
        w, hit, found = WORD.findall(lowered(t)), set(), set()
        for k in range(len(w)):
            for m in lengths:
                if k + m <= len(w) and (g := tuple(w[k : k + m])) in grams:
                    hit |= set(range(k + 1, k + m + 1))
                    found |= grams[g]
        out.append((no(i), len(w), sorted(hit), sorted(found)))
    return sorted(out, key=str)


ITEMS = [(1, "One two, three FOUR five six seven eight nine ten"), (2, "short item"), (3, "Two three four five six seven eight nine"), (4, ""), (5, None), (None, "null id words"), (6, "Éé ÀÀ")]


@pytest.mark.parametrize("max_set", [100_000, 2])
def test_decontamination(spark, max_set):
    rows = [*ODD, (1, "x one TWO three four! five six seven eight nine"), (2, "a Short\nitem, short item"), (3, "null id words; Éé ÀÀ éÉ"), (4, "éé àà"), (5, "three four five six seven eight nine ten"), (6, words(20_000, 3) + " short item"), (7, "\x00a\x7fB{c~")]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.scan(docs(spark, rows, extra=True), items, max_set=max_set)
    made = sorted(((no(r["doc_id"]), r["n_words"], sorted(r["hits"]), list(r["items"])) for r in got.collect()), key=str)
    assert made == brute_hits(rows, ITEMS)


def test_an_item_text_that_many_items_share(spark):
    items = spark.createDataFrame([(i, "one two three four five six seven eight nine") for i in range(3000)], "item_id bigint, text string")
    rows = docs(spark, [(1, "zero one two three four five six seven eight nine ten"), (2, "none of it")])
    for most in (100_000, 1000):
        got = {r["doc_id"]: r for r in decontaminate.scan(rows, items, max_set=most).collect()}
        assert sorted(got[1]["hits"]) == list(range(2, 11)) and got[1]["items"] == sorted(str(i) for i in range(3000)) and not got[2]["items"]


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.scan(docs(spark, ODD), none).collect()
    assert len(got) == len(ODD) and all(not r["hits"] and not r["items"] for r in got)
    assert decontaminate.scan(docs(spark, ODD).filter("doc_id = -1"), none).count() == 0


def test_cutting_words(spark):
    rows = [("Hello, World! x-y z.", [2]), (" Hello, World! x-y z.", [1, 4]), ("a", [1]), ("a b c.", [1, 2, 3]), ("...", []), ("", [])]
    df = spark.createDataFrame(rows, "t string, h array<int>")
    assert [r[0] for r in df.select(decontaminate.cut(F.col("t"), F.col("h"))).collect()] == ["Hello! x-y z.", ", World! x z.", "", ".", "...", ""]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    rel = c.sql(queries.SQL[name]).select(", ".join(got.columns))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rel.fetchall(), key=str)


# Chat


def brute_path(rows: list[dict], log: dict) -> list[int]:
    tables = chat._tables(rows, log)
    score, back = tables[0][chat.START], []
    for t in tables[1:]:
        reach = score[:, None] + t[: chat.START]
        back.append(reach.argmax(0))
        score = reach.max(0)
    states = [int(score.argmax())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def test_chat_paths_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 4)
    r = random.Random(1)
    rows = [(c, t, r.choice(["User: hi?", "no marker " * r.randint(1, 30), "### Assistant\nok", "system: be good", None, ""])) for c, n in ((1, 150), (2, 3), (None, 20), (3, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    log = chat.parameters()
    got = chat.format_chat(df).collect()
    assert len(got) == len(rows)
    seen = chat.observed(df, "text").collect()
    for c in {x[0] for x in rows}:
        mine = sorted((x.asDict() for x in seen if x["conv_id"] == c), key=lambda x: x["turn"])
        found = [chat.ROLES.index(x["role_pred"]) for x in sorted((x for x in got if x["conv_id"] == c), key=lambda x: x["turn"])]
        best = brute_path(mine, log)
        tables = chat._tables(mine, log)

        def worth(states: list[int], tables: list = tables) -> float:
            return sum(t[a, b] for t, a, b in zip(tables, [chat.START, *states], states))  # noqa: B905

        assert worth(found) == pytest.approx(worth(best))


def test_chat_of_lines_without_positions_or_ids(spark, monkeypatch):
    sizes: list[int] = []
    monkeypatch.setattr(chat, "CHUNK", 16)
    lines = [(None, None, f"line {i % 7}?") for i in range(3000)] + [(1, 5, "User: the same")] * 500 + [(2, 0, "hello")]
    df = spark.createDataFrame(lines, "conv_id bigint, turn bigint, text string")
    got = chat.format_chat(df).collect()
    assert len(got) == len(lines) and sum(r["conv_id"] == 1 and r["role_pred"] == "user" for r in got) == 500
    model = chat.train(df.withColumn("role", chat.F.lit("user")), "conv_id", "turn", "text", "role")
    plain = chat.parameters({"move": np.array([[0, 0, 0], [0, 3498, 0], [0, 0, 0], [0, 3, 0]])})
    assert np.allclose(model["move"], plain["move"]) and not sizes


def test_chat_counts_against_plain_ones(spark):
    r = random.Random(3)
    lines = [(c, t, "x" * r.randint(0, 50) + "\n?" * r.randint(0, 2), r.choice(["system", "user", "assistant", "other", None])) for c in range(20) for t in r.sample(range(100), 12)]
    model = chat.train(spark.createDataFrame(lines, "c bigint, p bigint, t string, r string"), "c", "p", "t", "r")
    moves, asks = np.zeros((4, 3)), np.zeros((3, 2))
    for c in range(20):
        before = chat.START
        for _, _, t, role in sorted(x for x in lines if x[0] == c and x[3] in chat.ROLES):
            now = chat.ROLES.index(role)
            moves[before, now] += 1
            asks[now, int("?" in t)] += 1
            before = now
    plain = chat.parameters({"move": moves, "q": asks})
    assert np.allclose(model["move"], plain["move"]) and np.allclose(model["q"], plain["q"])


def test_chat_query_against_plain_paths(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    model = chat.train(table.filter(~queries.held_out("conv_id", 5, 0)), "conv_id", "turn", "text", "role")
    got = {(r["conv_id"], r["turn"]): r for r in queries.op6_chat_format(spark, SF).collect()}
    by: dict = {}
    for x in chat.observed(table.select("conv_id", "turn", "text"), "text").collect():
        by.setdefault(x["conv_id"], []).append(x.asDict())
    for c, mine in by.items():
        mine.sort(key=lambda x: x["turn"])
        if len({x["turn"] for x in mine}) < len(mine) or len(mine) > 7:
            continue  # ties, and more than can be tried
        emitted = [model["m"][:, x["_m"]] + model["s"][:, x["_s"]] + model["n"][:, x["_n"]] + model["q"][:, x["_q"]] for x in mine]
        worth = lambda p: sum(model["move"][a, b] + e[b] for a, b, e in zip((chat.START, *p[:-1]), p, emitted, strict=True))  # noqa: B023, E731
        best = max(worth(p) for p in itertools.product(range(3), repeat=len(mine)))
        found = tuple(chat.ROLES.index(got[(c, x["turn"])]["role_pred"]) for x in mine)
        assert worth(found) == pytest.approx(best)


def test_chat_rendering(spark):
    rows = [(1, 0, "System: be kind"), (1, 1, "User: hello?"), (1, 2, "and more"), (1, 3, "<|assistant|>\nhi"), (2, None, None)]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id int, turn int, text string")).orderBy("conv_id", "turn").collect()
    assert [r["role_pred"] for r in got[:2]] == ["system", "user"] and got[3]["role_pred"] == "assistant"
    assert got[0]["rendered"] == "<|system|>\nbe kind\n" and got[3]["rendered"] == "<|assistant|>\nhi\n"
    assert chat.format_chat(spark.createDataFrame([], "conv_id int, turn int, text string")).count() == 0


def test_chat_held_out_roles(spark):
    sf = SF.replace("0.001", "0.1")
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role").filter(queries.held_out("conv_id", 5, 0))
    got = queries.op6_chat_format(spark, sf).join(rows, ["conv_id", "turn"])
    assert got.agg(F.avg((F.col("role") == F.col("role_pred")).cast("int"))).head()[0] > 0.95


# TIFF


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("side", [0, 16])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(how, side, predictor):
    r = random.Random(how + side + predictor)
    data = bytes(r.randrange(4 if k % 3 else 256) for k in range(48 * 77))
    found = list(tiff.read(tiff.write(data, 48, lambda _p: (how, predictor, side, 16), 30)))
    assert [p["error"] for p in found] == [None] * 3 and b"".join(p["data"] for p in found) == data
    assert [p["height"] for p in found] == [30, 30, 17]


def test_lzw_and_packbits_over_many_lengths():
    r = random.Random(0)
    for n in (0, 1, 2, 3, 127, 128, 129, 255, 3000, 12_288, 40_000):
        for letters in (1, 2, 7, 256):
            d = bytes(r.randrange(letters) for _ in range(n))
            assert tiff.lzw_decode(tiff.lzw_encode(d), n) == d
            assert tiff.unpack_bits(tiff.pack_bits(d), n) == d


def plain_lzw(data: bytes) -> list[tuple[int, int]]:
    """(code, width) of a stream, a bit string read by the rules one code at a time."""
    bits = "".join(f"{b:08b}" for b in data)
    at, size, width, last, out = 0, 258, 9, False, []
    while True:
        code = int(bits[at : at + width], 2)
        out.append((code, width))
        at += width
        if code == 257:
            return out
        if code == 256:
            size, last = 258, False
        else:
            size, last = size + last, True
        width = 9 + (size >= 511) + (size >= 1023) + (size >= 2047)


def test_lzw_reaches_all_widths_and_resets():
    r = random.Random(2)
    data = bytes(r.randrange(256) for _ in range(12_288))
    codes = plain_lzw(tiff.lzw_encode(data))
    assert {w for _, w in codes} == {9, 10, 11, 12} and sum(c == 256 for c, _ in codes) > 2 and codes[0] == (256, 9)


def test_stored_pages_take_all_forms():
    text = words(40_000, 6)
    payload, _ = tiff.payload_of(text)
    found = list(tiff.read(tiff.write(payload, 192, tiff.store_plan(3), 64)))
    assert b"".join(p["data"] for p in found) == payload
    full = {(p["compression"], p["predictor"], p["tiled"]) for p in found if p["height"] == 64}
    assert full == {(8, 1, True), (5, 1, False), (32773, 1, False), (8, 2, False), (5, 2, False), (32773, 1, True)}


def small_tiff(tags: list[tuple[int, list[int]]], raw: bytes) -> bytes:
    out = b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw + struct.pack("<H", len(tags))
    extra = 8 + len(raw) + 2 + 12 * len(tags) + 4
    more = b""
    for t, values in tags:
        body = struct.pack(f"<{len(values)}I", *values)
        out += struct.pack("<HHI", t, 4, len(values)) + (body.ljust(4, b"\0") if len(values) < 2 else struct.pack("<I", extra + len(more)))
        more += body if len(values) > 1 else b""
    return out + b"\0\0\0\0" + more


def test_bits_and_planes():
    r = np.random.default_rng(1)
    bits = r.integers(0, 2, (5, 13)).astype(np.uint8)
    rows = [np.packbits(x).tobytes() for x in bits]
    raw = b"".join(tiff.pack_bits(x) for x in rows)
    (page,) = tiff.read(small_tiff([(256, [13]), (257, [5]), (258, [1]), (259, [tiff.PACKBITS]), (273, [8]), (277, [1]), (278, [5]), (279, [len(raw)])], raw))
    assert page["error"] is None and page["data"] == bits.tobytes()
    grid = r.integers(0, 256, (4, 3, 2)).astype(np.uint8)
    raw = grid[:, :, 0].tobytes() + grid[:, :, 1].tobytes()
    (page,) = tiff.read(small_tiff([(256, [3]), (257, [4]), (258, [8]), (259, [1]), (273, [8, 14, 20, 26]), (277, [2]), (278, [2]), (279, [6, 6, 6, 6]), (284, [2])], raw))
    assert page["error"] is None and page["data"] == grid.tobytes()


def test_malformed_entries_give_an_error_row():
    raw = bytes(12)
    good = [(256, [3]), (257, [4]), (258, [8]), (259, [1]), (273, [8]), (277, [1]), (278, [4]), (279, [12])]
    assert [p["error"] for p in tiff.read(small_tiff(good, raw))] == [None]
    for k, (tag, _) in enumerate(good):
        for values in ([], [0], [1 << 31], [7, 7]):
            (page,) = tiff.read(small_tiff([*good[:k], (tag, values), *good[k + 1 :]], raw))
            assert page["page"] == 0 and (page["error"] is None) == (page["data"] is not None)
    for odd in ((317, [3]), (324, []), (284, [9]), (324, [8])):
        (page,) = tiff.read(small_tiff(sorted([*good, odd]), raw))
        assert page["error"] and page["data"] is None


def test_big_endian_words_and_colours():
    samples = (np.arange(2 * 3 * 3).reshape(2, 9) * 700).astype(">u2")
    raw = samples.tobytes()
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 3), (278, 3, 2), (279, 4, len(raw))]
    out = b"MM\0*" + struct.pack(">I", 8 + len(raw)) + raw + struct.pack(">H", len(tags))
    for t, kind, v in tags:
        out += struct.pack(">HHI", t, kind, 1) + (struct.pack(">HH", v, 0) if kind == 3 else struct.pack(">I", v))
    (page,) = tiff.read(out + b"\0\0\0\0")
    assert page["error"] is None and page["samples"] == 3 and page["data"] == samples.astype("<u2").tobytes()


def test_broken_media_get_errors(spark):
    good = tiff.write(b"a" * 192 * 3, 192, tiff.store_plan(2), 64)
    loop = bytearray(good)
    loop[-4:] = good[4:8]
    huge = small_tiff([(256, [1 << 31]), (257, [4]), (273, [])], bytes(8))
    rows = [(8, huge), (1, None), (2, b""), (3, b"not a tiff file"), (4, good), (4, good), (5, bytes(loop)), (6, good[: len(good) // 2]), (7, good.replace(struct.pack("<HHII", 259, 4, 1, tiff.PACKBITS), struct.pack("<HHII", 259, 4, 1, 99)))]
    got = tiff.pages(spark.createDataFrame(rows, "id int, media binary")).orderBy("id", "page").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["error"] is None, r["data"] is not None))
    assert by[1] == by[2] == by[3] == [(False, False)]
    assert by[4] == [(True, True)] * 2 and by[5] == [(True, True), (False, False)]
    assert by[6] == [(False, False)] and by[7] == [(False, False)] and by[8] == [(False, False)]
    assert tiff.pages(spark.createDataFrame([], "id int, media binary")).count() == 0


def test_tiff_query(spark):
    got = {r["doc_id"]: r for r in queries.op9_tiff(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for i, t in texts:
        data = (t or "").encode()
        full = data + b" " * (-len(data) % 192 or 192 * (not data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        media = tiff.write(full, 192, tiff.store_plan(zlib.crc32(full)), 64)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        n = Counter(full)
        mean, entropy = sum(b * c for b, c in n.items()) / len(full), -sum(c / len(full) * math.log2(c / len(full)) for c in n.values())
        found = dict(x.split("=") for x in r["feature"].split(";"))
        assert int(found["pages"]) == -(-len(full) // (192 * 64)) and abs(float(found["mean"]) - mean) < 1e-3 and abs(float(found["entropy"]) - entropy) < 1e-3


def test_stored_odd_texts(spark):
    got = tiff.pages(tiff.store(docs(spark, [*ODD, (1, words(40_000))]))).collect()
    assert all(r["error"] is None for r in got)
    assert sum(r["page"] == 0 for r in got) == len(ODD) + 1


# Shards


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4096, 99991])
def test_permutations(n):
    got = shard.permute(np.arange(n), n, 7)
    assert sorted(got.tolist()) == list(range(n))
    if n >= 1000:
        assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.1
        assert (shard.permute(np.arange(n), n, 8) != got).mean() > 0.9


def test_shards(spark):
    rows = docs(spark, [*ODD, *sample(150), *[(77, "same")] * 40]).selectExpr("doc_id", "text", "1 AS slot", "2 AS part", "3 AS at")
    got = shard.assign(rows.repartition(5), 7, 3).collect()
    again = shard.assign(rows.coalesce(1), 7, 3).collect()
    key = lambda r: (no(r["doc_id"]), r["text"] or "", r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    n = len(got)
    by: dict[int, list[int]] = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        to = int(shard.permute(np.array([r["row_number"]]), n, 3)[0])
        assert (r["shard"], r["slot"]) == (to % 7, to // 7)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert shard.assign(rows.filter("doc_id = -1"), 7).count() == 0


def test_shard_query(spark):
    got = queries.op10_feistel_shards(spark, SF).collect()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(texts) and {r["law"] for r in got} == {"rows"}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
    # Rows are numbered by id, and the permuted number gives shard and slot.
    to = shard.permute(np.arange(len(got)), len(got), queries.SHARD_KEY).tolist()
    for r, x in zip(sorted(got, key=lambda r: r["doc_id"]), to, strict=True):
        assert (r["shard"], r["slot"], r["grown_shard"]) == (x % 24, x // 24, None)


# Blocks


def test_packed_numbers():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = np.sort(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = r.integers(0, 300, n).astype(np.uint64)
        got, rest = blocks.unpack(blocks.pack(x, y, np.zeros(n), ascending=1, rest=b"rest"), 1)
        assert [g.tolist() for g in got] == [x.tolist(), y.tolist(), [0] * n] and rest == b"rest"


def test_a_row_of_one_key_is_small():
    assert len(blocks.pack(np.array([1 << 60], np.uint64), np.array([3]), ascending=1)) < 40


def test_blocks_send_only_to_buckets_that_they_have_keys_for(spark):
    made = blocks.make_blocks(docs(spark, [(i, words(3, i)) for i in range(200)]).repartition(4), "text", 200)
    sent: list[int] = []
    df = blocks.exchange(made, lambda t: ((hash(w) % 1000, b"") for w in sorted({w.as_py() for w in t["text"]})), lambda k, ms: [str(k).encode()] * len(ms), lambda t, a: t.append_column("n", [[len(a)] * len(t)]), "doc_id bigint, text string, n bigint")
    sent = [(r["doc_id"], r["n"]) for r in df.collect()]
    assert sorted(i for i, _ in sent) == list(range(200)) and all(1 <= n <= 40 for _, n in sent)
