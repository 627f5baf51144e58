from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.functions import attributes as A
from ledgerlake.plans import evals, filters, setops
from ledgerlake.plans.tokens import LanguageError
from tests import reference


def attributes(spark, maps: list[dict]):
    """A frame with a column for each attribute of ``maps``, and a getter."""
    names = sorted({n for m in maps for n in m})
    part = lambda v: (v if isinstance(v, str) else None, v if isinstance(v, int) else None, v if isinstance(v, list) else None)
    rows = [(i, *(part(m.get(n)) for n in names)) for i, m in enumerate(maps)]
    df = spark.createDataFrame(rows, "row int" + "".join(f", `{n}` {A.TYPE}" for n in names))
    return df, lambda n: F.col(f"`{n}`") if n in names else None


def judged(spark, program: str, maps: list[dict], **values) -> list[bool]:
    df, get = attributes(spark, maps)
    tree = filters.parse(program, values)
    got = df.select("row", filters.condition(tree, get).alias("ok")).orderBy("row").collect()
    assert all(r["ok"] is not None for r in got)
    out = [r["ok"] for r in got]
    assert out == [reference.check(tree, m) for m in maps]
    return out


CASES = [
    ('($berth BETWEEN "N2" AND "N25") AND (($tons > 500) AND contains($ship, :part))', [{"berth": "N21", "tons": 501, "ship": "North Star"}, {"berth": "N21", "tons": 500, "ship": "North Star"}, {"berth": "N21", "tons": "900", "ship": "North Star"}, {"berth": 21, "tons": 900, "ship": "North Star"}], [True, False, False, False], {"part": "th St"}),
    ('($berth BETWEEN "N9" AND "N1") OR ($tons < 3 AND ends_with($ship, "a"))', [{"berth": "N5", "tons": 3, "ship": "Vega"}, {"berth": "N5", "tons": 2, "ship": "Vega"}], [False, True], {}),
    ('$due >= "0312" AND $due <= "0420" OR ($left > "0500" AND $left < "0700")', [{"due": "0401", "left": "0101"}, {"due": "0901", "left": "0612"}, {"due": "0901", "left": "0700"}, {}], [True, True, False, False], {}),
    ('$flag <> "red"', [{"flag": "red"}, {"flag": "Red"}, {}, {"flag": 7}], [False, True, False, False], {}),
    ('NOT begins_with($ship, "Q") AND NOT $flag IN ("red", "green")', [{"ship": "Vega", "flag": "blue"}, {"ship": "Queen", "flag": "blue"}, {"ship": "Vega", "flag": "green"}, {}], [True, False, False, True], {}),
    ('"oil" IN $cargo', [{"cargo": ["grain", "oil"]}, {"cargo": ["oils"]}, {"cargo": "oil"}, {}], [True, False, False, False], {}),
    ("attribute_empty($note)", [{"note": ""}, {"note": " "}, {}, {"note": 0}], [True, False, False, False], {}),
    ("attribute_exists($note) AND NOT attribute_not_exists($note)", [{"note": ""}, {"note": 0}, {"note": ["x"]}, {}], [True, True, True, False], {}),
    ("$depth BETWEEN $least AND $most", [{"depth": 12, "least": 9, "most": 30}, {"depth": 31, "least": 9, "most": 30}, {"depth": 12, "most": 30}, {"depth": 12, "least": "9", "most": 30}], [True, False, False, False], {}),
    ('begins_with($ship, "Ø") AND ends_with($ship, "und")', [{"ship": "Øresund"}, {"ship": "Stralsund"}], [True, False], {}),
    ("$crew = 0012 AND $temp > -8", [{"crew": 12, "temp": -7}, {"crew": 12, "temp": -8}], [True, False], {}),
    ('$pier = "p" OR $crane = "c" AND $shed = "s"', [{"pier": "p"}, {"crane": "c", "shed": "s"}, {"crane": "c"}], [True, True, False], {}),
    ('$flag < "c" OR $cargo = "oil"', [{"flag": "Zulu"}, {"flag": "ç"}, {"cargo": ["oil"]}], [True, False, False], {}),
    ("$tons >= :least", [{"tons": 40}, {"tons": 39}], [True, False], {"least": 40}),
]


@pytest.mark.parametrize(("program", "maps", "expected", "values"), CASES)
def test_filters(spark, program, maps, expected, values):
    assert judged(spark, program, maps, **values) == expected


@pytest.mark.parametrize("program", ["$a = ", '$a IN (1, 2)', '$a = ""', "a = 1", "$a = :missing", '$a BETWEEN 1 "x"', "NOT", '($a = "x"', '3 IN $a', '$a = "x" $b', "contains($a, 3)"])
def test_filter_errors(program):
    with pytest.raises(LanguageError):
        filters.parse(program)


def test_substitutions_must_be_text_or_whole_numbers():
    with pytest.raises(LanguageError):
        filters.parse("$a = :x", {"x": 1.5})
    with pytest.raises(LanguageError):
        evals.parse("add($a, :x, $b)", {"x": 3})
    assert evals.parse('delim($term, :d, ($a))', {"d": "|"})[0].args == ("|",)


def evaluated(spark, program: str, rows: list[tuple], wanted: set[str]) -> list[dict]:
    """Attributes of (term, key) rows; compared with the plain reading."""
    df = spark.createDataFrame([(i, t if isinstance(t, str) else None, t if isinstance(t, int) else None, k) for i, (t, k) in enumerate(rows)], "row int, term_s string, term_i bigint, key string")
    steps = evals.parse(program)
    df, have = evals.apply(steps, df, A.term(F.col("term_s"), F.col("term_i")), F.col("key"), wanted)
    out = []
    for r in df.orderBy("row").collect():
        got = {}
        for n in have:
            v = r[evals.PREFIX + n]
            x = v["s"] if v["s"] is not None else v["i"] if v["i"] is not None else v["l"]
            if x is not None:
                got[n] = x
        out.append(got)
    expected = [{n: v for n, v in reference.run(steps, t, k).items() if n in wanted} for t, k in rows]
    assert out == expected
    return out


def test_a_filter_stays_above_the_steps(spark):
    """Pushed below them it would hold the work of each step several times over."""
    size = {}
    for n in (2, 4):
        program = "to_integer($term, $a0)" + "".join(f" | add($a{i}, 1, $a{i + 1})" for i in range(n))
        df = spark.createDataFrame([("7", "k")], "term_s string, key string")
        df, _ = evals.apply(evals.parse(program), df, A.term(F.col("term_s"), F.lit(None)), F.col("key"), [f"a{n}"])
        kept = df.filter(F.col(f"`{evals.PREFIX}a{n}`.i") == 7 + n).select("key")
        assert kept.count() == 1
        size[n] = kept._jdf.queryExecution().optimizedPlan().toString().count("try_cast") + kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract")
    assert size[2] == size[4]


def test_parse_a_shelf_mark(spark):
    rows = [("Dune|04/1965||desert~worms|F7~F9", "copy-31")]
    got = evaluated(spark, 'delim($term, "|", ($title, $when, $lent, $topics, $shelves)) | index($when, 3, 4, $year) | to_integer($year, $year) | split($topics, "~", $about) | join(($title, $lent, $when), "+", $label)', rows, {"title", "lent", "year", "about", "label"})
    assert got == [{"title": "Dune", "year": 1965, "about": ["desert", "worms"], "label": "Dune++04/1965"}]


def test_residual_and_skipped_fields(spark):
    rows = [("a|b|", "k"), ("|b", "k"), ("a", "k"), ("", "k"), ("a|b|c|d|e", "k"), (7, "k")]
    got = evaluated(spark, 'delim($term, "|", ($x, $y, $z))', rows, {"x", "y", "z"})
    assert got[0] == {"x": "a", "y": "b", "z": ""}
    assert got[1] == {"y": "b"}
    assert got[5] == {}


def test_earlier_values_stay(spark):
    got = evaluated(spark, 'delim($term, "|", ($a, $b)) | delim($b, ";", ($a, $b)) | to_integer($a, $a)', [("1|x;", "k"), ("q|;z", "k"), ("5", "k")], {"a", "b"})
    assert got == [{"a": "x", "b": ""}, {"a": "q", "b": "z"}, {"a": 5}]


def test_slice_drops_the_rest_and_counts_letters(spark):
    got = evaluated(spark, 'delim($term, ";", ($word, $code)) | slice($code, 3, $triples) | index($word, 2, 2, $mid)', [("Größe;äöüßéèn", "k"), ("tide;abcd", "k")], {"triples", "mid"})
    assert got == [{"triples": ["äöü", "ßéè"], "mid": "öß"}, {"triples": ["abc"], "mid": "de"}]


def test_numbers(spark):
    got = evaluated(spark, 'delim($term, ",", ($station, $high, $low, $unit)) | to_integer($high, $high) | to_integer($low, $low) | to_integer($station, $station) | delim($key, "/", ($river, $gauge)) | subtract($high, $low, $range) | to_string($range, $shown)', [("weir,412mm,87mm,x9", "Elbe/0040")], {"station", "high", "low", "river", "gauge", "range", "shown"})
    assert got == [{"station": "weir", "high": 412, "low": 87, "river": "Elbe", "gauge": "0040", "range": 325, "shown": "325"}]


def test_pairs_and_absent_numbers(spark):
    program = 'delim($term, ";", ($day)) | kvsplit($term, ";", ":") | to_integer($apples, $apples) | to_integer($pears, $pears) | to_integer($plums, $plums) | add($all, $apples, $all) | add($all, $pears, $all) | add($all, $plums, $all)'
    rows = [("tuesday;apples:31;pears:4;plums:65", "stall 3"), ("2;apples:8;apples:9;pears:x:y", "k")]
    assert evaluated(spark, program, rows, {"all", "day"}) == [{"day": "tuesday", "all": 100}, {"day": "2", "all": 9}]


def test_map_orders_unlike_types(spark):
    rows = [("level=20", "k"), ("level=85", "k"), ("x", "k"), (5, "k")]
    program = 'delim($term, "=", ($what, $n)) | map($n, =, (("10", "ebb"), ("20", "slack")), "flood", $tag) | map($none, <, (("m", 1)), 0, $m) | map($none, >, ((3, 1)), 0, $g) | map($term, <, ((6, "low")), "high", $t) | to_integer($n, $i) | map($i, >=, (("a", 1), (50, 2)), 3, $b)'
    got = evaluated(spark, program, rows, {"tag", "m", "g", "t", "b"})
    assert got[0] == {"tag": "slack", "m": 1, "g": 1, "t": "high", "b": 3}
    assert got[1]["b"] == 2 and got[1]["tag"] == "flood"
    assert got[3]["t"] == "low"


def test_regex_binds_all_or_nothing(spark):
    program = 'regex($term, "(?P<y>[0-9]{4})-([a-z]+)", pcre, ($a, $b)) | regex($term, "^([a-z])", ($a, $b)) | regex($key, "k(.)", ($c))'
    got = evaluated(spark, program, [("xx2020-abc", "k7"), ("none", "q")], {"a", "b", "c"})
    assert got == [{"a": "2020", "b": "abc", "c": "7"}, {}]


def test_reserved_inputs_do_not_reach_filters(spark):
    got = evaluated(spark, 'index($term, 0, 1, $term) | index($term, 0, 2, $two) | join(($key, $two), "-", $j)', [("abc", "k")], {"term", "two", "j"})
    assert got == [{"term": "a", "two": "ab", "j": "-ab"}]


@pytest.mark.parametrize("program", ['delim($term, "", ($a))', "index($term, 007, 1, $a)", 'join($a, "-", $b)', "slice($term, 0, $a)", "split($term)", 'regex($term, "(?P=a)", ($a))', "add($a, $b)", '', 'delim($term, "|", ($a)) |'])
def test_eval_errors(program):
    with pytest.raises(LanguageError):
        evals.parse(program)


SETS = {k: {f"n{n}" for n in range(24) if n % step == rest} for k, (step, rest) in {1: (2, 0), 2: (3, 0), 3: (4, 1), 4: (5, 2), 5: (3, 1)}.items()}


def expected_set(tree) -> set:
    if isinstance(tree, int):
        return SETS.get(tree, set())
    a, b = map(expected_set, tree[1:])
    return {"UNION": a | b, "INTERSECT": a & b, "SUBTRACT": a - b}[tree[0]]


@pytest.mark.parametrize("program", ["$4 UNION ($1 INTERSECT $5)", "$2 SUBTRACT $1 SUBTRACT $4", "$8 UNION ($5 SUBTRACT $3)", "$5 UNION $1 INTERSECT $2 SUBTRACT $4", "$8", "($1 UNION $3) INTERSECT ($2 SUBTRACT ($4 UNION $5))"])
def test_setops(spark, program):
    frames = {k: spark.createDataFrame([(x,) for x in v] * 2, "key string") for k, v in SETS.items()}
    got = [r["key"] for r in setops.combine(setops.parse(program), frames).collect()]
    assert sorted(got) == sorted(expected_set(setops.parse(program)))


def test_subtract_binds_first_and_rightwards():
    assert setops.parse("$4 SUBTRACT $1 SUBTRACT $2") == ("SUBTRACT", 4, ("SUBTRACT", 1, 2))
    assert setops.parse("$3 UNION $5 INTERSECT $1") == ("UNION", 3, ("INTERSECT", 5, 1))
    with pytest.raises(LanguageError):
        setops.parse("$01")
    with pytest.raises(LanguageError):
        setops.parse("$1 UNION")


value = st.one_of(st.sampled_from(['"a"', '"b"', '"10"']), st.integers(-3, 12).map(str), st.sampled_from(["$a", "$b", "$c", "$z"]))
leafs = st.one_of(
    st.tuples(value, st.sampled_from(["=", "<", ">", "<=", ">=", "<>"]), value).map(" ".join),
    st.tuples(value, value, value).map(lambda v: f"{v[0]} BETWEEN {v[1]} AND {v[2]}"),
    st.sampled_from(['$a IN ("a", "b")', '"b" IN $c', 'contains($b, "a")', "attribute_exists($z)", "attribute_not_exists($c)", "attribute_empty($a)", 'begins_with($a, "b")']),
)
programs = st.recursive(leafs, lambda x: st.one_of(x.map(lambda p: f"NOT ({p})"), st.tuples(x, st.sampled_from(["AND", "OR"]), x).map(" ".join)), max_leaves=5)
MAPS = [{}, {"a": "a", "b": "ab", "c": ["a", "b"]}, {"a": 3, "b": 10}, {"a": "", "b": "10", "c": 7}, {"a": "b", "b": 3, "c": "c"}]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(programs, min_size=8, max_size=8))
def test_random_filters(spark, many):
    df, get = attributes(spark, MAPS)
    trees = [filters.parse(p) for p in many]
    got = df.select("row", *[filters.condition(t, get).alias(f"p{i}") for i, t in enumerate(trees)]).orderBy("row").collect()
    for r, m in zip(got, MAPS, strict=True):
        assert [r[f"p{i}"] for i in range(len(trees))] == [reference.check(t, m) for t in trees]


names = st.sampled_from(["$a", "$b", "$c"])
inputs = st.sampled_from(["$a", "$b", "$c", "$term", "$key"])
steps = st.one_of(
    st.tuples(inputs, st.sampled_from(["|", ":", "ab"]), names, names).filter(lambda t: t[2] != t[3]).map(lambda t: f'delim({t[0]}, "{t[1]}", ({t[2]}, {t[3]}))'),
    st.tuples(names, names, names).map(lambda t: f'join(({t[0]}, {t[1]}), "+", {t[2]})'),
    st.tuples(inputs, names).map(lambda t: f'split({t[0]}, "|", {t[1]})'),
    st.tuples(inputs, st.integers(1, 3), names).map(lambda t: f"slice({t[0]}, {t[1]}, {t[2]})"),
    st.tuples(inputs, st.integers(0, 3), st.integers(1, 3), names).map(lambda t: f"index({t[0]}, {t[1]}, {t[2]}, {t[3]})"),
    st.tuples(inputs, names).map(lambda t: f"to_integer({t[0]}, {t[1]})"),
    st.tuples(inputs, names).map(lambda t: f"to_string({t[0]}, {t[1]})"),
    st.tuples(names, st.integers(-5, 5), names).map(lambda t: f"add({t[0]}, {t[1]}, {t[2]})"),
    st.tuples(names, names, names).map(lambda t: f"subtract({t[0]}, {t[1]}, {t[2]})"),
    st.tuples(inputs, st.sampled_from(["=", "<", ">", "<=", ">="]), names).map(lambda t: f'map({t[0]}, {t[1]}, (("m", 1), (5, "five")), "d", {t[2]})'),
    st.tuples(inputs).map(lambda t: f'kvsplit({t[0]}, "|", ":")'),
)
TERMS = [("x|a:1|b:22|c", "k:1"), ("12ab|", "7|8"), ("", "c:3|c:4"), (42, "zzz"), ("|||a:b:c", "a")]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(steps, min_size=1, max_size=5))
def test_random_pipelines(spark, many):
    evaluated(spark, " | ".join(many), TERMS, {"a", "b", "c"})
