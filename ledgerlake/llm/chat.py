"""Chat formatting: roles by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines (or paragraphs) without reliable roles. Hidden states
are the roles; a line is observed as its speaker marker ("User:", "### Assistant", ...),
the magnitude of its length, its number of lines and whether it asks. Probabilities are
counts over labelled lines on top of fixed pseudo-counts, so that without labels the
markers and the alternation of turns alone decide. Viterbi's best path gives the roles.

Transcripts can be of any length. All lines are numbered in order of transcript and
position, and cut into chunks of ``CHUNK`` numbers, so no chunk has more lines whatever
the positions are; a transcript's part of a chunk becomes the table of its best path scores
from each role before it to each role at its end; tables of ``CHUNK`` neighbours combine to
one until a transcript has one; on the way back every chunk learns the roles at its two ends
and finds its own path. The result is the best path over the whole transcript, and no task
holds more than a chunk.

Lines come in order of position; ties are ordered by a hash of the text, null positions
come last; a null id is a transcript of its own. Null texts are empty lines. Repeated rows
are repeated lines. Of equally good paths the one with the earlier roles in ``ROLES`` wins.
No row is dropped, no rows give no rows. Only the columns named are looked at and returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.store import numbered, write_table

ROLES = ("system", "user", "assistant")
START = len(ROLES)
CHUNK = 256
MARKERS = {
    "system": "system|instructions?|context",
    "user": "user|human|customer|question|q|prompter|me",
    "assistant": "assistant|ai|bot|agent|answer|a|model|gpt",
}
#: A marker opens a line: a name with a colon, or a decorated name ("### User", "<|user|>").
MARKER = r"^\s*(?:[#*<|\[]+\s*(?i:%s)(?:[*|>\]]+\s*:?|\s*:|[ \t]*(?:\n|$))|(?i:%s)\s*:)\s*"
SIZES, LINES = 20, 9


def marker_of(text: Column) -> Column:
    """0 for no marker, else 1 + the number of the role."""
    out = F.lit(0)
    for k, role in reversed(list(enumerate(ROLES))):
        out = F.when(text.rlike(MARKER % (MARKERS[role], MARKERS[role])), k + 1).otherwise(out)
    return out


def observed(lines: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = F.least(F.floor(F.log2(F.char_length(t) + 1)), F.lit(SIZES - 1)).cast("int")
    n_lines = F.least(F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))), F.lit(LINES - 1)).cast("int")
    return lines.select("*", marker_of(t).alias("_m"), size.alias("_s"), n_lines.alias("_n"), F.contains(t, F.lit("?")).cast("int").alias("_q"))


def parameters(counts: dict | None = None) -> dict[str, np.ndarray]:
    """Log probabilities from counts by feature, over the fixed pseudo-counts."""
    k = len(ROLES)
    marks = np.full((k, k + 1), 1.0)
    marks[:, 0] = 300
    marks[np.arange(k), np.arange(k) + 1] = 300
    # Fixed pseudo-counts of moves: a system line opens, user and assistant take turns.
    moves = np.array([[2.0, 17, 1], [0.2, 4, 16], [0.2, 16, 4], [6, 13, 1]])
    base = {"m": marks, "s": np.full((k, SIZES), 0.5), "n": np.full((k, LINES), 0.5), "q": np.full((k, 2), 0.5), "move": moves}
    for name, extra in (counts or {}).items():
        base[name] = base[name] + extra
    return {n: np.log(x / x.sum(1, keepdims=True)) for n, x in base.items()}


def key_of(conv: str) -> Column:
    """A text that names a transcript, also one without an id."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{conv}`").cast("string")), F.lit(""))


def in_order() -> list[Column]:
    return [F.col("key"), F.col("pos").asc_nulls_last(), F.col("h")]


def train(lines: DataFrame, conv: str, position: str, text: str, role: str) -> dict[str, np.ndarray]:
    """Count features and moves over all labelled lines; what comes back is as large as
    the feature space."""
    at = F.array_position(F.array(*map(F.lit, ROLES)), F.col(f"`{role}`")) - 1
    given = lines.select(key_of(conv).alias("key"), F.col(f"`{position}`").alias("pos"), F.col(f"`{text}`").alias("t"), at.alias("r")).filter("r >= 0")
    seen = observed(given, "t").select("key", "pos", F.xxhash64("t").alias("h"), "r", "_m", "_s", "_n", "_q")
    rows = numbered(seen, in_order(), "labelled", "row")
    counts = {"m": np.zeros((3, 4)), "s": np.zeros((3, SIZES)), "n": np.zeros((3, LINES)), "q": np.zeros((3, 2)), "move": np.zeros((4, 3))}
    for r in rows.groupBy("r", "_m", "_s", "_n", "_q").count().collect():
        for name in "msnq":
            counts[name][r["r"], r[f"_{name}"]] += r["count"]
    # The line before has the number before, and opens nothing if another transcript's.
    before = rows.select((F.col("row") + 1).alias("row"), F.col("key").alias("k"), F.col("r").alias("b"))
    moved = rows.select("row", "key", "r").join(before, "row", "left")
    for r in moved.groupBy(F.when(F.col("k") == F.col("key"), F.col("b")).alias("b"), "r").count().collect():
        counts["move"][START if r["b"] is None else r["b"], r["r"]] += r["count"]
    return parameters(counts)


def best_step(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def path(tables: list[np.ndarray], entry: int, end: int) -> list[int]:
    """Best states after each table, given those before the first and after the last."""
    score, back = tables[0][entry], []
    for t in tables[1:]:
        reach = score[:, None] + t[:START]
        back.append(reach.argmax(0))
        score = reach.max(0)
    states = [end]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows that agree in ``names``, from rows sorted by them."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[n] for n in names)
            if now != key:
                if rows:
                    yield key, rows
                key, rows = now, []
            rows.append(row)
    if rows:
        yield key, rows


def _tables(rows: list[dict], log: dict[str, np.ndarray]) -> list[np.ndarray]:
    return [log["move"] + (log["m"][:, r["_m"]] + log["s"][:, r["_s"]] + log["n"][:, r["_n"]] + log["q"][:, r["_q"]])[None, :] for r in rows]


def _folded(tables: list[np.ndarray]) -> bytes:
    out = tables[0]
    for t in tables[1:]:
        out = best_step(out, t[:START])
    return out.tobytes()


def _batches(made: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = []
    for row in made:
        rows.append(row)
        if len(rows) == 2000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def format_chat(lines: DataFrame, conv: str = "conv_id", position: str = "turn", text: str = "text", model: dict | None = None) -> DataFrame:
    """(conv, position, role_pred, opens, rendered): a row for each line. ``opens`` tells
    whether the line opens a turn; ``rendered`` in order of position is the canonical
    transcript: a header ``<|role|>`` where a turn opens, then the line without marker."""
    log = model or parameters()
    bare = F.coalesce(F.col("text"), F.lit(""))
    for role in ROLES:
        bare = F.regexp_replace(bare, MARKER % (MARKERS[role], MARKERS[role]), "")
    rows = lines.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{position}`").alias("pos"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumns({"key": key_of("conv"), "h": F.xxhash64("text")})
    rows = numbered(observed(rows, "text"), in_order(), "lines", "row").withColumn("chunk", F.floor(F.col("row") / CHUNK).cast("long"))
    order = ["key", "chunk", "row"]
    level_type = "key string, chunk long, score binary"
    level_schema = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("score", pa.binary())])

    def sorted_by(df: DataFrame, names: list[str], then: list[Column]) -> DataFrame:
        return df.repartition(*names).sortWithinPartitions(*names, *then)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(({"key": k[0], "chunk": k[1], "score": _folded(_tables(group, log))} for k, group in _groups(batches, order[:2])), level_schema)

    def higher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(({"key": k[0], "chunk": k[1], "score": _folded([np.frombuffer(r["score"]).reshape(START + 1, START) for r in group])} for k, group in _groups(batches, ["key", "up"])), level_schema)

    levels = [write_table(sorted_by(rows.select(*order, "_m", "_s", "_n", "_q"), ["key", "chunk"], [F.col("row")]).mapInArrow(lowest, level_type), "level")]
    while (levels[-1].agg(F.max("chunk")).head()[0] or 0) > 0:
        up = levels[-1].withColumn("up", F.floor(F.col("chunk") / CHUNK).cast("long"))
        levels.append(write_table(sorted_by(up, ["key", "up"], [F.col("chunk")]).mapInArrow(higher, level_type), "level"))

    ends_type = "key string, chunk long, entry int, end int"
    ends_schema = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("entry", pa.int32()), ("end", pa.int32())])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(({"key": r["key"], "chunk": r["chunk"], "entry": START, "end": int(np.frombuffer(r["score"]).reshape(START + 1, START)[START].argmax())} for b in batches for r in b.to_pylist()), ends_schema)

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for k, group in _groups(batches, ["key", "up"]):
                before = group[0]["entry"]
                for r, end in zip(group, path([np.frombuffer(r["score"]).reshape(START + 1, START) for r in group], before, group[0]["end"]), strict=True):
                    yield {"key": k[0], "chunk": r["chunk"], "entry": before, "end": end}
                    before = end

        return _batches(made(), ends_schema)

    ends = levels[-1].mapInArrow(top, ends_type)
    for level in reversed(levels[:-1]):
        child = level.withColumn("up", F.floor(F.col("chunk") / CHUNK).cast("long"))
        joined = child.join(ends.select("key", F.col("chunk").alias("up"), "entry", "end"), ["key", "up"])
        ends = sorted_by(joined, ["key", "up"], [F.col("chunk")]).mapInArrow(lower, ends_type)

    out_type = T.StructType([rows.schema["conv"], rows.schema["pos"], T.StructField("text", T.StringType()), T.StructField("state", T.IntegerType()), T.StructField("opens", T.BooleanType())])

    def roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def made(first: pa.RecordBatch) -> Iterator[dict]:
            def all_() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            for _, group in _groups(all_(), ["key", "chunk"]):
                before = group[0]["entry"]
                for r, s in zip(group, path(_tables(group, log), before, group[0]["end"]), strict=True):
                    yield {"conv": r["conv"], "pos": r["pos"], "text": r["text"], "state": s, "opens": s != before}
                    before = s

        for first in batches:
            schema = pa.schema([first.schema.field("conv"), first.schema.field("pos"), ("text", pa.string()), ("state", pa.int32()), ("opens", pa.bool_())])
            yield from _batches(made(first), schema)

    found = sorted_by(rows.join(ends, ["key", "chunk"]), ["key", "chunk"], [F.col("row")]).mapInArrow(roles, out_type)
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("state") + 1)
    rendered = F.concat(F.when(F.col("opens"), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(""), F.trim(bare), F.lit("\n"))
    return found.select(F.col("conv").alias(conv), F.col("pos").alias(position), role.alias("role_pred"), "opens", rendered.alias("rendered"))
