from __future__ import annotations

import random

import pyarrow as pa

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Cases that every operator has to stand: nulls, empty and blank texts, repeats, a null id.
ODD = [(None, "a text without an id"), (900001, None), (900002, ""), (900003, " \n\t "), (900004, "!!! 123 ..."), (900005, "x"), (900005, "x"), (900006, "same id"), (900006, "other text")]


def words(n: int, seed: int = 0) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def docs(spark, rows: list[tuple], extra: bool = False):
    """(doc_id, text) rows; ``extra`` adds columns named like those of results."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    if extra:
        df = df.selectExpr("*", "'c' AS block", "1 AS bucket", "'n' AS node", "2 AS page0", "'d' AS doc", "7 AS _row", "'k' AS key")
    return df


def sample(n: int = 60) -> list[tuple]:
    import pyarrow.parquet as pq

    t: pa.Table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))[:n]


def no(i: int | None) -> int:
    """An id that sorts."""
    return -1 if i is None else i
