"""Maintenance: what rewrites the journal or the ledger, and what tells how to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.store import Store
from ledgerlake.operators.tags import diff_specs
from ledgerlake.sources.journal import KEY, SCHEMA


def with_current(store: Store) -> DataFrame:
    """Journal rows with ``last_sqn``, the number of their key's last write."""
    last = store.ledger().select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("sqn").alias("last_sqn"))
    on = F.lit(True)
    for c in KEY:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return store.log().join(last, on, "left").drop(*[f"_{c}" for c in KEY])


def reap(store: Store) -> DataFrame:
    """The ledger without tombstones and expired rows."""
    return store.heads()


TERMS = "array<struct<field:string,term_s:string,term_i:bigint>>"


def compact(store: Store, strategies: dict[str, str] | None = None) -> DataFrame:
    """The journal with superseded bodies handled by their tag's strategy. ``retain`` keeps
    their index changes. ``recalc`` finds the index anew: where the tag tells the terms of
    a body, the last body's changes are its ``diff`` from no terms, and all before go; else
    of superseded rows stay, without bodies, the additions that are still in the index.
    ``recovr`` drops superseded rows and their index changes, so entries can be lost."""
    rows = with_current(store)
    known = strategies or {name: tag.strategy for name, tag in store.tags.known.items()}
    strategy = F.lit("retain")
    for name, s in known.items():
        strategy = F.when(F.col("tag") == name, s).otherwise(strategy)
    current = F.col("last_sqn").isNull() | (F.col("sqn") >= F.col("last_sqn"))
    recalc = [name for name, s in known.items() if s == "recalc"]
    told = [name for name in recalc if store.tags.of(name).index_terms]
    idx = F.col("idx")
    for name in told:
        tag = store.tags.of(name)
        anew = tag.diff(F.array().cast(TERMS), tag.index_terms(F.col("value")))
        idx = F.when((F.col("tag") == name) & (F.col("kind") == "stnd"), anew).otherwise(idx)
    rows = rows.withColumn("idx", idx)
    if kept_by := [name for name in recalc if name not in told]:
        live = store.index_state().filter("is_add").filter(F.col("tag").isin(kept_by)).select("sqn", F.col("bucket_type").alias("_t"), F.col("bucket").alias("_b"), F.col("key").alias("_k"), F.struct(F.lit("add").alias("op"), "field", "term_s", "term_i").alias("_x"))
        live = live.groupBy("sqn", "_t", "_b", "_k").agg(F.collect_list("_x").alias("_live")).withColumnRenamed("sqn", "_s")
        on = (F.col("sqn") == F.col("_s")) & F.col("bucket_type").eqNullSafe(F.col("_t")) & (F.col("bucket") == F.col("_b")) & (F.col("key") == F.col("_k")) & F.col("tag").isin(kept_by)
        rows = rows.join(live, on, "left").drop("_s", "_t", "_b", "_k")
        rows = rows.withColumn("idx", F.when(F.col("tag").isin(kept_by) & ~current, F.col("_live")).otherwise(F.col("idx"))).drop("_live")
    still = (strategy == "retain") | (F.col("tag").isin(kept_by) & F.col("idx").isNotNull() if kept_by else F.lit(False))
    keyed = ~current & still & ((F.col("kind") == "stnd") | (strategy == "recalc"))
    out = {"kind": F.when(keyed, "keyd").otherwise(F.col("kind")), "value": F.when(keyed, None).otherwise(F.col("value")), "size": F.when(keyed, 0).otherwise(F.col("size"))}
    return rows.filter(current | still).withColumns(out).select(SCHEMA.names)


def compaction_score(store: Store, block: int = 1000) -> DataFrame:
    """For each block of consecutive numbers the share of its bytes that is still live."""
    rows = with_current(store).filter("kind = 'stnd'")
    live = F.sum(F.when(F.col("sqn") >= F.col("last_sqn"), F.col("size")).otherwise(0))
    return rows.groupBy(F.floor(F.col("sqn") / block).cast("bigint").alias("block")).agg(live.alias("live_size"), F.sum("size").alias("total_size"))


def best_run(scores: DataFrame, longest: int = 4, threshold: float = 0.6) -> list[int]:
    """The consecutive blocks with most to gain, of ``longest`` blocks at most; the first and
    shortest of equal ones. One row comes to the driver."""
    dead = F.when(F.col("total_size") > 0, 1 - F.col("live_size") / F.col("total_size")).otherwise(1.0)
    gains = scores.select("block", (dead - (1 - threshold)).alias("gain"))
    runs = found = gains.select(F.col("block").alias("first"), F.col("block").alias("last"), "gain")
    for _ in range(1, longest):
        following = gains.select((F.col("block") - 1).alias("last"), F.col("gain").alias("more"))
        runs = runs.join(following, "last").select("first", (F.col("last") + 1).alias("last"), (F.col("gain") + F.col("more")).alias("gain"))
        found = found.unionByName(runs)
    best = found.filter("gain > 0").orderBy(F.desc("gain"), "first", "last").head()
    return list(range(best["first"], best["last"] + 1)) if best else []


def trim(store: Store, persisted: int) -> DataFrame:
    """A head-only journal without what the ledger has persisted."""
    return store.log().filter((F.col("tag") != "h") | (F.col("sqn") > persisted))


def index_changes(old: DataFrame, new: DataFrame, on: list[str], old_terms: str = "terms", new_terms: str = "terms", diff=diff_specs) -> DataFrame:
    """Index changes that lead from the terms of ``old`` to those of ``new``, key by key;
    a key that one side lacks has no terms there."""
    none = F.array().cast("array<struct<field:string,term_s:string,term_i:bigint>>")
    a = old.select(*on, F.col(old_terms).alias("_old"))
    b = new.select(*on, F.col(new_terms).alias("_new"))
    return a.join(b, on, "full").select(*on, diff(F.coalesce("_old", none), F.coalesce("_new", none)).alias("idx"))


def mput(journal: DataFrame, specs: DataFrame, sqn: int) -> DataFrame:
    """The journal with a batch of head-only changes (op, bucket, key, sub_key, value),
    all under one number: ``add`` sets a row, ``remove`` deletes it."""
    kind: Column = F.when(F.col("op") == "remove", "tomb").otherwise("mput")
    given = {"sqn": F.lit(sqn), "kind": kind, "tag": F.lit("h"), "bucket": F.col("bucket"), "key": F.col("key"), "sub_key": F.col("sub_key"), "size": F.octet_length("value"), "obj_hash": F.conv(F.substring(F.md5("value"), 1, 8), 16, 10)}
    rows = specs.select([given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields])
    return journal.unionByName(rows)
