"""Views of a journal at a point of it, and the queries over them.

Everything returned is lazy. A store is a snapshot: rows after ``max_sqn`` don't exist,
and what expired before ``now`` is gone. The last write of a key wins, by one aggregation
whose partial step runs before the shuffle; key filters reach the scan below it, and
bodies are only read where a query asks for them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import attributes as A
from ledgerlake.functions import hashing as H
from ledgerlake.operators.tags import Tags
from ledgerlake.plans import evals, filters, setops
from ledgerlake.plans.tokens import LanguageError
from ledgerlake.sources.journal import GREGORIAN, KEY, value_hash, write_heads, write_index

HEAD = ["sqn", "is_tomb", "size", "obj_hash", "lmd", "ttl"]
ENTRY = ["bucket_type", "bucket", "field", "term_s", "term_i", "key"]
STATE = ["sqn", "at", "is_add", "ttl", "tag"]
Bucket = str | tuple[str, str]
#: A range end that stands for no end.
ALL = "$all"


def same(column: str, value: str | None) -> Column:
    return F.col(column).isNull() if value is None else F.col(column) == value


def in_bucket(bucket: Bucket) -> Column:
    kind, name = bucket if isinstance(bucket, tuple) else (None, bucket)
    return same("bucket_type", kind) & (F.col("bucket") == name)


def bucket_order() -> list[Column]:
    """Typed buckets come before plain ones."""
    return [F.col("bucket_type").asc_nulls_last(), F.col("bucket").asc()]


def in_range(column: str, start: str | None, end: str | None) -> Column:
    """Inclusive; None at either end is open."""
    out = F.lit(True)
    if start is not None:
        out &= F.col(column) >= start
    if end is not None and end != ALL:
        out &= F.col(column) <= end
    return out


@dataclass(frozen=True)
class Query:
    """Of an index query: the eval program (or a function of a frame), the filter program
    (or a function of an attribute getter) and their substitutions."""

    eval: str | Callable | None = None
    filter: str | Callable | None = None
    values: dict[str, str | int] = field(default_factory=dict)


def writes(log: DataFrame) -> DataFrame:
    """What journal rows say of their keys' heads."""
    return log.filter("kind <> 'keyd'").select(*KEY, "sqn", (F.col("kind") == "tomb").alias("is_tomb"), "size", "obj_hash", "lmd", "ttl")


def last_writes(rows: DataFrame) -> DataFrame:
    """The last write of each key. Of writes with one number a delete wins, then the larger
    size, hash and times: the same one whatever order rows come in."""
    last = rows.groupBy(*KEY).agg(F.max(F.struct(*HEAD)).alias("h"))
    return last.select(*KEY, *[F.col(f"h.{c}").alias(c) for c in HEAD])


@dataclass(frozen=True)
class Layout:
    """Heads and index of a journal up to ``sqn``, sorted by key and by term."""

    sqn: int
    heads: DataFrame
    index: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> Layout:
        return Layout(spark.read.parquet(f"{path}/as_of").head()[0], spark.read.parquet(f"{path}/heads"), spark.read.parquet(f"{path}/index"))


@dataclass(frozen=True)
class Store:
    """With a ``layout`` heads and index entries are read from it, merged with what the
    journal has after it; ranges of keys and terms then prune its files. A snapshot before
    the layout reads the journal alone."""

    journal: DataFrame
    now: int | None = None
    max_sqn: int | None = None
    tags: Tags = field(default_factory=Tags)
    layout: Layout | None = None

    # Views

    def clock(self) -> int:
        return int(time.time()) + GREGORIAN if self.now is None else self.now

    def log(self) -> DataFrame:
        return self.journal if self.max_sqn is None else self.journal.filter(F.col("sqn") <= self.max_sqn)

    def snapshot(self, max_sqn: int | None = None) -> Store:
        """The store as it is now: later writes to the journal don't show."""
        if max_sqn is None:
            max_sqn = self.log().agg(F.max("sqn")).head()[0] or 0
        return replace(self, max_sqn=max_sqn, now=self.clock())

    def _since(self) -> tuple[Layout | None, DataFrame]:
        """The layout, if it is part of this snapshot, and the journal rows after it."""
        of = self.layout
        if of is None or (self.max_sqn is not None and self.max_sqn < of.sqn):
            return None, self.log()
        return of, self.log().filter(F.col("sqn") > of.sqn)

    def write_layout(self, path: str, files: int = 200) -> Layout:
        """Write the layout of the store as it is now, and read it."""
        now = self.snapshot()
        write_heads(now.ledger(), f"{path}/heads")
        write_index(now.index_state(), f"{path}/index", files)
        spark = self.journal.sparkSession
        spark.createDataFrame([(now.max_sqn,)], "sqn bigint").write.mode("overwrite").parquet(f"{path}/as_of")
        return Layout.read(spark, path)

    def ledger(self) -> DataFrame:
        """The last write of each key, tombstones included."""
        of, log = self._since()
        rows = writes(log)
        return last_writes(rows if of is None else of.heads.select(rows.columns).unionByName(rows))

    def alive(self) -> Column:
        return F.col("ttl").isNull() | (F.col("ttl") >= self.clock())

    def heads(self, tag: str | None = None) -> DataFrame:
        """Live keys: not deleted, not expired."""
        rows = self.ledger() if tag is None else self.ledger().filter(F.col("tag") == tag)
        return rows.filter(~F.col("is_tomb") & self.alive()).drop("is_tomb")

    def index_state(self) -> DataFrame:
        """The last change of each index entry: whether it adds, and the number, expiry and
        tag of the write that made it."""
        of, log = self._since()
        each = log.select("bucket_type", "bucket", "key", "sqn", "ttl", "tag", F.posexplode("idx").alias("at", "x"))
        each = each.select("bucket_type", "bucket", F.col("x.field").alias("field"), F.col("x.term_s").alias("term_s"), F.col("x.term_i").alias("term_i"), "key", "sqn", "at", (F.col("x.op") == "add").alias("is_add"), "ttl", "tag")
        if of is not None:
            each = of.index.select(each.columns).unionByName(each)
        last = each.groupBy(*ENTRY).agg(F.max(F.struct(*STATE)).alias("h"))
        return last.select(*ENTRY, *[F.col(f"h.{c}").alias(c) for c in STATE])

    def index_entries(self) -> DataFrame:
        """Live index entries, each with the number of the write that made it."""
        return self.index_state().filter("is_add").filter(self.alive()).select(*ENTRY, "sqn")

    def bodies(self) -> DataFrame:
        return self.log().filter("kind = 'stnd'").select(*KEY, "sqn", "value")

    # Point reads

    def _one(self, tag: str, bucket: Bucket, key: str, sub_key: str | None) -> DataFrame:
        return self.heads(tag).filter(in_bucket(bucket) & (F.col("key") == key) & same("sub_key", sub_key))

    def get(self, bucket: Bucket, key: str, tag: str = "o") -> DataFrame:
        one = self._one(tag, bucket, key, None)
        bodies = self.bodies().filter((F.col("tag") == tag) & in_bucket(bucket) & (F.col("key") == key)).select("sqn", "value")
        return one.join(bodies, "sqn").select("bucket_type", "bucket", "key", "sqn", "value")

    def head(self, bucket: Bucket, key: str, tag: str = "o") -> DataFrame:
        one = self._one(tag, bucket, key, None)
        build = self.tags.of(tag).build_head
        return one if build is None else one.withColumn("head", build(F.col))

    def head_only(self, bucket: Bucket, key: str, sub_key: str | None) -> DataFrame:
        return self._one("h", bucket, key, sub_key)

    def sqn(self, bucket: Bucket, key: str, tag: str = "o") -> DataFrame:
        return self._one(tag, bucket, key, None).select("key", "sqn")

    # Lists and folds

    def bucket_list(self, tag: str = "o", first: bool = False) -> DataFrame:
        """Buckets with a live key."""
        found = self.heads(tag).select("bucket_type", "bucket").distinct().orderBy(*bucket_order())
        return found.limit(1) if first else found

    def is_empty(self, tag: str = "o") -> bool:
        return self.heads(tag).limit(1).isEmpty()

    def key_list(self, tag: str = "o", bucket: Bucket | None = None, start: str | None = None, end: str | None = None, pattern: str | None = None, ordered: bool = False, limit: int | None = None) -> DataFrame:
        """Live keys; ``ordered`` by bucket and key if asked for, and always if there is a
        ``limit``, which keeps the first ones."""
        if pattern is not None and tag == "h":
            raise LanguageError("patterns match plain keys only")
        rows = self.heads(tag)
        if bucket is not None:
            rows = rows.filter(in_bucket(bucket) & in_range("key", start, end))
        if pattern is not None:
            rows = rows.filter(F.col("key").rlike(evals.java_pattern(pattern)))
        if ordered or limit is not None:
            rows = rows.orderBy(*bucket_order(), "key", F.col("sub_key").asc_nulls_first())
        rows = rows if limit is None else rows.limit(limit)
        return rows.select("bucket_type", "bucket", "key")

    def head_fold(
        self,
        tag: str = "o",
        buckets: list[Bucket] | None = None,
        bucket: Bucket | None = None,
        keys: tuple[str | None, str | None] = (None, None),
        sub_keys: tuple[str | None, str | None] | None = None,
        lmd: tuple[int | None, int | None] | None = None,
        max_count: int | None = None,
        segments: list[int] | None = None,
        presence: bool = False,
    ) -> DataFrame:
        """Live heads. ``buckets`` are folded in list order, twice if named twice; rows
        without a last-modified time pass any range of it; ``max_count`` counts rows before
        the presence check; ``segments`` are compared in 15 bits."""
        rows, order = self.heads(tag), [*bucket_order(), F.col("key"), F.col("sub_key").asc_nulls_first()]
        if buckets is not None:
            pairs = [(i, *(b if isinstance(b, tuple) else (None, b))) for i, b in enumerate(buckets)]
            wanted = rows.sparkSession.createDataFrame(pairs, "ordinal int, _t string, _b string")
            rows = rows.join(F.broadcast(wanted), F.col("bucket_type").eqNullSafe(F.col("_t")) & (F.col("bucket") == F.col("_b"))).drop("_t", "_b")
            order = [F.col("ordinal"), *order]
        if bucket is not None:
            rows = rows.filter(in_bucket(bucket))
            if sub_keys is None:
                rows = rows.filter(in_range("key", *keys))
            else:
                pair = F.struct(F.col("key"), F.coalesce("sub_key", F.lit("")))
                rows = rows.filter(pair >= F.struct(F.lit(keys[0]), F.lit(sub_keys[0] or ""))).filter(pair <= F.struct(F.lit(keys[1]), F.lit(sub_keys[1] or "")))
        if lmd is not None:
            low, high = lmd
            inside = F.lit(True) if low is None else F.col("lmd") >= low
            inside &= F.lit(True) if high is None else F.col("lmd") <= high
            rows = rows.filter(F.col("lmd").isNull() | inside)
        if segments is not None:
            masked = sorted({s & 32767 for s in segments})
            seg = H.segment48(self.tags.of(tag).canonical(F.col))["seg"]
            rows = rows.filter(seg.bitwiseAND(32767).isin(masked))
        if max_count is not None:
            rows = rows.orderBy(*order).limit(max_count)
        if presence:
            there = self.log().filter("kind <> 'tomb'").select(F.col("sqn").alias("j_sqn"), *[F.col(c).alias(f"j_{c}") for c in KEY])
            on = F.col("sqn") == F.col("j_sqn")
            for c in KEY:
                on &= F.col(c).eqNullSafe(F.col(f"j_{c}")) if c in ("bucket_type", "sub_key") else F.col(c) == F.col(f"j_{c}")
            rows = rows.join(there, on, "left_semi")
        return rows

    def head_page(self, max_count: int, **how) -> tuple[int, DataFrame]:
        """What is left of ``max_count``, and the heads of a fold that stops there. The
        count is of rows before a presence check."""
        page = self.head_fold(max_count=max_count, **{k: v for k, v in how.items() if k != "presence"})
        return max_count - page.count(), self.head_fold(max_count=max_count, **how)

    def metadata(self, tag: str) -> DataFrame:
        """Live objects with the metadata that their tag extracts from bodies."""
        extract = self.tags.of(tag).extract_metadata
        rows = self.object_fold(tag)
        made = extract(F.col("value")) if extract else {"size": F.octet_length("value"), "obj_hash": value_hash(F.col("value"))}
        return rows.select("bucket_type", "bucket", "key", "sqn", *[c.alias(n) for n, c in made.items()])

    def object_fold(self, tag: str = "o", bucket: Bucket | None = None, keys: tuple[str | None, str | None] = (None, None), order: str | None = None) -> DataFrame:
        """Live objects with their bodies. In ``order`` "sqn" the journal is read in write
        order and a row stays if no later write of its key is known: deleted objects are
        gone, expired ones are not. In ``order`` "key" rows are sorted by key."""
        if order == "sqn":
            last = self.ledger().select(*[F.col(c).alias(f"l_{c}") for c in KEY], F.col("sqn").alias("l_sqn"))
            rows = self.bodies().filter(F.col("tag") == tag)
            on = F.col("l_sqn") <= F.col("sqn")
            for c in KEY:
                on &= F.col(c).eqNullSafe(F.col(f"l_{c}")) if c in ("bucket_type", "sub_key") else F.col(c) == F.col(f"l_{c}")
            return rows.join(last, on, "left_semi").orderBy("sqn").select("bucket_type", "bucket", "key", "sqn", "value")
        heads = self.heads(tag)
        if bucket is not None:
            heads = heads.filter(in_bucket(bucket) & in_range("key", *keys))
        bodies = self.bodies().select("sqn", "value", "tag", "bucket", "key")
        if bucket is not None:
            bodies = bodies.filter((F.col("tag") == tag) & in_range("key", *keys))
        rows = heads.join(bodies, ["tag", "bucket", "key", "sqn"]).select("bucket_type", "bucket", "key", "sqn", "value")
        return rows.orderBy(*bucket_order(), "key") if order == "key" else rows

    def object_fold_by_index(self, bucket: Bucket, field_: str, start, end) -> DataFrame:
        """Bodies as the index entry's own write left them, which may be older than the
        object."""
        entries = self._entries(bucket, field_, start, end).select("bucket_type", "bucket", "term_s", "term_i", "key", "sqn")
        bodies = self.bodies().filter(F.col("tag") != "h").select("bucket", "key", "sqn", "value")
        return entries.join(bodies, ["bucket", "key", "sqn"]).select("bucket_type", "bucket", "term_s", "term_i", "key", "sqn", "value")

    # Index queries

    def _entries(self, bucket: Bucket, field_: str, start, end) -> DataFrame:
        """Entries in a range of terms, both ends included. A missing end lies before
        every text term, so it gives none."""
        rows = self.index_entries().filter(in_bucket(bucket) & (F.col("field") == field_))
        if isinstance(start, int) or isinstance(end, int):
            rows = rows.filter("term_i IS NOT NULL")
            return rows.filter(F.col("term_i").between(start, end)) if None not in (start, end) else rows.filter(F.col("term_i") >= start if end is None else F.col("term_i") <= end)
        if end is None:
            return rows.filter("term_i IS NOT NULL AND term_s IS NOT NULL")
        out = rows.filter(F.col("term_s") <= end)
        return out if start is None else out.filter(F.col("term_s") >= start)

    def index_fold(self, bucket: Bucket, field_: str, start, end, start_key: str | None = None, returns: bool | str = False, pattern: str | None = None, query: Query | None = None, ordered: bool = False, limit: int | None = None) -> DataFrame:
        """Keys (``returns`` False), terms and keys (True) or an attribute and keys (its
        name) of the entries in range. A key comes once for each of its terms. They come
        ``ordered`` by term and key if asked for, and always if there is a ``limit``, which
        keeps the first ones that pass; the next page starts at the last one's term and key."""

        def put(out: DataFrame) -> DataFrame:
            if ordered or limit is not None:
                out = out.orderBy(F.col("term_i").asc_nulls_first(), "term_s", "key")
            return out if limit is None else out.limit(limit)

        rows = self._entries(bucket, field_, start, end)
        if start_key is not None:
            at = F.col("term_i") if isinstance(start, int) else F.col("term_s")
            rows = rows.filter((at > start) | ((at == start) & (F.col("key") >= start_key)))
        if pattern is not None:
            rows = rows.filter(F.col("term_s").rlike(evals.java_pattern(pattern)))
        if query is None:
            if isinstance(returns, str):
                raise LanguageError("an attribute can only be returned by a query")
            return put(rows).select("term_s", "term_i", "key") if returns else put(rows).select("key")
        tree = filters.parse(query.filter, query.values) if isinstance(query.filter, str) else None
        wanted = (filters.names(tree) if tree else set()) | ({returns} if isinstance(returns, str) else set())
        term = A.term(F.col("term_s"), F.col("term_i"))
        if callable(query.eval):
            rows = query.eval(rows)
            have = {c.removeprefix(evals.PREFIX) for c in rows.columns if c.startswith(evals.PREFIX)}
        elif query.eval is not None:
            rows, have = evals.apply(evals.parse(query.eval, query.values), rows, term, F.col("key"), wanted)
        else:
            have = set()
        get = lambda n: F.col(f"`{evals.PREFIX}{n}`") if n in have else None
        if callable(query.filter):
            rows = rows.filter(query.filter(get))
        elif tree:
            rows = rows.filter(filters.condition(tree, get))
        if isinstance(returns, str):
            if get(returns) is None:
                return rows.filter(F.lit(False)).select(F.lit(None).cast("string").alias("attr_s"), F.lit(None).cast("bigint").alias("attr_i"), F.lit(None).cast("array<string>").alias("attr_l"), "key")
            a = get(returns)
            return put(rows.filter(A.exists(a))).select(a["s"].alias("attr_s"), a["i"].alias("attr_i"), a["l"].alias("attr_l"), "key")
        return put(rows).select("term_s", "term_i", "key") if returns else put(rows).select("key")

    def multi_index_fold(self, bucket: Bucket, queries: list[tuple[int, tuple]], combine: str | Callable) -> DataFrame:
        """Distinct keys of a set expression over index queries of one snapshot."""
        pinned = self if self.max_sqn is not None else self.snapshot()
        sets = {k: pinned.index_fold(bucket, f, a, b, query=q) for k, (f, a, b, q) in queries}
        return combine(sets) if callable(combine) else setops.combine(setops.parse(combine), sets)

    # Aggregates

    def bucket_stats(self, bucket: Bucket, tag: str = "o") -> DataFrame:
        return self.heads(tag).filter(in_bucket(bucket)).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.count("*").alias("n_objects"))

    def hash_list(self, tag: str = "o") -> DataFrame:
        return self.heads(tag).select("bucket_type", "bucket", "key", "obj_hash")

    def fold(self, rows: DataFrame, order: list, function: Callable, start):
        """A reducer over ordered rows that needs its own order: rows stream to the driver
        partition by partition, never all at once."""
        out = start
        for row in rows.orderBy(*order).toLocalIterator(prefetchPartitions=True):
            out = function(out, row)
        return out

    def return_folder(self, query: tuple) -> DataFrame:
        """Queries given as tuples, by name."""
        name, *args = query
        known: dict[str, Callable] = {
            "bucket_stats": lambda b: self.bucket_stats(b),
            "binary_bucketlist": lambda tag="o": self.bucket_list(tag),
            "keylist": lambda tag, bucket=None, keys=(None, None): self.key_list(tag, bucket, *keys),
            "hashlist_query": lambda tag, _check=False: self.hash_list(tag),
            "index_query": lambda bucket, f, a, b, returns=False, pattern=None: self.index_fold(bucket, f, a, b, returns=returns, pattern=pattern),
            "foldheads_allkeys": lambda tag: self.head_fold(tag),
            "foldheads_bybucket": lambda tag, bucket, keys=(None, None): self.head_fold(tag, bucket=bucket, keys=keys),
            "foldobjects_allkeys": lambda tag, order="key": self.object_fold(tag, order=order),
            "foldobjects_bybucket": lambda tag, bucket, keys=(None, None): self.object_fold(tag, bucket, keys),
            "foldobjects_byindex": lambda bucket, f, a, b: self.object_fold_by_index(bucket, f, a, b),
        }
        if name not in known:
            raise LanguageError(f"no query {name}")
        return known[name](*args)
