"""A query for each operator over the driver's tables, with the SQL it must equal.

``events`` is the journal proper: several writes a user, numbered by event, errors are
deletes, signups expire. Customers, parts, orders, order lines and documents are objects
written once, with index terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import attributes as A
from ledgerlake.functions import hashing as H
from ledgerlake.operators import maintain, tictac
from ledgerlake.operators.store import Query, Store, last_writes
from ledgerlake.operators.tags import Tag, Tags
from ledgerlake.plans import evals
from ledgerlake.sources import journal as J

#: The clock of all queries: 1 February 2024.
NOW = J.GREGORIAN + 1706745600
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(column: str, n: int = 10) -> F.Column:
    return F.lpad(F.col(column).cast("string"), n, "0")


def seconds(column: str) -> F.Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def events_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "tomb").otherwise("stnd")
    ttl = F.when(F.col("event_type") == "signup", seconds("ts") + J.GREGORIAN + 86400 * (F.col("event_id") % 60))
    last = F.array(J.spec("add", "last_bin", F.col("event_type")), J.spec("remove", "last_bin", F.lit("click")), J.spec("add", "value_int", number=F.floor("value")))
    idx = F.when(F.col("event_type") == "purchase", last).when(F.col("event_type") != "error", F.array(J.spec("add", "last_bin", F.col("event_type"))))
    return J.rows(e, sqn=F.col("event_id") + 1, kind=kind, bucket=F.lit("events"), key=padded("user_id"), value=F.when(kind == "stnd", F.col("props")), size=F.octet_length("props"), obj_hash=J.value_hash(F.col("props")), lmd=seconds("ts"), ttl=ttl, idx=idx)


def customer_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    full = F.concat_ws("|", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))
    idx = F.array(J.spec("add", "cust_bin", full), J.spec("add", "seg_bin", F.col("c_mktsegment")), J.spec("add", "nat_bin", padded("c_nationkey", 2)), J.spec("add", "nation_int", number=F.col("c_nationkey")))
    return J.rows(c, sqn=F.col("c_custkey") + 1, bucket=F.lit("customer"), key=padded("c_custkey"), value=F.col("c_name"), idx=idx)


def part_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    pairs = F.concat(F.lit("size="), size, F.lit("|brand="), F.col("p_brand"), F.lit("|junk"))
    idx = F.array(J.spec("add", "part_bin", F.concat_ws("|", "p_name", "p_brand", "p_type", size)), J.spec("add", "kv_bin", pairs))
    return J.rows(p, sqn=F.col("p_partkey") + 1, bucket_type=F.lit("typed"), bucket=F.lit("part"), key=padded("p_partkey"), value=F.col("p_name"), idx=idx)


def orders_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    term = F.concat_ws("|", F.date_format("o_orderdate", "yyyyMMdd"), "o_orderstatus", "o_orderpriority")
    idx = F.array(J.spec("add", "order_bin", term), J.spec("add", "cust_int", number=F.col("o_custkey")))
    return J.rows(o, sqn=F.col("o_orderkey") + 1, bucket=F.lit("orders"), key=padded("o_orderkey"), value=F.col("o_orderpriority"), lmd=seconds("o_orderdate"), idx=idx)


def lines_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    value = F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    one = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(value).alias("v"))
    return J.rows(one, sqn=F.lit(1), kind=F.lit("mput"), tag=F.lit("h"), bucket=F.lit("lines"), key=padded("l_orderkey"), sub_key=padded("l_linenumber", 4), size=F.octet_length("v"), obj_hash=J.value_hash(F.col("v")))


def documents_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return J.rows(d, sqn=F.col("doc_id") + 1, bucket=F.lit("documents"), key=padded("doc_id"), value=F.col("text"))


JOURNALS = {"events": events_journal, "customer": customer_journal, "part": part_journal, "orders": orders_journal, "lines": lines_journal, "documents": documents_journal}


def store(spark: SparkSession, sf_dir: str, *names: str) -> Store:
    out = JOURNALS[names[0]](spark, sf_dir)
    for n in names[1:]:
        out = out.unionByName(JOURNALS[n](spark, sf_dir))
    return Store(out, now=NOW)


def hex_of(text: str, start: int, n: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {start}, {n}) AS BIGINT)"


EVENTS = f"""WITH j AS (
  SELECT event_id + 1 AS sqn, event_type = 'error' AS tomb, lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, props AS value, CAST(strlen(props) AS BIGINT) AS size,
    {hex_of('props', 1, 8)} AS obj_hash, CAST(floor(epoch(ts)) AS BIGINT) AS lmd, event_type, value AS v,
    CASE WHEN event_type = 'signup' THEN CAST(floor(epoch(ts)) AS BIGINT) + {J.GREGORIAN} + 86400 * (event_id % 60) END AS ttl
  FROM events
), led AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY key ORDER BY sqn DESC) = 1),
live AS (SELECT * FROM led WHERE NOT tomb AND (ttl IS NULL OR ttl >= {NOW}))
"""
CUSTOMERS = "WITH c AS (SELECT c_name || '|' || c_mktsegment || '|' || c_nationkey AS term, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key, c_name AS n, c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS nat, CAST(c_nationkey AS BIGINT) AS k, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS nat2 FROM customer)\n"
PARTS = "WITH p AS (SELECT p_name AS name, p_brand AS brand, p_type AS kind, CAST(p_size AS BIGINT) AS size, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS key FROM part)\n"
ORDERS = "WITH o AS (SELECT strftime(o_orderdate, '%Y%m%d') || '|' || o_orderstatus || '|' || o_orderpriority AS term, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_custkey, o_orderpriority AS value, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS lmd FROM orders)\n"
LINES = f"WITH l AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS key, lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS sub_key, min(l_returnflag || '|' || l_linestatus || '|' || l_partkey) AS v FROM lineitem GROUP BY ALL), h AS (SELECT *, {hex_of('v', 1, 8)} AS obj_hash FROM l)\n"
USER, DAY = "0000000009", 86400

# Point reads and lists


@query("lww_ledger", EVENTS + "SELECT key, sqn, tomb AS is_tomb, size, obj_hash, lmd, ttl FROM led")
def _(s, d):
    return store(s, d, "events").ledger().select("key", "sqn", "is_tomb", "size", "obj_hash", "lmd", "ttl")


@query("get_object", EVENTS + f"SELECT key, sqn, value FROM live WHERE key = '{USER}'")
def _(s, d):
    return store(s, d, "events").get("events", USER).select("key", "sqn", "value")


@query("head_object", EVENTS + f"SELECT key, sqn, size, obj_hash, lmd FROM live WHERE key = '{USER}'")
def _(s, d):
    return store(s, d, "events").head("events", USER).select("key", "sqn", "size", "obj_hash", "lmd")


@query("head_subkey", LINES + "SELECT key, sub_key, obj_hash FROM h WHERE key = '0000000007' AND sub_key = '0001'")
def _(s, d):
    return store(s, d, "lines").head_only("lines", "0000000007", "0001").select("key", "sub_key", "obj_hash")


@query("sqn_lookup", EVENTS + f"SELECT key, sqn FROM live WHERE key = '{USER}'")
def _(s, d):
    return store(s, d, "events").sqn("events", USER)


@query("bucket_list", EVENTS + "SELECT DISTINCT NULL AS bucket_type, 'events' AS bucket FROM live UNION ALL SELECT DISTINCT NULL, 'customer' FROM customer UNION ALL SELECT DISTINCT 'typed', 'part' FROM part")
def _(s, d):
    return store(s, d, "events", "customer", "part").bucket_list()


@query("bucket_first", "SELECT DISTINCT 'typed' AS bucket_type, 'part' AS bucket FROM part")
def _(s, d):
    return store(s, d, "events", "customer", "part").bucket_list(first=True)


@query("is_empty", EVENTS + "SELECT NOT EXISTS (SELECT 1 FROM live) AS is_empty")
def _(s, d):
    return store(s, d, "events").heads("o").limit(1).agg((F.count("*") == 0).alias("is_empty"))


@query("keylist_all", EVENTS + "SELECT 'events' AS bucket, key FROM live UNION ALL SELECT 'orders', lpad(CAST(o_orderkey AS VARCHAR), 10, '0') FROM orders")
def _(s, d):
    return store(s, d, "events", "orders").key_list().select("bucket", "key")


@query("keylist_bucket", ORDERS + "SELECT key FROM o")
def _(s, d):
    return store(s, d, "events", "orders").key_list(bucket="orders").select("key")


@query("keylist_range", ORDERS + "SELECT key FROM o WHERE key BETWEEN '0000000100' AND '0000000400'")
def _(s, d):
    return store(s, d, "orders").key_list(bucket="orders", start="0000000100", end="0000000400").select("key")


@query("keylist_regex", ORDERS + "SELECT key FROM o WHERE key BETWEEN '0000000100' AND '0000000400' AND regexp_matches(key, '1.3')")
def _(s, d):
    return store(s, d, "orders").key_list(bucket="orders", start="0000000100", end="0000000400", pattern="1.3").select("key")


# Folds


@query("objectfold_keyorder", EVENTS + "SELECT key, sqn, value FROM live")
def _(s, d):
    return store(s, d, "events").object_fold(order="key").select("key", "sqn", "value")


@query("objectfold_sqnorder", EVENTS + "SELECT key, sqn, value FROM led WHERE NOT tomb")
def _(s, d):
    return store(s, d, "events").object_fold(order="sqn").select("key", "sqn", "value")


@query("objectfold_range", EVENTS + "SELECT key, sqn, value FROM live WHERE key BETWEEN '0000000010' AND '0000000060'")
def _(s, d):
    return store(s, d, "events").object_fold(bucket="events", keys=("0000000010", "0000000060")).select("key", "sqn", "value")


INDEX = EVENTS + f""", e AS (
  SELECT key, sqn, 0 AS nth, event_type AS t, TRUE AS is_add, ttl FROM j WHERE event_type <> 'error'
  UNION ALL SELECT key, sqn, 1, 'click', FALSE, ttl FROM j WHERE event_type = 'purchase'
), last AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key, t ORDER BY sqn DESC, nth DESC) = 1),
ix AS (SELECT key, t, sqn FROM last WHERE is_add AND (ttl IS NULL OR ttl >= {NOW}))
"""


@query("objectfold_index", INDEX + "SELECT t AS term_s, ix.key, ix.sqn, j.value FROM ix JOIN j USING (sqn) WHERE t BETWEEN 'c' AND 's' AND NOT j.tomb")
def _(s, d):
    return store(s, d, "events").object_fold_by_index("events", "last_bin", "c", "s").select("term_s", "key", "sqn", "value")


@query("index_delta", INDEX + "SELECT key, t AS term_s, sqn FROM ix")
def _(s, d):
    return store(s, d, "events").index_entries().filter("field = 'last_bin'").select("key", "term_s", "sqn")


@query("headfold_all", EVENTS + "SELECT key, size, obj_hash FROM live")
def _(s, d):
    return store(s, d, "events").head_fold().select("key", "size", "obj_hash")


@query("headfold_range", EVENTS + "SELECT key, size FROM live WHERE key >= '0000000050'")
def _(s, d):
    return store(s, d, "events", "customer").head_fold(bucket="events", keys=("0000000050", "$all")).select("key", "size")


@query("headfold_buckets", EVENTS + "SELECT 0 AS ordinal, 'customer' AS bucket, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key FROM customer UNION ALL SELECT 1, 'events', key FROM live UNION ALL SELECT 2, 'customer', lpad(CAST(c_custkey AS VARCHAR), 10, '0') FROM customer")
def _(s, d):
    return store(s, d, "events", "customer", "part").head_fold(buckets=["customer", "events", "customer"]).select("ordinal", "bucket", "key")


LOW, HIGH = 1704067200 + 10 * DAY, 1704067200 + 40 * DAY


@query("headfold_lmd", EVENTS + f"SELECT 'events' AS bucket, key, lmd FROM live WHERE lmd BETWEEN {LOW} AND {HIGH} UNION ALL SELECT 'customer', lpad(CAST(c_custkey AS VARCHAR), 10, '0'), NULL FROM customer")
def _(s, d):
    return store(s, d, "events", "customer").head_fold(lmd=(LOW, HIGH)).select("bucket", "key", "lmd")


@query("headfold_limit", ORDERS + "SELECT key FROM o ORDER BY key LIMIT 500")
def _(s, d):
    return store(s, d, "orders").head_fold(bucket="orders", max_count=500).select("key")


@query("fold_break", ORDERS + "SELECT key FROM o WHERE key > '0000000200' ORDER BY key LIMIT 50")
def _(s, d):
    return store(s, d, "orders").key_list(bucket="orders", start="00000002000", limit=50).select("key")


def seg_sql(text: str) -> str:
    return hex_of(text, 1, 4)


@query("headfold_segments", ORDERS + f"SELECT key FROM o WHERE {seg_sql(chr(39) + 'orders' + chr(39) + ' || key')} & 32767 IN (5, 1000, 4242, 30000) OR ({seg_sql(chr(39) + 'orders' + chr(39) + ' || key')} & 32767) BETWEEN 100 AND 300")
def _(s, d):
    return store(s, d, "orders").head_fold(segments=[5, 1000, 4242, 30000, *range(100, 301)]).select("key")


@query("headfold_presence", EVENTS + "SELECT key, sqn FROM live")
def _(s, d):
    return store(s, d, "events").head_fold(presence=True).select("key", "sqn")


@query("headonly_fold", LINES + "SELECT key, sub_key, obj_hash FROM h WHERE (key > '0000000010' OR key = '0000000010' AND sub_key >= '0003') AND (key < '0000000200' OR key = '0000000200' AND sub_key <= '0002')")
def _(s, d):
    return store(s, d, "lines").head_fold("h", bucket="lines", keys=("0000000010", "0000000200"), sub_keys=("0003", "0002")).select("key", "sub_key", "obj_hash")


@query("hashlist", EVENTS + "SELECT key, obj_hash FROM live")
def _(s, d):
    return store(s, d, "events").hash_list().select("key", "obj_hash")


@query("asof_snapshot", EVENTS.replace("FROM events", "FROM events WHERE event_id < 500") + "SELECT key, sqn FROM live")
def _(s, d):
    return store(s, d, "events").snapshot(500).heads().select("key", "sqn")


@query("custom_fold", EVENTS + "SELECT count(*) AS n, min(key) AS first_key, sum(size) AS total_size FROM live")
def _(s, d):
    st = store(s, d, "events")
    n, first, total = st.fold(st.head_fold().select("key", "size"), ["key"], lambda a, r: (a[0] + 1, a[1] or r["key"], a[2] + r["size"]), (0, None, 0))
    return s.createDataFrame([(n, first, total)], "n bigint, first_key string, total_size bigint")


# Writes and maintenance


@query("ttl_filter", EVENTS + f"SELECT key, ttl FROM led WHERE NOT tomb AND ttl < {NOW}")
def _(s, d):
    st = store(s, d, "events")
    return st.ledger().filter(~F.col("is_tomb") & ~st.alive()).select("key", "ttl")


@query("tombstone_filter", EVENTS + "SELECT key, sqn FROM led WHERE tomb")
def _(s, d):
    return store(s, d, "events").ledger().filter("is_tomb").select("key", "sqn")


@query("mput_apply", LINES + f"SELECT key, sub_key, obj_hash FROM h WHERE key <> '0000000003' UNION ALL SELECT '0000000003', 'new', {hex_of(chr(39) + 'x' + chr(39), 1, 8)}")
def _(s, d):
    lines = lines_journal(s, d)
    gone = lines.filter("key = '0000000003'").select(F.lit("remove").alias("op"), "bucket", "key", "sub_key", F.lit(None).cast("string").alias("value"))
    new = s.createDataFrame([("add", "lines", "0000000003", "new", "x")], gone.schema)
    return Store(maintain.mput(lines, gone.unionByName(new), 2), now=NOW).heads("h").select("key", "sub_key", "obj_hash")


@query("index_diff", CUSTOMERS + "SELECT key, 'remove' AS op, seg AS term_s FROM c WHERE k < 10 UNION ALL SELECT key, 'add', nat2 FROM c WHERE k < 10")
def _(s, d):
    c = table(s, d, "customer").select(padded("c_custkey").alias("key"), "c_mktsegment", "c_nationkey")
    term = lambda x: F.struct(F.lit("f").alias("field"), x.cast("string").alias("term_s"), F.lit(None).cast("bigint").alias("term_i"))
    kept = term(F.lit("kept"))
    old = c.select("key", F.array(kept, term(F.col("c_mktsegment"))).alias("terms"))
    new = c.select("key", F.array(kept, F.when(F.col("c_nationkey") < 10, term(padded("c_nationkey", 2))).otherwise(term(F.col("c_mktsegment")))).alias("terms"))
    return maintain.index_changes(old, new, ["key"]).select("key", F.explode("idx").alias("x")).select("key", "x.op", "x.term_s")


@query("reap", EVENTS + "SELECT key, sqn FROM live")
def _(s, d):
    return maintain.reap(store(s, d, "events")).select("key", "sqn")


@query("compact_retain", EVENTS + "SELECT j.sqn, CASE WHEN j.tomb THEN 'tomb' WHEN j.sqn < led.sqn THEN 'keyd' ELSE 'stnd' END AS kind, CASE WHEN NOT j.tomb AND j.sqn = led.sqn THEN j.value END AS value FROM j JOIN led USING (key)")
def _(s, d):
    return maintain.compact(store(s, d, "events")).select("sqn", "kind", "value")


@query("compact_recalc", INDEX + "SELECT j.sqn, CASE WHEN j.sqn = led.sqn THEN CASE WHEN j.tomb THEN 'tomb' ELSE 'stnd' END ELSE 'keyd' END AS kind FROM j JOIN led USING (key) WHERE j.sqn = led.sqn OR j.sqn IN (SELECT sqn FROM last WHERE is_add UNION SELECT max(sqn) FROM j WHERE event_type = 'purchase' GROUP BY key, floor(v))")
def _(s, d):
    return maintain.compact(store(s, d, "events"), {"o": "recalc"}).select("sqn", "kind")


@query("compact_recalc_index", INDEX + "SELECT key, t AS term_s, sqn FROM ix")
def _(s, d):
    after = maintain.compact(store(s, d, "events"), {"o": "recalc"})
    return Store(after, now=NOW).index_entries().filter("field = 'last_bin'").select("key", "term_s", "sqn")


@query("compaction_score", EVENTS + "SELECT CAST(floor(j.sqn / 1000) AS BIGINT) AS block, CAST(sum(CASE WHEN j.sqn = led.sqn THEN j.size ELSE 0 END) AS BIGINT) AS live_size, CAST(sum(j.size) AS BIGINT) AS total_size FROM j JOIN led USING (key) WHERE NOT j.tomb GROUP BY 1")
def _(s, d):
    return maintain.compaction_score(store(s, d, "events"))


@query("rebuild_ledger", EVENTS + "SELECT key, sqn, tomb AS is_tomb FROM led")
def _(s, d):
    st = store(s, d, "events")
    early, late = st.snapshot(700).ledger(), Store(st.journal.filter("sqn > 700"), NOW).ledger()
    return last_writes(early.unionByName(late)).select("key", "sqn", "is_tomb")


@query("trim_journal", LINES + "SELECT 'h' AS tag, key, sub_key FROM h WHERE CAST(key AS BIGINT) * 10 + CAST(sub_key AS BIGINT) > 5000 UNION ALL SELECT 'o', lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), NULL FROM orders")
def _(s, d):
    lines = lines_journal(s, d).withColumn("sqn", F.col("key").cast("bigint") * 10 + F.col("sub_key").cast("bigint"))
    return maintain.trim(Store(lines.unionByName(orders_journal(s, d)), now=NOW), 5000).select("tag", "key", "sub_key")


# Index queries


@query("index_range", ORDERS + "SELECT term AS term_s, key FROM o WHERE term BETWEEN '19950101' AND '19951231~'")
def _(s, d):
    return store(s, d, "orders").index_fold("orders", "order_bin", "19950101", "19951231~", returns=True).select("term_s", "key")


@query("index_page", ORDERS + "SELECT term AS term_s, key FROM o WHERE (term > '19950101|F|1-URGENT' OR term = '19950101|F|1-URGENT' AND key >= '0000000300') AND term <= '19960101' ORDER BY term, key LIMIT 40")
def _(s, d):
    return store(s, d, "orders").index_fold("orders", "order_bin", "19950101|F|1-URGENT", "19960101", start_key="0000000300", returns=True, limit=40).select("term_s", "key")


@query("index_keys", ORDERS + "SELECT key FROM o WHERE term >= '1996' AND term <= '1997'")
def _(s, d):
    return store(s, d, "orders").index_fold("orders", "order_bin", "1996", "1997")


@query("index_terms", ORDERS + "SELECT o_custkey AS term_i, key FROM o WHERE o_custkey BETWEEN 10 AND 60")
def _(s, d):
    return store(s, d, "orders").index_fold("orders", "cust_int", 10, 60, returns=True).select("term_i", "key")


@query("index_regex", ORDERS + "SELECT term AS term_s, key FROM o WHERE term >= '1993' AND term <= '1996' AND regexp_matches(term, '[|][FO][|][1-3]-')")
def _(s, d):
    return store(s, d, "orders").index_fold("orders", "order_bin", "1993", "1996", returns=True, pattern="[|][FO][|][1-3]-").select("term_s", "key")


def customers(s: SparkSession, d: str, filter_: str, steps: str = "", returns: bool | str = True, **values) -> DataFrame:
    program = 'delim($term, "|", ($n, $seg, $nat)) | to_integer($nat, $k)' + (f" | {steps}" if steps else "")
    rows = store(s, d, "customer").index_fold("customer", "cust_bin", "A", "Z", returns=returns, query=Query(program, filter_, values))
    return rows.select("term_s", "key") if returns is True else rows


def by_filter(name: str, filter_: str, sql: str, steps: str = "", **values) -> None:
    query(name, CUSTOMERS + f"SELECT term AS term_s, key FROM c WHERE {sql}")(lambda s, d: customers(s, d, filter_, steps, **values))


by_filter("index_eval_filter", '$seg = "FURNITURE" AND $nat BETWEEN "1" AND "2~"', "seg = 'FURNITURE' AND nat BETWEEN '1' AND '2~'")
by_filter("filter_cmp", '($seg >= "F" AND $k < 10) OR $nat > "22"', "(seg >= 'F' AND k < 10) OR nat > '22'")
by_filter("filter_ne", '$seg <> "BUILDING" AND NOT $k <> 3 OR $missing <> "x" OR $k <> "3"', "seg <> 'BUILDING' AND k = 3")
by_filter("filter_between", '$nat BETWEEN "1" AND "2~" OR $k BETWEEN 20 AND 10 OR $k BETWEEN 4 AND 5', "nat BETWEEN '1' AND '2~' OR k BETWEEN 4 AND 5")
by_filter("filter_in", '$seg IN ("MACHINERY", "FURNITURE") AND NOT $nat IN ("1", "2")', "seg IN ('MACHINERY', 'FURNITURE') AND nat NOT IN ('1', '2')")
by_filter("filter_in_list", '"Customer" IN $parts AND "7" IN $nats AND NOT "7" IN $seg', "list_contains(string_split(n, '#'), 'Customer') AND nat = '7'", 'split($n, "#", $parts) | split($nat, ",", $nats)')
by_filter("filter_contains", 'contains($n, "0007") AND NOT contains($k, "7")', "contains(n, '0007')")
by_filter("filter_begins", 'begins_with($seg, "MA")', "starts_with(seg, 'MA')")
by_filter("filter_ends", 'ends_with($n, "9") AND ends_with($seg, "Y")', "suffix(n, '9') AND suffix(seg, 'Y')")
by_filter("filter_exists", "attribute_exists($k) AND NOT attribute_exists($zip)", "TRUE")
by_filter("filter_not_exists", 'attribute_not_exists($zip) AND $seg = "BUILDING"', "seg = 'BUILDING'")
by_filter("filter_empty", "attribute_empty($e) AND NOT attribute_empty($n) AND NOT attribute_empty($zip) AND $k < 5", "k < 5", 'join(($none), "-", $e)')
by_filter("filter_bool", 'NOT $seg = "MACHINERY" AND ($k > 20 OR NOT $nope = "1" AND $nat < "2") OR $k = 0', "NOT seg = 'MACHINERY' AND (k > 20 OR nat < '2') OR k = 0")
by_filter("filter_subst", "$seg BETWEEN :low AND :high AND $k >= :k", "seg BETWEEN 'B' AND 'G' AND k >= 7", low="B", high="G", k=7)


def parts(name: str, steps: str, returns: str, sql: str, where: str = "TRUE", filter_: str | None = None, index: str = "part_bin") -> None:
    """The attribute ``returns`` as text, beside its key."""
    start = "" if index == "kv_bin" else 'delim($term, "|", ($name, $brand, $kind, $size)) | '

    def run(s: SparkSession, d: str) -> DataFrame:
        got = store(s, d, "part").index_fold(("typed", "part"), index, "A", "z~", returns=returns, query=Query(start + steps, filter_))
        return got.select("key", F.coalesce("attr_s", F.col("attr_i").cast("string"), F.array_join("attr_l", ",")).alias("attr"))

    query(name, PARTS + f"SELECT key, {sql} AS attr FROM p WHERE {where}")(run)


parts("index_attr", 'regex($kind, "^(S[A-Z]+)$", ($s))', "s", "kind", "kind LIKE 'S%'")
parts("eval_pipe", 'to_integer($size, $i) | add($i, 100, $j) | subtract($j, $i, $l) | add($l, $i, $m)', "m", "CAST(size + 100 AS VARCHAR)")
parts("eval_delim", 'delim($brand, "#", ($b, $no))', "no", "split_part(brand, '#', 2)")
parts("eval_join", 'to_integer($size, $i) | join(($brand, $none, $i, $kind), "-", $j)', "j", "brand || '--' || kind")
parts("eval_split", 'split($name, " ", $w)', "w", "array_to_string(list_filter(string_split(name, ' '), lambda x: x <> ''), ',')")
parts("eval_slice", "slice($brand, 3, $s)", "s", "array_to_string(list_transform(range(0, length(brand) // 3), lambda i: substr(brand, i * 3 + 1, 3)), ',')")
parts("eval_index", "index($brand, 6, 2, $s)", "s", "substr(brand, 7, 2)", "length(brand) >= 8")
parts("eval_kvsplit", 'kvsplit($term, "|", "=")', "brand", "brand", "size = 11 OR brand LIKE '%7'", '$size = "11" OR ends_with($brand, "7")', "kv_bin")
parts("eval_regex", 'regex($name, "^(?P<one>[a-z]+) ([a-z]+)$", pcre, ($a, $b)) | regex($name, "([a-z])", ($a, $b))', "b", "regexp_extract(name, '^([a-z]+) ([a-z]+)$', 2)", "regexp_matches(name, '^([a-z]+) ([a-z]+)$')")
parts("eval_map", 'to_integer($size, $i) | map($i, <, ((10, "S"), (25, "M")), "L", $c)', "c", "CASE WHEN size < 10 THEN 'S' WHEN size < 25 THEN 'M' ELSE 'L' END")
parts("eval_to_integer", 'index($brand, 6, 1, $d) | to_integer($d, $i) | to_integer($name, $i)', "i", "substr(brand, 7, 1)")
parts("eval_to_string", 'to_integer($size, $i) | to_string($i, $t) | join(($t), "-", $u)', "u", "CAST(size AS VARCHAR)")
parts("eval_add", "to_integer($size, $i) | add($i, $none, $j) | add($j, -3, $j)", "j", "CAST(size - 3 AS VARCHAR)")
parts("eval_subtract", "to_integer($size, $i) | subtract(100, $i, $j)", "j", "CAST(100 - size AS VARCHAR)")


def setops(name: str, expression: str, sql: str) -> None:
    sets = [(1, ("seg_bin", "B", "F", Query())), (2, ("nat_bin", "05", "15", Query())), (3, ("seg_bin", "FURNITURE", "MACHINERY", Query()))]
    query(name, CUSTOMERS + ", s1 AS (SELECT key FROM c WHERE seg BETWEEN 'B' AND 'F'), s2 AS (SELECT key FROM c WHERE nat2 BETWEEN '05' AND '15'), s3 AS (SELECT key FROM c WHERE seg BETWEEN 'FURNITURE' AND 'MACHINERY')\n" + f"SELECT key FROM ({sql})")(lambda s, d: store(s, d, "customer").multi_index_fold("customer", sets, expression))


setops("setop_union", "$1 UNION $2", "SELECT key FROM s1 UNION SELECT key FROM s2")
setops("setop_intersect", "$1 INTERSECT $2", "SELECT key FROM s1 INTERSECT SELECT key FROM s2")
setops("setop_subtract", "$2 SUBTRACT $1", "SELECT key FROM s2 EXCEPT SELECT key FROM s1")
setops("setop_missing", "$1 UNION $9", "SELECT DISTINCT key FROM s1")
setops("setop_prec", "$1 UNION $2 INTERSECT $3 SUBTRACT $2 SUBTRACT $1", "SELECT key FROM s1 UNION (SELECT key FROM s2 INTERSECT (SELECT key FROM s3 EXCEPT (SELECT key FROM s2 EXCEPT SELECT key FROM s1)))")


@query("multi_index", CUSTOMERS + "SELECT key FROM (SELECT key FROM c WHERE seg = 'BUILDING' AND nat LIKE '1%' INTERSECT SELECT key FROM c WHERE k BETWEEN 3 AND 18)")
def _(s, d):
    first = Query('delim($term, "|", ($n, $seg, $nat))', '$seg = "BUILDING" AND begins_with($nat, "1")')
    return store(s, d, "customer").multi_index_fold("customer", [(1, ("cust_bin", "A", "Z", first)), (2, ("nation_int", 3, 18, Query()))], "$1 INTERSECT $2")


# Aggregates and trees


@query("bucket_stats", "SELECT CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS total_size, count(text) AS n_objects FROM documents")
def _(s, d):
    return store(s, d, "documents").bucket_stats("documents")


@query("count_heads", EVENTS + "SELECT count(*) AS n FROM live")
def _(s, d):
    return store(s, d, "events").head_fold().agg(F.count("*").alias("n"))


@query("minmax_keys", EVENTS + "SELECT 'events' AS bucket, min(key) AS lo, max(key) AS hi FROM live UNION ALL SELECT 'customer', lpad(CAST(min(c_custkey) AS VARCHAR), 10, '0'), lpad(CAST(max(c_custkey) AS VARCHAR), 10, '0') FROM customer")
def _(s, d):
    return store(s, d, "events", "customer").head_fold().groupBy("bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))


@query("head_xor", LINES + "SELECT bit_xor(obj_hash) AS x, count(*) AS n FROM h")
def _(s, d):
    return store(s, d, "lines").head_fold("h").agg(F.bit_xor("obj_hash").alias("x"), F.count("*").alias("n"))


def leaf_sql(text: str) -> tuple[str, str]:
    return f"(({hex_of(text, 5, 8)} & 65535) << 16) + {hex_of(text, 1, 4)}", hex_of(text, 13, 8)


def tree_sql(rows: str, text: str, hashed: str, width: int) -> str:
    h32, alt = leaf_sql(text)
    return f"SELECT segment, bit_xor(h) AS hash FROM (SELECT ({h32}) & {width * 256 - 1} AS segment, xor({alt}, {hashed}) AS h FROM {rows}) GROUP BY segment HAVING bit_xor(h) <> 0"


ORDERS_HASHED = ORDERS.rstrip() + f", oh AS (SELECT *, {hex_of('value', 1, 8)} AS obj_hash FROM o)\n"
ORDER_TREE = tree_sql("oh", "'orders' || key", "obj_hash", 64)


@query("tictac_obj", ORDERS_HASHED + ORDER_TREE)
def _(s, d):
    return tictac.of_objects(store(s, d, "orders"), "o", "orders", "xsmall")


@query("tictac_idx", ORDERS + tree_sql("o WHERE term BETWEEN '1994' AND '1997'", "'orders' || key", hex_of("term", 1, 8), 256))
def _(s, d):
    return tictac.of_index(store(s, d, "orders"), "orders", "order_bin", "1994", "1997", "small")


@query("tictac_root", ORDERS_HASHED + f"SELECT CAST(floor(segment / 256) AS BIGINT) AS branch, bit_xor(hash) AS hash FROM ({ORDER_TREE}) GROUP BY 1")
def _(s, d):
    return tictac.branches(tictac.of_objects(store(s, d, "orders"), "o", "orders", "xsmall"))


@query("tictac_merge", ORDERS_HASHED + ORDER_TREE)
def _(s, d):
    st = store(s, d, "orders")
    low = tictac.of_objects(st, "o", "orders", "xsmall", ("0000000000", "0000000499"))
    return tictac.merge(low, tictac.of_objects(st, "o", "orders", "xsmall", ("0000000500", None)))


@query("tictac_diff", ORDERS_HASHED + tree_sql("oh WHERE value = '5-LOW'", "'orders' || key", "obj_hash", 64).replace(", bit_xor(h) AS hash", ""))
def _(s, d):
    st = store(s, d, "orders")
    whole = tictac.of_objects(st, "o", "orders", "xsmall")
    less = Store(st.journal.filter("value <> '5-LOW'"), NOW)
    return tictac.diff(whole, tictac.of_objects(less, "o", "orders", "xsmall"))


ORDER_SEG = hex_of("'orders' || key", 1, 4)


@query("count_guess", ORDERS + f"SELECT CAST(count(*) * 32 AS BIGINT) AS n_estimate FROM o WHERE ({ORDER_SEG} & 32767) % 1024 < 32")
def _(s, d):
    return tictac.count_estimate(store(s, d, "orders"), "o", 32, 1024)


@query("count_estimate", ORDERS + f"SELECT CAST(count(*) * 2 AS BIGINT) AS n_estimate FROM o WHERE ({ORDER_SEG} & 32767) % 256 < 128")
def _(s, d):
    return tictac.count_estimate(store(s, d, "orders"), "o", 128, 256)


def order_keys(s: SparkSession, d: str) -> DataFrame:
    return store(s, d, "orders").key_list().select("key", H.segment48(F.concat("bucket", "key")).alias("x"))


@query("segment48", ORDERS + f"SELECT key, {ORDER_SEG} AS seg, {hex_of(chr(39) + 'orders' + chr(39) + ' || key', 5, 8)} AS extra, {hex_of(chr(39) + 'orders' + chr(39) + ' || key', 13, 8)} AS alt FROM o")
def _(s, d):
    return order_keys(s, d).select("key", "x.seg", "x.extra", "x.alt")


@query("segment32", ORDERS + f"SELECT key, {leaf_sql(chr(39) + 'orders' + chr(39) + ' || key')[0]} AS hash32 FROM o")
def _(s, d):
    return order_keys(s, d).select("key", H.segment32(F.col("x.seg"), F.col("x.extra")).alias("hash32"))


@query("tree_segment", ORDERS + f"SELECT key, ({leaf_sql(chr(39) + 'orders' + chr(39) + ' || key')[0]}) & {1024 * 256 - 1} AS segment FROM o")
def _(s, d):
    return order_keys(s, d).select("key", H.tree_segment(H.segment32(F.col("x.seg"), F.col("x.extra")), "medium").alias("segment"))


@query("match_segment", ORDERS + f"SELECT key FROM o WHERE ({ORDER_SEG} & 16383) = (40000 & 16383) OR ({ORDER_SEG} & 16383) < 2000")
def _(s, d):
    seg = F.col("x.seg")
    near = H.match_segment(seg, "small", F.lit(40000), "xsmall")
    return order_keys(s, d).filter(near | (seg.bitwiseAND(16383) < 2000)).select("key")


@query("adjust_segments", ORDERS + f"SELECT key FROM o WHERE ({ORDER_SEG} & 16383) BETWEEN 0 AND 999")
def _(s, d):
    wide = H.adjust_segments(list(range(1000)), "xsmall", "small")
    return order_keys(s, d).filter(F.col("x.seg").isin(wide)).select("key")


@query("segment_filter", ORDERS + f"SELECT key FROM o WHERE ({ORDER_SEG} & 16383) IN (3, 77, 5000, 16000) OR {ORDER_SEG} BETWEEN 100 AND 2999")
def _(s, d):
    wanted = H.segment_filter([3, 77, 5000, 16000], "xsmall") + H.segment_filter(list(range(100, 3000)), "small")
    return order_keys(s, d).filter(F.col("x.seg").isin(wanted)).select("key")


@query("tictac_export", ORDERS_HASHED + ORDER_TREE)
def _(s, d):
    text = tictac.export(tictac.of_objects(store(s, d, "orders"), "o", "orders", "xsmall"), "xsmall")
    return tictac.load(s, text)[0]


@query("tictac_add", ORDERS_HASHED + tree_sql(f"(SELECT key, obj_hash FROM oh UNION ALL SELECT 'new', {hex_of(chr(39) + 'v' + chr(39), 1, 8)})", "'orders' || key", "obj_hash", 64))
def _(s, d):
    return tictac.add(tictac.of_objects(store(s, d, "orders"), "o", "orders", "xsmall"), "ordersnew", "v", "xsmall")


@query("tictac_alter", ORDERS_HASHED + f"SELECT * FROM ({ORDER_TREE}) WHERE segment <> 77 UNION ALL SELECT 77, 4242")
def _(s, d):
    return tictac.alter(tictac.of_objects(store(s, d, "orders"), "o", "orders", "xsmall"), 77, 4242)


# What an application defines


def tagged(s: SparkSession, d: str, name: str, tag: Tag) -> Store:
    return Store(JOURNALS[name](s, d), now=NOW, tags=Tags({"o": tag}))


@query("tag_canonical", ORDERS_HASHED + tree_sql("oh", "reverse(key)", "obj_hash", 64))
def _(s, d):
    return tictac.of_objects(tagged(s, d, "orders", Tag(canonical=lambda row: F.reverse(row("key")))), "o", "orders", "xsmall")


@query("tag_head", EVENTS + f"SELECT key, key || '/' || size AS head FROM live WHERE key = '{USER}'")
def _(s, d):
    build = lambda row: F.concat_ws("/", row("key"), row("size").cast("string"))
    return tagged(s, d, "events", Tag(build_head=build)).head("events", USER).select("key", "head")


@query("tag_metadata", PARTS + "SELECT key, substr(name, 1, 1) AS first, CAST(length(name) AS BIGINT) AS letters FROM p")
def _(s, d):
    extract = lambda body: {"first": F.substring(body, 1, 1), "letters": F.char_length(body).cast("bigint")}
    return tagged(s, d, "part", Tag(extract_metadata=extract)).metadata("o").select("key", "first", "letters")


@query("tag_strategy", EVENTS + "SELECT j.sqn, CASE WHEN j.tomb THEN 'tomb' ELSE 'stnd' END AS kind FROM j JOIN led USING (key) WHERE j.sqn = led.sqn")
def _(s, d):
    return maintain.compact(tagged(s, d, "events", Tag(strategy="recovr"))).select("sqn", "kind")


@query("query_callables", ORDERS + "SELECT term AS term_s, key FROM o WHERE term >= '1993' AND term <= '1996' AND split_part(term, '|', 2) = 'F'")
def _(s, d):
    def status(rows: DataFrame) -> DataFrame:
        return rows.withColumn(f"{evals.PREFIX}status", A.term(F.split_part("term_s", F.lit("|"), F.lit(2)), F.lit(None).cast("bigint")))

    own = Query(status, lambda get: get("status")["s"] == "F")
    return store(s, d, "orders").index_fold("orders", "order_bin", "1993", "1996", returns=True, query=own).select("term_s", "key")


@query("combine_callable", CUSTOMERS + "SELECT key FROM c WHERE (seg BETWEEN 'B' AND 'F') <> (nat2 BETWEEN '05' AND '15')")
def _(s, d):
    either = lambda sets: sets[1].unionAll(sets[2]).groupBy("key").agg(F.count("*").alias("n")).filter("n = 1").select("key")
    sets = [(1, ("seg_bin", "B", "F", Query())), (2, ("nat_bin", "05", "15", Query()))]
    return store(s, d, "customer").multi_index_fold("customer", sets, either)


@query("partition_filter", ORDERS_HASHED + tree_sql("oh WHERE CAST(key AS BIGINT) % 3 = 0", "'orders' || key", "obj_hash", 64))
def _(s, d):
    return tictac.of_objects(store(s, d, "orders"), "o", "orders", "xsmall", keep=F.col("key").cast("bigint") % 3 == 0)


@query("return_folder", EVENTS + "SELECT key, size FROM live WHERE key BETWEEN '0000000010' AND '0000000060'")
def _(s, d):
    asked = ("foldheads_bybucket", "o", "events", ("0000000010", "0000000060"))
    return store(s, d, "events", "customer").return_folder(asked).select("key", "size")


@query(
    "best_run",
    EVENTS.replace("WITH j", "WITH RECURSIVE j", 1)
    + """, g AS (
  SELECT CAST(floor(j.sqn / 1000) AS BIGINT) AS block, 1 - CAST(sum(CASE WHEN j.sqn = led.sqn THEN j.size ELSE 0 END) AS DOUBLE) / CAST(sum(j.size) AS DOUBLE) - CAST(0.4 AS DOUBLE) AS gain
  FROM j JOIN led USING (key) WHERE NOT j.tomb GROUP BY 1
), r AS (
  SELECT block AS lo, block AS hi, gain FROM g
  UNION ALL SELECT r.lo, g.block, r.gain + g.gain FROM r JOIN g ON g.block = r.hi + 1 WHERE r.hi - r.lo < 3
), best AS (SELECT * FROM r WHERE gain > 0 ORDER BY gain DESC, lo, hi LIMIT 1)
SELECT unnest(range(lo, hi + 1)) AS block FROM best""",
)
def _(s, d):
    run = maintain.best_run(maintain.compaction_score(store(s, d, "events")))
    return s.createDataFrame([(b,) for b in run], "block bigint")
