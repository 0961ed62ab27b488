"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Database
from .functions.text import segment_name
from .operators import batch
from .operators.replay import compacted, live, live_from, lookup_index, numbered, repeated, unique_violations
from .plans.request import Op, Plan, change, compile_read, selector
from .schema import DatabaseSchema
from .sources import segments
from .sources.shared import scratch
from .sources.tables import LOG_SQL, SQL, TABLES, latest, log, schema_of, table

SCHEMA = DatabaseSchema.of(*(s for s, *_ in TABLES.values()))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def read(name: str, plan: Plan, sql: str) -> None:
    """A reading plan over a table; {T} in the SQL is the table."""
    QUERIES[name] = lambda spark, sf_dir: compile_read(plan, SCHEMA, table(spark, sf_dir, plan.table))
    ORACLES[name] = sql.replace("{T}", f"({SQL[plan.table]})")


# Reading plans -------------------------------------------------------------------------------------------------------

read("get_by_id", selector.id("orders", "5"), "SELECT * FROM {T} WHERE id = '5'")
read("get_by_unique_lookup", selector.one("customers", "name", "Customer#000000042"), "SELECT * FROM {T} WHERE name = 'Customer#000000042' LIMIT 1")
read("get_missing", selector.id("orders", "-1"), "SELECT * FROM {T} WHERE id = '-1'")
read("find_first_page", Plan(Op.FIND, "orders", "status", "O"), "SELECT * FROM {T} WHERE status = 'O' ORDER BY id LIMIT 100")
read("find_page_k", Plan(Op.FIND, "messages", "role", "user", limit=17, cursor="17"), "SELECT * FROM {T} WHERE role = 'user' ORDER BY id LIMIT 17 OFFSET 17")
read("find_default_1000", selector.many("events", "kind", "click"), "SELECT * FROM {T} WHERE kind = 'click' ORDER BY id LIMIT 1000")
read("find_int_lookup", Plan(Op.FIND, "parts", "size", "7", limit=1000), "SELECT * FROM {T} WHERE size = 7 ORDER BY id LIMIT 1000")
read("find_float_lookup", Plan(Op.FIND, "parts", "retail_price", 1000.0, limit=1000), "SELECT * FROM {T} WHERE retail_price = 1000 ORDER BY id LIMIT 1000")
read("find_bool_lookup", Plan(Op.FIND, "labels", "toxic", True, limit=1000), "SELECT * FROM {T} WHERE toxic ORDER BY id LIMIT 1000")
read("find_noncanonical_key", Plan(Op.FIND, "parts", "size", "007"), "SELECT * FROM {T} WHERE size::VARCHAR = '007' ORDER BY id LIMIT 100")
read("find_id_lookup", Plan(Op.FIND, "orders", "id", "77"), "SELECT * FROM {T} WHERE id = '77'")
read("scan_page", Plan(Op.SCAN, "orders", limit=25, cursor="100"), "SELECT * FROM {T} ORDER BY id LIMIT 25 OFFSET 100")
read("scan_default", selector.all("suppliers"), "SELECT * FROM {T} ORDER BY id LIMIT 100")
read("scan_beyond_end", Plan(Op.SCAN, "orders", limit=25, cursor="10000000"), "SELECT * FROM {T} ORDER BY id LIMIT 25 OFFSET 10000000")
read("count_table", selector.count("orders"), "SELECT count(*) AS n FROM {T}")
read("count_lookup", selector.count("events", "kind", "click"), "SELECT count(*) AS n FROM {T} WHERE kind = 'click'")
read("count_id", selector.count("events", "id", "17"), "SELECT count(*) AS n FROM {T} WHERE id = '17'")


@query("page_with_cursor", f"WITH t AS ({SQL['orders']}), p AS (SELECT * FROM t WHERE status = 'F' ORDER BY id LIMIT 40 OFFSET 80) SELECT p.*, CASE WHEN 120 < (SELECT count(*) FROM t WHERE status = 'F') THEN '120' END AS next_cursor FROM p")
def page_with_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page as a DataFrame: the row beyond it only tells whether there is a next one."""
    plan = Plan(Op.FIND, "orders", "status", "F", limit=40, cursor="80")
    rows = compile_read(plan, SCHEMA, table(spark, sf_dir, "orders"), more=1)
    from pyspark.sql import Window

    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # 41 rows at most
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id"))
    return counted.withColumn("_nth", first).where("_nth <= 40").select(*rows.columns, F.when(F.col("_n") > 40, "120").alias("next_cursor"))


@query("export_order", SQL["customers"])
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customers").select(*schema_of("customers").fields).orderBy("id")


@query("app_recent_events", f"SELECT * FROM ({SQL['events']}) ORDER BY ts DESC, id LIMIT 20")
def app_recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "id").limit(20)


# Replay --------------------------------------------------------------------------------------------------------------


def replayed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from .sources.tables import LOGS

    return live(log(spark, sf_dir, name), list(LOGS[name][0].fields), latest(name))


def live_sql(name: str) -> str:
    return f"(SELECT * EXCLUDE (op, nth) FROM ({LOG_SQL[name]}) WHERE nth = 1 AND op = 'R')".replace("EXCLUDE (op, nth)", "EXCLUDE (op, nth, pos)" if " AS pos" in LOG_SQL[name] else "EXCLUDE (op, nth)")


for _key, _log in (("replay_live", "user_state"), ("replay_live_lineitem", "line_state"), ("customer_last_order", "customer_last_order")):
    QUERIES[_key] = lambda spark, sf_dir, _log=_log: replayed(spark, sf_dir, _log)
    ORACLES[_key] = f"SELECT * FROM {live_sql(_log)}"


@query("replay_count", f"SELECT count(*) AS n FROM {live_sql('line_state')}")
def replay_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(spark, sf_dir, "line_state").agg(F.count(F.lit(1)).alias("n"))


@query("replay_get", f"SELECT * FROM {live_sql('user_state')} WHERE id = '7'")
def replay_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(spark, sf_dir, "user_state").where(F.col("id") == "7").limit(1)


@query("replay_find", f"SELECT * FROM {live_sql('line_state')} WHERE flag = 'A' ORDER BY id LIMIT 1000")
def replay_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(spark, sf_dir, "line_state").where(F.col("flag") == "A").orderBy("id").limit(1000)


@query("replay_find_older_versions", f"SELECT * FROM {live_sql('user_state')} WHERE value > 50 AND kind <> 'view'")
def replay_find_older_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older versions of most ids match; only the newest counts, so the predicate stays above the replay."""
    return replayed(spark, sf_dir, "user_state").where("value > 50 and kind <> 'view'")


@query("incremental_snapshot", f"SELECT * FROM {live_sql('line_state')}")
def incremental_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the log up to a date, and the operations since: the same as replaying it all."""
    from .sources.tables import LOGS

    ops, fields = log(spark, sf_dir, "line_state"), list(LOGS["line_state"][0].fields)
    early = F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz")
    return live_from(live(ops.where(early), fields, latest("line_state")), ops.where(~early), fields, latest("line_state"))


@query("repeat_ids", f"SELECT id, count(*) AS n FROM ({LOG_SQL['line_state']}) GROUP BY id HAVING count(*) > 1")
def repeat_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(log(spark, sf_dir, "line_state"))


@query("next_tx", "SELECT max(event_id) + 1 AS next_tx FROM events")
def next_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir, "user_state").agg((F.max("event_id") + 1).alias("next_tx"))


@query("compact", f"SELECT 999 + row_number() OVER (ORDER BY id) AS tx_id, 'R' AS op, * FROM {live_sql('user_state')}")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replayed(spark, sf_dir, "user_state")
    return compacted(rows, rows.columns, 1000)


@query("compact_lineitem", f"SELECT row_number() OVER (ORDER BY id) AS tx_id, 'R' AS op, * FROM {live_sql('line_state')}")
def compact_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replayed(spark, sf_dir, "line_state")
    return compacted(rows, rows.columns, 1)


@query("compaction_stats", f"SELECT (SELECT count(*) FROM {live_sql('line_state')}) AS rows_live, (SELECT count(*) FROM lineitem) AS ops_before, (SELECT count(*) FROM {live_sql('line_state')}) AS ops_after")
def compaction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = log(spark, sf_dir, "line_state")
    n = replayed(spark, sf_dir, "line_state").agg(F.count(F.lit(1)).alias("rows_live"), F.lit(1).alias("one"))
    before = ops.agg(F.count(F.lit(1)).alias("ops_before"), F.lit(1).alias("one"))
    return n.join(before, "one").select("rows_live", "ops_before", F.col("rows_live").alias("ops_after"))


# Batches: the source table as it is, changed by rules on its ids ------------------------------------------------------


def changes(rows: DataFrame, kind: str, lookup: str | None = None, key=None, **values) -> DataFrame:
    """Changes of the given rows, numbered by id; values: columns in place of the rows' own."""
    name = {"seq": F.col("id").cast("long"), "kind": F.lit(kind), "lookup": F.lit(lookup).cast("string"), "key": (key if key is not None else F.lit(None)).cast("string") if not isinstance(key, str) else F.col(key).cast("string")}
    own = {c: values.get(c, F.lit(None).cast(t) if kind in (batch.PATCH, batch.REMOVE) else F.col(c)) for c, t in rows.dtypes}
    return rows.select(*(e.alias(n) for n, e in name.items()), *(e.alias(n) for n, e in own.items()))


def after(spark: SparkSession, sf_dir: str, name: str, *parts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows, schema = table(spark, sf_dir, name), schema_of(name)
    told = [p(rows) for p in parts]
    whole = told[0]
    for t in told[1:]:
        whole = whole.unionByName(t)
    return batch.final_state(batch.resolve(whole, rows, schema), rows, schema)


N = "id::BIGINT"


@query("insert_batch", f"WITH t AS ({SQL['orders']}) SELECT * FROM t UNION ALL SELECT 'n' || id, customer_id, status, total, order_date, priority FROM t WHERE {N} % 10 = 0")
def insert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = lambda t: changes(t.where("cast(id as bigint) % 10 = 0"), batch.INSERT, id=F.concat(F.lit("n"), "id"))
    return after(spark, sf_dir, "orders", new)


@query("insert_conflicts", f"SELECT id FROM ({SQL['orders']}) WHERE {N} % 7 = 0 AND {N} > 0")
def insert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, schema = table(spark, sf_dir, "orders"), schema_of("orders")
    new = changes(rows.where("cast(id as bigint) % 7 = 0 and cast(id as bigint) > 0"), batch.INSERT).unionByName(changes(rows.where("cast(id as bigint) % 7 = 1"), batch.INSERT, id=F.concat(F.lit("x"), "id")))
    bad = batch.violations(new, batch.resolve(new, rows, schema), rows, schema)
    return bad.where("code = 'already_exists'").select(F.regexp_extract("message", "^row `(.*)` already", 1).alias("id"))


@query("upsert_batch", f"WITH t AS ({SQL['orders']}) SELECT id, customer_id, CASE WHEN {N} % 5 = 0 THEN 'X' ELSE status END AS status, total, order_date, priority FROM t UNION ALL SELECT 'n' || id, customer_id, 'X', total, order_date, priority FROM t WHERE {N} % 100 = 1")
def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = lambda t: changes(t.where("cast(id as bigint) % 5 = 0"), batch.UPSERT, status=F.lit("X"))
    new = lambda t: changes(t.where("cast(id as bigint) % 100 = 1"), batch.UPSERT, id=F.concat(F.lit("n"), "id"), status=F.lit("X"))
    return after(spark, sf_dir, "orders", old, new)


@query("patch_batch", f"SELECT id, customer_id, CASE WHEN {N} % 3 = 0 THEN 'P' ELSE status END AS status, total, order_date, CASE WHEN {N} % 3 = 0 THEN '0-NEW' ELSE priority END AS priority FROM ({SQL['orders']})")
def patch_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after(spark, sf_dir, "orders", lambda t: changes(t.where("cast(id as bigint) % 3 = 0"), batch.PATCH, "id", "id", status=F.lit("P"), priority=F.lit("0-NEW")))


@query("patch_by_unique", f"SELECT id, name, nation_id, acctbal, CASE WHEN {N} % 4 = 0 THEN 'PATCHED' ELSE segment END AS segment FROM ({SQL['customers']})")
def patch_by_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after(spark, sf_dir, "customers", lambda t: changes(t.where("cast(id as bigint) % 4 = 0"), batch.PATCH, "name", "name", segment=F.lit("PATCHED")))


@query("patch_missing", f"SELECT {N} AS seq, 'not_found' AS code FROM ({SQL['customers']}) WHERE {N} % 50 = 0")
def patch_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, schema = table(spark, sf_dir, "customers"), schema_of("customers")
    gone = rows.where("cast(id as bigint) % 50 = 0")
    told = changes(rows.where("cast(id as bigint) % 10 = 0"), batch.PATCH, "id", "id", segment=F.lit("x"))
    there = rows.join(gone, "id", "left_anti")
    return batch.violations(told, batch.resolve(told, there, schema), there, schema).select("seq", "code")


@query("remove_batch", f"SELECT * FROM ({SQL['orders']}) WHERE {N} % 4 <> 0")
def remove_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after(spark, sf_dir, "orders", lambda t: changes(t.where("cast(id as bigint) % 4 = 0"), batch.REMOVE, "id", "id"))


@query("remove_by_unique", f"SELECT * FROM ({SQL['suppliers']}) WHERE {N} % 4 <> 0")
def remove_by_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after(spark, sf_dir, "suppliers", lambda t: changes(t.where("cast(id as bigint) % 4 = 0"), batch.REMOVE, "name", "name"))


@query("delete_missing_noop", SQL["suppliers"])
def delete_missing_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after(spark, sf_dir, "suppliers", lambda t: changes(t.where("cast(id as bigint) % 4 = 0"), batch.TOMBSTONE, id=F.concat(F.lit("gone-"), "id")))


@query(
    "mixed_batch",
    f"WITH t AS ({SQL['customers']}) SELECT id, name, CASE WHEN {N} % 3 = 0 THEN '99' ELSE nation_id END AS nation_id, CASE WHEN {N} % 3 = 0 THEN 0 ELSE acctbal END AS acctbal, CASE WHEN {N} % 3 = 1 THEN 'EDITED' ELSE segment END AS segment FROM t WHERE {N} % 15 <> 2",
)
def mixed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = lambda t: changes(t.where("cast(id as bigint) % 3 = 0"), batch.UPSERT, nation_id=F.lit("99"), acctbal=F.lit(0.0))
    edit = lambda t: changes(t.where("cast(id as bigint) % 3 = 1"), batch.PATCH, "id", "id", segment=F.lit("EDITED"))
    drop = lambda t: changes(t.where("cast(id as bigint) % 15 = 2"), batch.REMOVE, "name", "name")
    # 2 modulo 15 is 2 modulo 3, so no row is touched twice.
    return after(spark, sf_dir, "customers", put, edit, drop)


SWAP = f"WITH t AS ({SQL['customers']}), s AS (SELECT id, name, row_number() OVER (ORDER BY {N}) AS r FROM t), p AS (SELECT a.id, b.name FROM s a JOIN s b ON b.r = a.r + CASE WHEN a.r % 2 = 1 THEN 1 ELSE -1 END) "


def swapped(rows: DataFrame) -> DataFrame:
    """Neighbours by number exchange their unique names."""
    s = numbered(rows.withColumn("n", F.col("id").cast("long")), ["n"], "r", 1).drop("n")
    other = s.select((F.col("r") + F.when(F.col("r") % 2 == 1, 1).otherwise(-1)).alias("r"), F.col("name").alias("new_name"))
    return changes(s.join(other, "r").drop("r"), batch.PATCH, "id", "id", name=F.col("new_name")).drop("new_name")


@query("swap_unique", SWAP + "SELECT t.id, coalesce(p.name, t.name) AS name, nation_id, acctbal, segment FROM t LEFT JOIN p USING (id)")
def swap_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after(spark, sf_dir, "customers", swapped)


@query("swap_unique_violations", "SELECT 1 AS stage, 1::BIGINT AS seq, '' AS code WHERE false")
def swap_unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, schema = table(spark, sf_dir, "customers"), schema_of("customers")
    told = swapped(rows)
    return batch.violations(told, batch.resolve(told, rows, schema), rows, schema).select("stage", "seq", "code")


@query("unique_violations", f"SELECT 'name' AS field, name AS key, count(*) AS n FROM (SELECT CASE WHEN {N} % 9 = 0 AND {N} > 0 THEN 'Customer#000000001' ELSE name END AS name FROM ({SQL['customers']})) GROUP BY name HAVING count(*) > 1")
def unique_violations_(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = after(spark, sf_dir, "customers", lambda t: changes(t.where("cast(id as bigint) % 9 = 0 and cast(id as bigint) > 0"), batch.PATCH, "id", "id", name=F.lit("Customer#000000001")))
    return unique_violations(state, schema_of("customers"))


@query("tx_numbering", f"WITH t AS (SELECT *, row_number() OVER (ORDER BY id) + 99 AS tx_id FROM ({SQL['suppliers']})) SELECT tx_id, id, strlen('R' || chr(9) || tx_id || chr(9) || id || chr(9) || name || chr(9) || nation_id || chr(9) || CASE WHEN acctbal = round(acctbal) THEN acctbal::BIGINT::VARCHAR ELSE acctbal::VARCHAR END) + 1 AS bytes_written FROM t")
def tx_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "suppliers").withColumn("op", F.lit("R")), ["id"], "tx_id", 100)
    return rows.select("tx_id", "id", batch.line_bytes(rows, schema_of("suppliers"), F.col("tx_id")).cast("long").alias("bytes_written"))


# Lookups, codec, names ------------------------------------------------------------------------------------------------

_INDEX = f"SELECT 'id' AS field, id AS key, id FROM ({SQL['orders']}) UNION ALL SELECT 'customer_id', customer_id, id FROM ({SQL['orders']}) UNION ALL SELECT 'priority', priority, id FROM ({SQL['orders']}) UNION ALL SELECT 'status', status, id FROM ({SQL['orders']})"


@query("lookup_index", _INDEX)
def lookup_index_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_index(table(spark, sf_dir, "orders"), schema_of("orders"))


@query("lookup_index_counts", f"SELECT field, key, count(*) AS n FROM ({_INDEX}) WHERE field <> 'id' GROUP BY field, key")
def lookup_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_index(table(spark, sf_dir, "orders"), schema_of("orders")).where("field <> 'id'").groupBy("field", "key").agg(F.count(F.lit(1)).alias("n"))


_ESC = "replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"


@query("encode_rows", f"SELECT 'R' || chr(9) || (id::BIGINT + 1) || chr(9) || id || chr(9) || {_ESC.format('body')} || chr(9) || {_ESC.format('lang')} || chr(9) || {_ESC.format('source')} || chr(9) || n_chars AS line FROM ({SQL['documents']})")
def encode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "documents").withColumns({"tx_id": F.col("id").cast("long") + 1, "op": F.lit("R")})
    return segments.encode(ops, schema_of("documents"))


@query("decode_roundtrip", f"SELECT id::BIGINT + 1 AS tx_id, 'R' AS op, * FROM ({SQL['documents']})")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = schema_of("documents")
    return segments.decode(encode_rows(spark, sf_dir), schema).where("problem is null").select("tx_id", "op", *schema.fields)


@query("decode_float_roundtrip", f"SELECT * FROM ({SQL['customers']})")
def decode_float_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = schema_of("customers")
    ops = table(spark, sf_dir, "customers").withColumns({"tx_id": F.lit(1), "op": F.lit("R")})
    return segments.decode(segments.encode(ops, schema), schema).where("problem is null").select(*schema.fields)


@query("segment_names", "SELECT i AS number, substr('0123456789abcdefghijklmnopqrstuvwxyz', ((46655 - i) // 1296 + 1)::INT, 1) || substr('0123456789abcdefghijklmnopqrstuvwxyz', ((46655 - i) // 36 % 36 + 1)::INT, 1) || substr('0123456789abcdefghijklmnopqrstuvwxyz', ((46655 - i) % 36 + 1)::INT, 1) AS name FROM range(46656) r(i)")
def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(36**3).select(F.col("id").alias("number"), segment_name(F.col("id")).alias("name"))


# Extensions: what the live table allows as an ordinary DataFrame -------------------------------------------------------


@query("ext_ordered_many", f"SELECT * FROM ({SQL['orders']}) WHERE customer_id = '7' ORDER BY order_date, id LIMIT 10")
def ext_ordered_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("customer_id") == "7").orderBy("order_date", "id").limit(10)


@query("ext_range_find", f"SELECT * FROM ({SQL['parts']}) WHERE size >= 10 AND size < 13")
def ext_range_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parts").where("size >= 10 and size < 13")


@query("ext_events_by_kind", f"SELECT kind, count(*) AS n, count(DISTINCT user_id) AS users FROM ({SQL['events']}) GROUP BY kind")
def ext_events_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("ext_events_by_day", f"SELECT ts // 86400000000 AS day, count(*) AS n FROM ({SQL['events']}) GROUP BY 1")
def ext_events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.expr("ts div 86400000000").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("ext_word_search", f"SELECT word, count(*) AS n FROM (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS word FROM ({SQL['messages']})) WHERE word IN ('the', 'of', 'and') GROUP BY word")
def ext_word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of words in messages' bodies, and how many rows have each of three."""
    postings = table(spark, sf_dir, "messages").select("id", F.explode(F.array_distinct(F.split(F.lower("body"), "[^a-z0-9]+"))).alias("word"))
    return postings.where(F.col("word").isin("the", "of", "and")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# Databases: tables written, changed, kept and read back through versions -----------------------------------------------


def database(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    """A new database with the tables, each loaded as one batch; in the shared folder, or a local one in local mode."""
    db = Database.open(spark, scratch(spark), f"db-{uuid.uuid4().hex}", SCHEMA)
    db.init()
    for name in names:
        db.upsert_frame(name, table(spark, sf_dir, name).select(*schema_of(name).fields))
    return db


def some(rows: DataFrame, condition: str, kind: str, lookup: str | None = None, **values) -> DataFrame:
    return changes(rows.where(condition), kind, lookup, lookup, **values)


def changed(db: Database) -> None:
    """Three batches on customers: patches by a unique name, removals, new rows."""
    rows = db.live("customers")
    db.write_frame("customers", some(rows, "cast(id as bigint) % 5 = 0", batch.PATCH, "name", segment=F.lit("PATCHED")))
    db.write_frame("customers", some(rows, "cast(id as bigint) % 7 = 1", batch.REMOVE, "id"))
    db.write_frame("customers", some(rows, "cast(id as bigint) % 50 = 3", batch.INSERT, id=F.concat(F.lit("n"), "id"), name=F.concat(F.lit("New "), "name")))


CHANGED = f"(WITH t AS ({SQL['customers']}) SELECT id, name, nation_id, acctbal, CASE WHEN {N} % 5 = 0 THEN 'PATCHED' ELSE segment END AS segment FROM t WHERE {N} % 7 <> 1 UNION ALL SELECT 'n' || id, 'New ' || name, nation_id, acctbal, segment FROM t WHERE {N} % 50 = 3)"


@query("db_write_and_read", SQL["orders"])
def db_write_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "orders").live("orders")


@query("db_batches", f"SELECT * FROM {CHANGED}")
def db_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "customers")
    changed(db)
    return db.live("customers")


@query("db_snapshot_and_delta", f"SELECT * FROM {CHANGED}")
def db_snapshot_and_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot, then the batches: reads join both."""
    db = database(spark, sf_dir, "customers")
    db.refresh_snapshot("customers")
    changed(db)
    return db.live("customers")


@query("db_damaged_snapshot", f"SELECT * FROM {CHANGED}")
def db_damaged_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot that lost a file is not believed: the log is replayed."""
    db = database(spark, sf_dir, "customers")
    changed(db)
    db.refresh_snapshot("customers")
    entry = db.store.state().tables["customers"]
    db.store.files.delete(f"{db.store_root}/{entry.snapshot}/{min(entry.snapshot_files)}")
    again = Database.open(spark, db.options.root, db.workspace, SCHEMA)
    return again.live("customers")


@query("db_compacted_log", f"SELECT next + row_number() OVER (ORDER BY id) AS tx_id, 'R' AS op, * EXCLUDE (next) FROM (SELECT c.*, (SELECT count(*) + count(*) FILTER ({N} % 5 = 0) + count(*) FILTER ({N} % 7 = 1) + count(*) FILTER ({N} % 50 = 3) FROM ({SQL['customers']})) AS next FROM {CHANGED} c)")
def db_compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after compaction: the live rows with fresh numbers after all that were given."""
    db = database(spark, sf_dir, "customers")
    changed(db)
    db.compact("customers")
    return db.log("customers")


@query("db_old_version", SQL["customers"])
def db_old_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as it was before the batches and the compaction."""
    db = database(spark, sf_dir, "customers")
    version = db.store.state().version
    changed(db)
    db.compact("customers")
    return db.live("customers", version)


@query("db_page", f"SELECT * FROM {CHANGED} WHERE segment = 'PATCHED' ORDER BY id LIMIT 25 OFFSET 50")
def db_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "customers")
    changed(db)
    return db.frame(Plan(Op.FIND, "customers", "segment", "PATCHED", limit=25, cursor="50"))


@query("db_deep_page", f"SELECT * FROM ({SQL['orders']}) ORDER BY id LIMIT 100 OFFSET 7000")
def db_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page found by its rows' numbers, as those that begin far on are."""
    from .plans import request

    rows = database(spark, sf_dir, "orders").live("orders")
    return request.numbered_page(rows, 7000, 100)


@query("db_get_each", f"SELECT * FROM {CHANGED} WHERE name IN ('Customer#000000005', 'Customer#000000008', 'New Customer#000000053', 'nobody')")
def db_get_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "customers")
    changed(db)
    return db.get_each("customers", "name", ["Customer#000000005", "Customer#000000008", "New Customer#000000053", "nobody"])


@query("db_counts", f"SELECT segment, count(*) AS n FROM {CHANGED} GROUP BY segment")
def db_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a lookup, over a table held in memory."""
    db = database(spark, sf_dir, "customers")
    changed(db)
    return db.hold("customers").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("db_append_many", f"SELECT id, name, nation_id, CASE WHEN id = '1' THEN 1.5 ELSE acctbal END AS acctbal FROM ({SQL['suppliers']}) WHERE id <> '2' UNION ALL SELECT 'x', 'Ann', '9', 0.0")
def db_append_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw operations that the driver holds: a put of a live row, a put of a new one, two tombstones, one of no row."""
    db = database(spark, sf_dir, "suppliers")
    one = db.get_by_id("suppliers", "1")
    db.append_many("suppliers", [("put", one | {"acctbal": 1.5}), ("put", {"id": "x", "name": "Ann", "nation_id": "9", "acctbal": 0.0}), ("delete", {"id": "2"}), ("delete", {"id": "none"})])
    return db.live("suppliers")


@query("db_small_batch", f"SELECT id, CASE id WHEN '3' THEN (SELECT s_name FROM supplier WHERE s_suppkey = 4) WHEN '4' THEN (SELECT s_name FROM supplier WHERE s_suppkey = 3) ELSE name END AS name, nation_id, acctbal FROM ({SQL['suppliers']}) WHERE id <> '5'")
def db_small_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that swap two unique names, and a removal by a name, as one batch that the driver holds."""
    db = database(spark, sf_dir, "suppliers")
    three, four, five = (db.get_by_id("suppliers", i)["name"] for i in "345")
    db.write_many([change.edit_id("suppliers", "3", {"name": four}), change.edit("suppliers", "name", four, {"name": three}), change.remove("suppliers", "name", five)])
    return db.live("suppliers")


@query("db_together", f"SELECT 'customers' AS source, count(*) AS n FROM ({SQL['customers']}) WHERE id <> '7' UNION ALL SELECT 'suppliers', count(*) + 1 FROM ({SQL['suppliers']})")
def db_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of two tables as one version."""
    db = database(spark, sf_dir, "customers", "suppliers")
    db.write_together([change.remove_id("customers", "7"), change.add("suppliers", {"id": "x", "name": "Ann", "nation_id": "9", "acctbal": 0.0})])
    count = lambda name: db.frame(selector.count(name)).select(F.lit(name).alias("source"), "n")
    return count("customers").union(count("suppliers"))


@query("db_segments", f"SELECT * FROM {CHANGED}")
def db_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as text segments and back."""
    db = database(spark, sf_dir, "customers")
    changed(db)
    folder = f"{db.store_root}/export"
    db.export_segments("customers", folder)
    schema = schema_of("customers")
    return live(segments.read_segments(spark, folder, schema), list(schema.fields), [F.asc("chunk"), F.desc("pos")])


@query("db_feed", f"SELECT count(*) AS operations, count(*) AS ids FROM ({SQL['suppliers']})")
def db_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed of a load and a compaction: each operation once."""
    from .streaming.watch import feed

    db = database(spark, sf_dir, "suppliers")
    db.compact("suppliers")
    folder = f"{db.store_root}-feed"
    feed(db, "suppliers", f"{folder}/operations", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/operations").agg(F.count(F.lit(1)).alias("operations"), F.count_distinct("id").alias("ids"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a log; the first page of the live rows of one role."""
    schema = schema_of("messages")
    ops = table(spark, sf_dir, "messages").withColumns({"tx_id": F.monotonically_increasing_id() + 1, "op": F.lit("R")})
    return compile_read(Plan(Op.FIND, "messages", "role", "user"), DatabaseSchema.of(schema), live(ops, list(schema.fields)))


__all__ = ["ORACLES", "QUERIES", "change", "flagship"]
