"""The driver's tables as tables of this engine: integers become ids or ints, timestamps epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TableSchema


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _int(c: str) -> Column:
    return F.col(c).cast("long")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


T = TableSchema.of
#: name -> (schema, source table, {field: column})
TABLES: dict[str, tuple[TableSchema, str, dict]] = {
    "customers": (T("customers", {"name": "text", "nation_id": "id", "acctbal": "float", "segment": "text"}, ["segment", "nation_id"], ["name"]), "customer", {"id": lambda: _text("c_custkey"), "name": lambda: F.col("c_name"), "nation_id": lambda: _text("c_nationkey"), "acctbal": lambda: F.col("c_acctbal"), "segment": lambda: F.col("c_mktsegment")}),
    "orders": (T("orders", {"customer_id": "id", "status": "text", "total": "float", "order_date": "int", "priority": "text"}, ["customer_id", "status", "priority"]), "orders", {"id": lambda: _text("o_orderkey"), "customer_id": lambda: _text("o_custkey"), "status": lambda: F.col("o_orderstatus"), "total": lambda: F.col("o_totalprice"), "order_date": lambda: _micros("o_orderdate"), "priority": lambda: F.col("o_orderpriority")}),
    "messages": (T("messages", {"conversation_id": "id", "role": "text", "body": "text", "sequence": "int"}, ["conversation_id", "role"]), "conversations", {"id": lambda: F.concat(F.lpad(_text("conv_id"), 6, "0"), F.lit("-"), F.lpad(_text("turn"), 4, "0")), "conversation_id": lambda: _text("conv_id"), "role": lambda: F.col("role"), "body": lambda: F.col("text"), "sequence": lambda: F.col("turn")}),
    "events": (T("events", {"user_id": "id", "kind": "text", "value": "float", "props": "text", "ts": "int"}, ["user_id", "kind"]), "events", {"id": lambda: _text("event_id"), "user_id": lambda: _text("user_id"), "kind": lambda: F.col("event_type"), "value": lambda: F.col("value"), "props": lambda: F.col("props"), "ts": lambda: _micros("ts")}),
    "documents": (T("documents", {"body": "text", "lang": "text", "source": "text", "n_chars": "int"}, ["lang", "source"]), "documents", {"id": lambda: _text("doc_id"), "body": lambda: F.col("text"), "lang": lambda: F.col("lang"), "source": lambda: F.col("source"), "n_chars": lambda: _int("n_chars")}),
    "labels": (T("labels", {"good": "bool", "toxic": "bool"}, ["good", "toxic"]), "labels", {"id": lambda: _text("doc_id"), "good": lambda: F.col("quality") == 1, "toxic": lambda: F.col("toxic") == 1}),
    "parts": (T("parts", {"name": "text", "brand": "text", "type": "text", "size": "int", "retail_price": "float"}, ["brand", "size", "type", "retail_price"]), "part", {"id": lambda: _text("p_partkey"), "name": lambda: F.col("p_name"), "brand": lambda: F.col("p_brand"), "type": lambda: F.col("p_type"), "size": lambda: _int("p_size"), "retail_price": lambda: F.col("p_retailprice")}),
    "suppliers": (T("suppliers", {"name": "text", "nation_id": "id", "acctbal": "float"}, ["nation_id"], ["name"]), "supplier", {"id": lambda: _text("s_suppkey"), "name": lambda: F.col("s_name"), "nation_id": lambda: _text("s_nationkey"), "acctbal": lambda: F.col("s_acctbal")}),
    "pages": (T("pages", {"url": "text", "html": "text"}, [], ["url"]), "pages", {"id": lambda: _text("page_id"), "url": lambda: F.col("url"), "html": lambda: F.col("html")}),
}

#: The same in SQL, for the queries' oracles.
SQL: dict[str, str] = {
    "customers": "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_nationkey::VARCHAR AS nation_id, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer",
    "orders": "SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS customer_id, o_orderstatus AS status, o_totalprice AS total, epoch_us(o_orderdate) AS order_date, o_orderpriority AS priority FROM orders",
    "messages": "SELECT lpad(conv_id::VARCHAR, 6, '0') || '-' || lpad(turn::VARCHAR, 4, '0') AS id, conv_id::VARCHAR AS conversation_id, role, text AS body, turn AS sequence FROM conversations",
    "events": "SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS user_id, event_type AS kind, value, props, epoch_us(ts) AS ts FROM events",
    "documents": "SELECT doc_id::VARCHAR AS id, text AS body, lang, source, n_chars FROM documents",
    "labels": "SELECT doc_id::VARCHAR AS id, quality = 1 AS good, toxic = 1 AS toxic FROM labels",
    "parts": "SELECT p_partkey::VARCHAR AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size::BIGINT AS size, p_retailprice AS retail_price FROM part",
    "suppliers": "SELECT s_suppkey::VARCHAR AS id, s_name AS name, s_nationkey::VARCHAR AS nation_id, s_acctbal AS acctbal FROM supplier",
    "pages": "SELECT page_id::VARCHAR AS id, url, html FROM pages",
}


def schema_of(name: str) -> TableSchema:
    return TABLES[name][0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _, source, fields = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").select(*(c().alias(f) for f, c in fields.items()))


#: Logs with repeated ids: name -> (schema, source, {field: column}, put or delete, the log's order with the latest first)
LOGS: dict[str, tuple] = {
    "user_state": (T("user_state", {"kind": "text", "value": "float", "ts": "int"}, ["kind"]), "events", {"id": lambda: _text("user_id"), "kind": lambda: F.col("event_type"), "value": lambda: F.col("value"), "ts": lambda: _micros("ts")}, lambda: F.when(F.col("event_type") == "error", "D").otherwise("R"), ["event_id"]),
    "line_state": (T("line_state", {"part_id": "id", "quantity": "float", "price": "float", "flag": "text"}, ["part_id", "flag"]), "lineitem", {"id": lambda: F.concat(_text("l_orderkey"), F.lit("-"), _text("l_linenumber")), "part_id": lambda: _text("l_partkey"), "quantity": lambda: F.col("l_quantity"), "price": lambda: F.col("l_extendedprice"), "flag": lambda: F.col("l_returnflag")}, lambda: F.when(F.col("l_returnflag") == "R", "D").otherwise("R"), ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"]),
    "customer_last_order": (T("customer_last_order", {"order_id": "id", "status": "text", "total": "float"}, ["status"]), "orders", {"id": lambda: _text("o_custkey"), "order_id": lambda: _text("o_orderkey"), "status": lambda: F.col("o_orderstatus"), "total": lambda: F.col("o_totalprice")}, lambda: F.lit("R"), ["o_orderkey"]),
}

LOG_SQL: dict[str, str] = {
    "user_state": "SELECT user_id::VARCHAR AS id, event_type AS kind, value, epoch_us(ts) AS ts, CASE WHEN event_type = 'error' THEN 'D' ELSE 'R' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth, event_id AS pos FROM events",
    "line_state": "SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, l_partkey::VARCHAR AS part_id, l_quantity AS quantity, l_extendedprice AS price, l_returnflag AS flag, CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'R' END AS op, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS nth FROM lineitem",
    "customer_last_order": "SELECT o_custkey::VARCHAR AS id, o_orderkey::VARCHAR AS order_id, o_orderstatus AS status, o_totalprice AS total, 'R' AS op, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nth, o_orderkey AS pos FROM orders",
}


def log(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(op, fields, and the columns of the log's order)."""
    _, source, fields, op, order = LOGS[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").select(op().alias("op"), *(c().alias(f) for f, c in fields.items()), *order)


def latest(name: str) -> list[Column]:
    return [F.desc(c) for c in LOGS[name][4]]
