"""The engine's queries over the shared tables, each with relational SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model.schema import Schema
from .operators.updates import Update
from .plans.query import Query

ORDERS = Schema({
    "status": str, "total_price": float, "order_date": str, "priority": str, "customer": {"key": "BigInt", "name": str, "segment": str},
    "items": [{"type": dict}], "maybe": str,
})
PARTS = Schema({"name": str, "brand": str, "type": str, "size": "Int32", "price": float, "tags": [str]})
EVENTS = Schema({"type": str, "user": float, "value": float, "props": dict, "only_purchase": float})


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rows(df: DataFrame, id: str, data, created=None) -> DataFrame:
    made = F.lit("2026-01-01T00:00:00Z").cast("timestamp") if created is None else created
    return df.select(F.col(id).cast("long").alias("id"), data.alias("data"), made.alias("created_at"), made.alias("updated_at"))


def orders(spark: SparkSession, d: str, items: bool = False, variant: bool = False) -> DataFrame:
    """Orders as struct documents (or VARIANT), with their customer, and their line items as an array."""
    o = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    parts = [
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_price"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("order_date"),
        F.col("o_orderpriority").alias("priority"), F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("customer"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("maybe"),
    ]
    if items:
        line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
        lines = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("items"))  # a few per order
        o = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        parts.append(F.col("items"))
    doc = F.struct(*parts)
    return _rows(o, "o_orderkey", F.parse_json(F.to_json(doc)) if variant else doc)


def parts(spark: SparkSession, d: str, variant: bool = False) -> DataFrame:
    p = _table(spark, d, "part")
    doc = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.split("p_name", " ").alias("tags"))
    return _rows(p, "p_partkey", F.parse_json(F.to_json(doc)) if variant else doc)


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events as VARIANT documents; a purchase has a key that others lack."""
    e = _table(spark, d, "events")
    doc = F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"), F.col("value"), F.from_json("props", "k int").alias("props"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("only_purchase"))
    return _rows(e, "event_id", F.parse_json(F.to_json(doc)), F.col("ts"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_ORDER = {"id": "id", "status": "status", "total_price": ("total_price", "double")}
_ORDER_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, o_totalprice AS total_price FROM orders JOIN customer ON o_custkey = c_custkey"
_PART = {"id": "id", "name": "name", "size": "size"}
_PART_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part"
_EVENT = {"id": "id", "type": "type"}
_EVENT_SQL = "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type FROM events"
_ITEM = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {})"


def _add(name: str, build, schema: Schema, spec: dict, columns: dict, sql: str, where: str) -> None:
    QUERIES[name] = lambda spark, d: Query(build(spark, d), schema, spec).select(**columns)
    ORACLES[name] = f"{sql} WHERE {where}"


for _name, _spec, _where in (
    ("find_all", {}, "TRUE"),
    ("find_eq_text", {"status": "O"}, "o_orderstatus = 'O'"),
    ("find_eq_number", {"total_price": {"$eq": 1000}}, "o_totalprice = 1000"),
    ("find_eq_nested", {"customer.segment": "BUILDING"}, "c_mktsegment = 'BUILDING'"),
    ("find_ne", {"status": {"$ne": "O"}}, "o_orderstatus <> 'O'"),
    ("find_missing_ne", {"maybe": {"$ne": "1-URGENT"}}, "o_orderkey % 3 = 0 AND o_orderpriority <> '1-URGENT'"),
    ("find_eq_null_literal", {"maybe": None}, "FALSE"),
    ("find_in", {"priority": {"$in": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("find_nin", {"priority": {"$nin": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    ("find_in_empty", {"status": {"$in": []}}, "FALSE"),
    ("find_nin_empty", {"maybe": {"$nin": []}}, "TRUE"),
    ("find_gt", {"total_price": {"$gt": 300000}}, "o_totalprice > 300000"),
    ("find_gte", {"total_price": {"$gte": "300000"}}, "o_totalprice >= 300000"),
    ("find_lt", {"total_price": {"$lt": 50000}}, "o_totalprice < 50000"),
    ("find_lte", {"total_price": {"$lte": 50000}}, "o_totalprice <= 50000"),
    ("find_range_and", {"total_price": {"$gte": 100000, "$lt": 200000}, "status": "F"}, "o_totalprice >= 100000 AND o_totalprice < 200000 AND o_orderstatus = 'F'"),
    ("find_bigint", {"customer.key": {"$gt": 100}}, "c_custkey > 100"),
    ("contains_nested_literal", {"customer": {"segment": "MACHINERY"}}, "c_mktsegment = 'MACHINERY'"),
    ("base_id_eq", {"id": "33"}, "o_orderkey = 33"),
    ("base_id_in", {"id": {"$in": [1, "2", 33]}}, "o_orderkey IN (1, 2, 33)"),
    ("exists_false", {"maybe": {"$exists": False}}, "o_orderkey % 3 <> 0"),
):
    _add(_name, orders, ORDERS, _spec, _ORDER, _ORDER_SQL, _where)
    if _name in ("find_eq_number", "find_eq_nested", "find_gt", "find_missing_ne", "contains_nested_literal", "exists_false"):
        _add(f"{_name}_variant", lambda s, d: orders(s, d, variant=True), ORDERS, _spec, _ORDER, _ORDER_SQL, _where)
for _name, _spec, _where in (
    ("nested_array_gt", {"items.qty": {"$gt": 45}}, _ITEM.format("l_quantity > 45")),
    ("nested_array_two_ops", {"items.qty": {"$gt": 45, "$lt": 5}}, _ITEM.format("l_quantity > 45") + " AND " + _ITEM.format("l_quantity < 5")),
    ("elem_match_object", {"items": {"$elem_match": {"qty": {"$gt": 40}, "flag": "R"}}}, _ITEM.format("l_quantity > 40 AND l_returnflag = 'R'")),
    ("elem_match_regex", {"items": {"$elem_match": {"flag": re.compile("^r", re.I)}}}, _ITEM.format("l_returnflag = 'R'")),
    ("exists_lax_array", {"items.qty": {"$exists": True}}, _ITEM.format("TRUE")),
    ("contains_array", {"items": {"$contains": [{"flag": "A", "line": 2}]}}, _ITEM.format("l_returnflag = 'A' AND l_linenumber = 2")),
    ("array_size", {"items": {"$size": 3}}, "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) = 3"),
):
    _add(_name, lambda s, d: orders(s, d, items=True), ORDERS, _spec, _ORDER, _ORDER_SQL, _where)
_add("nested_array_gt_variant", lambda s, d: orders(s, d, items=True, variant=True), ORDERS, {"items.qty": {"$gt": 45}}, _ORDER, _ORDER_SQL, _ITEM.format("l_quantity > 45"))
for _name, _spec, _where in (
    ("array_shorthand", {"tags": "widget"}, "list_contains(string_split(p_name, ' '), 'widget')"),
    ("array_all", {"tags": {"$all": ["widget", "large"]}}, "list_contains(string_split(p_name, ' '), 'widget') AND list_contains(string_split(p_name, ' '), 'large')"),
    ("array_all_empty", {"tags": {"$all": []}}, "TRUE"),
    ("elem_match_scalar", {"tags": {"$elem_match": "widget"}}, "list_contains(string_split(p_name, ' '), 'widget')"),
    ("has_key_of_array", {"tags": {"$has_key": "widget"}}, "list_contains(string_split(p_name, ' '), 'widget')"),
    ("contains_scalar_vs_array", {"tags": {"$contains": "widget"}}, "FALSE"),
    ("find_regex", {"name": {"$regex": "^[a-m]"}}, "regexp_matches(p_name, '^[a-m]')"),
    ("find_regex_i", {"name": {"$regex": "WIDGET$", "$options": "i"}}, "regexp_matches(p_name, '(?i)widget$')"),
    ("find_regex_literal", {"brand": re.compile("brand#1", re.I)}, "regexp_matches(p_brand, '(?i)brand#1')"),
    ("find_eq_int", {"size": "24"}, "p_size = 24"),
):
    _add(_name, parts, PARTS, _spec, _PART, _PART_SQL, _where)
for _name, _spec, _where in (
    ("has_key", {"props": {"$has_key": "k"}}, "props IS NOT NULL"),
    ("has_any_keys", {"props": {"$has_any_keys": ["x", "k"]}}, "props IS NOT NULL"),
    ("has_all_keys", {"props": {"$has_all_keys": ["x", "k"]}}, "FALSE"),
    ("exists_true", {"only_purchase": {"$exists": True}}, "event_type = 'purchase' AND value IS NOT NULL"),
    ("contains_object", {"props": {"$contains": {"k": 7}}}, "CAST(props ->> '$.k' AS INTEGER) = 7"),
    ("mixed_range", {"props.k": {"$gte": 50}}, "CAST(props ->> '$.k' AS INTEGER) >= 50"),
    ("base_created_range", {"created_at": {"$lt": "2024-01-02T00:00:00Z"}}, "ts < TIMESTAMP '2024-01-02 00:00:00'"),
):
    _add(_name, events, EVENTS, _spec, _EVENT, _EVENT_SQL, _where)


def nested_parts(spark: SparkSession, d: str, variant: bool = False) -> DataFrame:
    """Parts with a member that some lack, and texts with line feeds."""
    p = _table(spark, d, "part")
    sub = F.struct(F.col("p_brand").alias("a"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("b"))
    line = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("\n"))).otherwise(F.col("p_name"))
    doc = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), sub.alias("sub"), F.concat_ws("\n", "p_name", "p_brand").alias("note"), line.alias("line"))
    return _rows(p, "p_partkey", F.parse_json(F.to_json(doc)) if variant else doc)


NESTED = Schema({"name": str, "size": "Int32", "sub": {"a": str, "b": "Int32"}, "note": str, "line": str})
for _name, _spec, _where in (
    ("exists_nested_member", {"sub.b": {"$exists": True}}, "p_size % 3 = 0"),
    ("exists_not_nested_member", {"sub.b": {"$exists": False}}, "p_size % 3 <> 0"),
    ("has_key_nested_member", {"sub": {"$has_key": "b"}}, "p_size % 3 = 0"),
    ("has_all_keys_nested", {"sub": {"$has_all_keys": ["a", "b"]}}, "p_size % 3 = 0"),
    ("find_eq_number_rows", {"sub.b": 24}, "p_size = 24"),
    ("find_gt_boundary", {"size": {"$gt": 24}}, "p_size > 24"),
    ("find_gte_boundary", {"size": {"$gte": 24}}, "p_size >= 24"),
    ("regex_over_line_feed", {"note": {"$regex": "^[a-m].*1$"}}, "regexp_matches(p_name, '^[a-m]') AND p_brand LIKE '%1'"),
    ("regex_end_alone", {"line": {"$regex": "[a-z]$"}}, "p_size % 2 <> 0 AND regexp_matches(p_name, '[a-z]$')"),
):
    for _variant in (False, True):
        _add(_name + "_variant" * _variant, lambda s, d, v=_variant: nested_parts(s, d, v), NESTED, _spec, _PART, _PART_SQL, _where)


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f
    return add


@_query("count_all", "SELECT CAST(count(*) AS INTEGER) AS total_count FROM events")
def count_all(spark, d):
    return Query(events(spark, d), EVENTS).count_df()


@_query("count_filtered", "SELECT CAST(count(*) AS INTEGER) AS total_count FROM events WHERE value > 50")
def count_filtered(spark, d):
    return Query(events(spark, d), EVENTS, {"value": {"$gt": 50}}).sort({"value": 1}).limit(3).count_df()


@_query("sort_text_desc_limit", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY o_orderpriority DESC NULLS FIRST, o_orderkey LIMIT 20")
def sort_text_desc_limit(spark, d):
    return Query(orders(spark, d), ORDERS).sort({"priority": -1, "id": 1}).limit(20).df().select("id")


@_query("sort_base_skip_limit", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY o_orderkey DESC LIMIT 10 OFFSET 5")
def sort_base_skip_limit(spark, d):
    return Query(orders(spark, d), ORDERS).sort({"id": -1}).skip(5).limit(10).df().select("id")


@_query("sort_nulls", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END DESC NULLS FIRST, o_orderkey LIMIT 30")
def sort_nulls(spark, d):
    return Query(orders(spark, d), ORDERS).sort({"maybe": -1, "id": 1}).limit(30).df().select("id")


@_query("sort_number_as_text", "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part ORDER BY CAST(p_size AS VARCHAR) COLLATE \"C\", p_partkey LIMIT 50")
def sort_number_as_text(spark, d):
    return Query(parts(spark, d), PARTS).sort({"size": 1, "id": 1}).limit(50).df().select("id")


def _updated(spark, d, update: dict, **columns):
    rows = events(spark, d)
    return Query(rows.withColumn("data", Update(update).column(F.col("data")))).select(id="id", **columns)


_EVENT_ID = "SELECT CAST(event_id AS VARCHAR) AS id"


@_query("update_set_deep_merge", _EVENT_ID + ", CAST(CAST(props ->> '$.k' AS INTEGER) AS VARCHAR) AS k, 'x' AS tag, 'new' AS type FROM events")
def update_set_deep_merge(spark, d):
    return _updated(spark, d, {"$set": {"props": {"tag": "x"}}, "type": "new"}, k="props.k", tag="props.tag", type="type")


@_query("update_unset", _EVENT_ID + ", CAST(NULL AS VARCHAR) AS k, event_type AS type FROM events")
def update_unset(spark, d):
    return _updated(spark, d, {"$unset": ["props.k", "nothing.here"]}, k="props.k", type="type")


@_query("update_order", _EVENT_ID + ", 'set' AS a, CAST(NULL AS VARCHAR) AS b, CAST(NULL AS VARCHAR) AS type FROM events")
def update_order(spark, d):
    return _updated(spark, d, {"$set": {"a": "set"}, "$unset": ["b"], "$replace_roots": {"a": "old", "b": 1}}, a="a", b="b", type="type")


@_query("update_missing_parent_noop", _EVENT_ID + ", CAST(NULL AS VARCHAR) AS deep, event_type AS type FROM events")
def update_missing_parent_noop(spark, d):
    return _updated(spark, d, {"$set": {"absent.parent.deep": 1, "type.deep": 2}}, deep="absent.parent.deep", type="type")
