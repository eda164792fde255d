"""Collections, schemas and errors, on small documents."""

import json
import re
from datetime import UTC, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larkspur.errors import ModelOverwriteError, QueryError, SchemaError, ValidationError
from larkspur.functions import paths, values
from larkspur.model import fields
from larkspur.model.schema import Schema
from larkspur.model.tracker import Document
from larkspur.operators.accessors import StructAccessor, VariantAccessor
from larkspur.operators.filters import FilterCompiler, pattern_of
from larkspur.operators.updates import Update
from larkspur.plans.query import Query
from larkspur.sources.collection import Connection, index_definitions, plural, uuid7
from larkspur.streaming.filtering import filter_stream

USERS = {"user_name": {"type": str, "required": True, "index": True}, "age": {"type": float, "min": 0}, "tags": [str], "address": {"city": str, "country": str}, "orders": [{"type": dict}]}
PEOPLE = [
    {"user_name": "john", "age": 30, "tags": ["electronics", "gaming"], "address": {"city": "Miami", "country": "US"}, "orders": [{"price": 12.5, "status": "paid"}]},
    {"user_name": "jane", "age": 22, "tags": ["books"], "address": {"city": "Miami", "country": "US"}, "orders": [{"price": 8.2, "status": "paid"}]},
    {"user_name": "mark", "age": 17, "tags": ["electronics"], "address": {"city": "Tampa", "country": "US"}, "orders": [{"price": 20, "status": "pending"}]},
]


def test_life_of_a_collection(spark, tmp_path):
    db = Connection(spark, str(tmp_path))
    users = db.model("User", Schema(USERS))
    users.ensure()
    assert users.path.endswith("/users") and users.manifest()["indexes"][0]["name"] == "idx_users_data_user_name_gin"
    users.create([dict(p) for p in PEOPLE])
    names = lambda q: [d.get("user_name") for d in q.documents()]
    assert names(users.find({"age": {"$gte": 18}}).where({"address.city": "Miami"}).sort({"age": -1}).limit(10).skip(0)) == ["john", "jane"]
    assert users.find_one({"user_name": {"$regex": "jo", "$options": "i"}}).get("user_name") == "john"
    assert users.count_documents({"orders.price": {"$gt": 10}}) == 2 and users.count_documents({"tags": "electronics"}) == 2
    john = users.update_one({"user_name": "john"}, {"$set": {"age": 31, "address.city": "Orlando"}})
    assert (john.get("age"), john.get("address.city"), john.get("address.country")) == (31, "Orlando", "US")
    assert users.delete_one({"user_name": "jane"}).get("user_name") == "jane"
    assert users.find_one({"user_name": "jane"}) is None and users.count_documents() == 2
    john.set("address.city", "Naples")
    john.unset("orders")
    assert john.delta() == {"set": {"data.address.city": "Naples"}, "unset": ["data.orders"]}
    users.save(john)
    again = users.find_by_id(john.id)
    assert again.get("address.city") == "Naples" and again.get("orders") is None and again.updated_at >= again.created_at
    assert users.update_one({"user_name": "nobody"}, {"$set": {"age": 1}}) is None and users.update_one({}, {}) is None
    assert db.model("User", users.schema) is users
    with pytest.raises(ModelOverwriteError):
        db.model("User", Schema({"a": str}))
    with pytest.raises(ValidationError):
        users.create({"id": "7", "user_name": "x", "age": 1})
    with pytest.raises(ValidationError):
        users.create({"user_name": "x", "age": -1})


def test_uuid_collection_and_load(spark, tmp_path):
    db = Connection(spark, str(tmp_path))
    c = db.model("Box", Schema({"name": str}, id_type="uuid"))
    doc = c.create({"name": "a", "unknown": 1})
    assert fields.UUID7.match(doc.id) and c.find_by_id(doc.id).data == {"name": "a"} and c.path.endswith("/boxes")
    n = db.model("Row", Schema({"x": float}))
    n.load(spark.range(100).select(F.struct(F.col("id").alias("x")).alias("data")))
    n.create({"x": 1000})
    assert n.count_documents() == 101 and n.df.select("id").distinct().count() == 101


DOCS = [
    '{"user_name":"alpha","tags":["one","three"],"payload":{"profile":{"city":"Miami","country":"US"},"flags":["vip","beta"],"items":[{"sku":"A1","qty":2},{"sku":"B2","qty":0}],"score":42,"text_value":"abc","nothing":null}}',
    '{"user_name":"beta","tags":["two"],"payload":{"profile":{"country":"US"},"flags":["basic"],"items":[{"sku":"C3","qty":0}],"score":5,"text_value":"xyz"}}',
]


@pytest.mark.parametrize("spec,want", [
    ({"payload": {"$has_key": "profile"}}, ["alpha", "beta"]), ({"payload": {"$has_key": "profile.city"}}, []), ({"payload.profile": {"$has_key": "city"}}, ["alpha"]),
    ({"payload": {"$contains": {"profile": {"city": "Miami"}}}}, ["alpha"]), ({"payload": {"$contains": {"flags": ["vip"]}}}, ["alpha"]), ({"payload.profile.city": {"$exists": True}}, ["alpha"]),
    ({"payload.items": {"$elem_match": {"qty": {"$gt": 1}}}}, ["alpha"]), ({"payload.score": {"$gt": 10}}, ["alpha"]), ({"payload.missing.deep": {"$exists": True}}, []),
    ({"payload.nothing": {"$exists": True}}, ["alpha"]), ({"payload.items.sku": {"$exists": True}}, ["alpha", "beta"]), ({"payload.score": 42.0}, ["alpha"]), ({"payload.score": "42"}, ["alpha"]), ({"payload.score": {"$in": [5, 6]}}, ["beta"]),
    ({"payload": {"profile": {}}}, ["alpha", "beta"]), ({"payload.text_value": re.compile("^A", re.I)}, ["alpha"]), ({"payload.flags": {"$all": ["beta", "vip"]}}, ["alpha"]), ({"payload.flags": {"$size": 1}}, ["beta"]),
    ({"payload.flags": {"$elem_match": {"$in": ["vip"]}}}, ["alpha"]), ({"payload": {"$contains": {"score": 42}}}, ["alpha"]), ({"payload": {"$contains": {"score": "42"}}}, []), ({"payload": {"$contains": {"nothing": None}}}, ["alpha"]),
])
def test_filters_over_variants(spark, spec, want):
    rows = spark.createDataFrame(list(enumerate(DOCS)), "id long, data string").withColumn("data", F.parse_json("data")).withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
    schema = Schema({"user_name": str, "tags": [str], "payload": dict})
    assert sorted(r.n for r in Query(rows, schema, spec).select(n="user_name").collect()) == want


def test_numbers_have_one_spelling(spark):
    texts = ["30", "30.0", "12.50", "1e3", "100", "-5.00", "0.0", '"30.0"', "true", "1.5e-3"]
    rows = spark.createDataFrame([(i, f'{{"v":{t}}}') for i, t in enumerate(texts)], "id long, data string").withColumn("data", F.parse_json("data")).withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
    got = [r.v for r in Query(rows).sort({"id": 1}).df().select(F.col("id"), "data").join(Query(rows).select(id="id", v="v"), "id").orderBy(F.col("id").cast("int")).collect()]
    assert got == ["30", "30", "12.5", "1000", "100", "-5", "0", "30.0", "true", "0.0015"]
    assert [values.to_text(x) for x in (None, True, 1.0, 1.5, [1, None, "a"], {}, Decimal("2.50"))] == ["null", "true", "1", "1.5", "1,,a", "[object Object]", "2.5"]
    assert values.to_number("") == 0 and values.to_number("x") is None and values.to_number(True) == 1
    big = Query(spark.createDataFrame([(1, '{"v":9007199254740993}')], "id long, data string").withColumn("data", F.parse_json("data")).withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp()))
    assert big.where({"v": {"$gt": 9007199254740992}}).count() == 1 and big.where({"v": {"$gt": 9007199254740993}}).count() == 0


@pytest.mark.parametrize("spec", [{"a": {"$gt": "x"}}, {"a": {"$gt": None}}, {"a": {"$nope": 1}}, {"$or": []}, {"a..b": 1}, {"id": {"$gt": 1}}, {"id": re.compile("x")}, {"id.x": 1}, {"created_at": "never"}, {"a": {"$exists": 1}},
                                  {"a": {"$elem_match": {}}}, {"a": {"$elem_match": {"$contains": 1}}}, {"a": {"$size": "x"}}, {"a.constructor": 1}, {"id": "abc"}, {"updated_at": None}, {"a": {"$gt": 1, "b": 2}}])
def test_refused_filters(spec):
    with pytest.raises(QueryError):
        FilterCompiler().compile(spec)


def test_updates(spark):
    def run(doc, update):
        row = spark.createDataFrame([(doc,)], "d string").select(Update(update).column(F.parse_json("d")).cast("string").alias("x"))
        import json
        return json.loads(row.first().x)

    assert run('{"a":{"b":1,"c":2},"t":[1]}', {"$set": {"a": {"b": 9}, "t": [2, 3], "n": None}, "$unset": ["a.c"]}) == {"a": {"b": 9}, "t": [2, 3], "n": None}
    assert run('{"a":1}', {"$set": {"a.b": 1, "x.y": 2, "e": {}}}) == {"a": 1, "e": {}}
    assert run('{"a":1}', {"$replace_roots": {"z": {"y": 1}}, "$set": {"z.w": 2}}) == {"z": {"y": 1, "w": 2}}
    assert run('{"a":1}', {"set": {"data.a": 2}, "unset": ["data.b"]}) == {"a": 2}
    for bad in ({"$unset": "a"}, {"$set": 1}, {"$push": {}}, {"$set": {f"k{i}": i for i in range(1025)}}, {"$set": {"created_at": "no"}}):
        with pytest.raises(QueryError):
            Update(bad)


def test_fields_and_schema():
    s = Schema({"n": {"type": float, "min": 0, "default": 1}, "b": bool, "d": datetime, "u": {"type": "Union", "of": ["Int32", str]}, "m": {"type": "Map", "of": "Int32"}, "i": "Int32", "raw": bytes, "dec": "Decimal128", "name": {"type": str, "trim": True, "lowercase": True, "alias": "nick"}, "tags": [str], "x": {"y": str}})
    doc = s.apply_defaults(s.conform({"b": "yes", "d": "2026-02-23T12:00:00Z", "u": "7x", "m": {"k": "3"}, "i": "12", "raw": [1, 257], "dec": " 1.50 ", "name": "  ABC ", "x": {"y": 1, "z": 2}, "gone": 1}))
    doc = s.cast(doc)
    assert doc == {"n": 1, "b": True, "d": datetime(2026, 2, 23, 12, tzinfo=UTC), "u": "7x", "m": {"k": 3}, "i": 12, "raw": b"\x01\x01", "dec": "1.50", "name": "abc", "tags": None, "x": {"y": "1"}}
    assert s.validate(doc) is doc and s.is_array_root("tags") and s.aliases == {"nick": "name"} and s.struct_type()["x"].dataType.names == ["y"]
    for kind, bad in (("Int32", 1.5), ("Int32", 2**31), ("Boolean", "maybe"), ("Date", "x"), ("Number", ""), ("UUIDv7", "x"), ("Map", []), ("Array", 1), ("BigInt", 1.5), ("Decimal128", "x")):
        with pytest.raises(ValidationError):
            fields.resolve(kind)().cast(bad)
    with pytest.raises(ValidationError) as e:
        Schema({"d": datetime, "e": {"type": str, "enum": ["a"]}}).normalize({})
    assert set(e.value.errors) == {"d", "e"} and e.value.to_json()["name"] == "ValidationError"
    assert fields.UUID7.match(uuid7()) and plural("City") == "cities" and plural("Box") == "boxes"
    assert index_definitions("t", {"paths": {"a.b": 1, "c": -1}, "unique": True})[0]["name"] == "idx_t_data_a_b_asc_c_desc_btree"
    assert paths.expand({"a.b": 1, "a": {"c": 2}}) == {"a": {"b": 1, "c": 2}} and paths.leaves({"a": {"b": {}, "c": [1]}}) == {"a.b": {}, "a.c": [1]}


def test_filter_over_a_stream(spark, tmp_path):
    spark.range(10).selectExpr("id", "parse_json(concat('{\"v\":', id, '}')) AS data", "current_timestamp() AS created_at", "current_timestamp() AS updated_at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, data variant, created_at timestamp, updated_at timestamp").parquet(str(tmp_path / "in"))
    query = filter_stream(stream, {"v": {"$gte": 6}}).select("id").writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.id for r in spark.table("kept").collect()) == [6, 7, 8, 9]


def test_live_documents():
    s = Schema({"first": str, "last": {"type": str, "index": {"unique": True, "name": "by_last"}}, "address": {"city": {"type": str, "index": {"using": "gin"}}}, "n": {"type": float, "index": -1}})
    s.add_method("full_name", lambda self, sep: f"{self.get('first')}{sep}{self.get('last')}")
    for bad in ("full_name", "no name", 3):
        with pytest.raises(SchemaError):
            s.add_method(bad, print)
    with pytest.raises(SchemaError):
        s.add_method("x", None)
    doc = Document(s, {"first": "a", "last": "b", "address": {"city": "x"}})
    assert doc.full_name("-") == "a-b" and not hasattr(doc, "other")

    seen, whole = [], []
    stop = doc.watch("address.city", lambda new, old: seen.append((new, old)))
    doc.watch("address", lambda new, old: whole.append((new, old)), immediate=True)
    doc.set("first", "c")
    with doc.batch():
        doc.set("address.city", "y")
        doc.set("address.city", "z")
    assert seen == [("z", "x")] and whole == [({"city": "x"}, None), ({"city": "z"}, {"city": "x"})]
    stop()
    stop()
    doc.unset("address.city")
    assert len(seen) == 1 and whole[-1] == ({}, {"city": "z"})
    doc.reset()
    assert whole[-1] == ({"city": "x"}, {}) and doc.delta() == {"set": {}, "unset": []}

    class View:
        pass

    view = doc.bind(View())
    view.first = 7
    doc.set("last", "q")
    assert (doc.get("first"), view.first, view.last, view.id, view.address) == ("7", "7", "q", None, {"city": "x"}) and not hasattr(View(), "first")
    taken = View()
    taken.n = 1
    with pytest.raises(ValidationError):
        doc.bind(taken)

    names = [(i["name"], i["using"], bool(i.get("unique"))) for spec in s.indexes for i in index_definitions("t", spec)]
    assert names == [("by_last", "btree", True), ("idx_t_data_address_city_gin", "gin", False), ("idx_t_data_n_desc_btree", "btree", False)]
    assert index_definitions("t", {"paths": {"a": {"no": 1}}}) == []


def test_methods_must_not_hide_documents_own(spark, tmp_path):
    with pytest.raises(SchemaError):
        Connection(spark, str(tmp_path)).model("M", Schema({"a": str}).add_method("delta", print))


def test_both_accessors_agree_on_missing_members(spark):
    """A struct's NULL member is a missing key: every filter gives the same rows over structs as over the documents."""
    import itertools
    import random

    r = random.Random(6)
    maybe = lambda f: None if r.random() < 0.4 else f()
    sub = lambda: {"a": maybe(lambda: r.choice(["x", "y", "l\nm"])), "b": maybe(lambda: r.choice([1, 2, 3])), "deep": maybe(lambda: {"c": maybe(lambda: r.choice([1.5, 2.0]))})}
    docs = [{"sub": maybe(sub), "tags": maybe(lambda: [r.choice(["p", "q"]) for _ in range(r.randrange(4))]), "items": maybe(lambda: [{"k": maybe(lambda: r.randrange(5)), "s": maybe(lambda: "z")} for _ in range(r.randrange(3))]), "t": maybe(lambda: r.choice(["", "2", "a"]))} for _ in range(120)]
    kind = "sub struct<a: string, b: int, deep: struct<c: double>>, tags array<string>, items array<struct<k: int, s: string>>, t string"
    text = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, j string")
    strip = lambda d: {k: strip(v) if isinstance(v, dict) else [strip(x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for k, v in d.items() if v is not None}
    bare = spark.createDataFrame([(i, json.dumps(strip(d))) for i, d in enumerate(docs)], "id long, j string")
    typed, plain = text.select("id", F.from_json("j", kind).alias("data")).cache(), bare.select("id", F.parse_json("j").alias("data")).cache()
    paths = ("sub", "sub.a", "sub.b", "sub.deep", "sub.deep.c", "tags", "items", "items.k", "t", "none.at.all")
    specs = [{p: {"$exists": v}} for p in paths for v in (True, False)]
    specs += [{p: {op: v}} for p, (op, v) in itertools.product(("sub", "tags", "items", "sub.deep"), (("$has_key", "a"), ("$has_key", "p"), ("$has_all_keys", ["a", "b"]), ("$has_any_keys", ["c", "b"])))]
    specs += [{"sub": {"b": None}}, {"sub": {"a": "x"}}, {"sub": {"deep": {"c": 2}}}, {"items": {"$contains": [{"k": 1}]}}, {"items": {"$contains": [{"s": None}]}}, {"tags": {"$size": 2}}, {"tags": {"$size": 2.5}}, {"tags": {"$all": ["p"]}},
              {"sub.b": 2}, {"sub.b": {"$gt": 1}}, {"sub.deep.c": 2}, {"sub.a": {"$regex": "l.m"}}, {"items": {"$elem_match": {"k": {"$gte": 2}}}}, {"sub.a": {"$ne": "x"}}]
    sides = [df.select(*[F.coalesce(FilterCompiler(None, a).compile(s), F.lit(False)).alias(f"f{k}") for k, s in enumerate(specs)]).collect() for df, a in ((typed, StructAccessor(typed.schema["data"].dataType)), (plain, VariantAccessor()))]
    for k, spec in enumerate(specs):
        assert [x[k] for x in sides[0]] == [x[k] for x in sides[1]], spec
    assert sum(x[0] for x in sides[0]) > 20


def test_patterns_read_as_posix(spark):
    texts = ["a\nb", "axb\n", "axb", "A.B", "word", "x[y", "r&s", "tab\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hits = lambda p, o="": [r.t for r in df.where(F.col("t").rlike(pattern_of(p, o))).collect()]
    assert hits("a.b") == ["a\nb", "axb\n", "axb"] and hits("xb$") == ["axb"] and hits("a.b", "i") == ["a\nb", "axb\n", "axb", "A.B"]
    assert hits(r"\mwo") == ["word"] and hits(r"d\M") == ["word"] and hits("x[[]y") == ["x[y"] and hits("[&&]") == ["r&s"] and hits("^[[:alpha:]]+$") == ["axb", "word"]
    assert hits(r"\.") == ["A.B"] and hits(r"[[:blank:]]$") == ["tab\t"] and hits("[]x]") == ["axb\n", "axb", "x[y"] and hits(r"a\$") == []
    for bad in ("[[.a.]]", "[[:nonsense:]]", "***=x"):
        with pytest.raises(QueryError):
            pattern_of(bad)


def test_saving_unique_keys_and_errors(spark, tmp_path):
    db = Connection(spark, str(tmp_path))
    users = db.model("U", Schema({"name": {"type": str, "index": {"unique": True}}, "n": float}))
    users.ensure()
    doc = users.from_dict({"name": "a", "n": 1})
    assert users.save(doc) is doc and doc.id and not doc.is_new and doc.delta() == {"set": {}, "unset": []}
    doc.set("n", 2)
    users.save(doc)
    users.save(doc)
    assert users.count_documents() == 1 and users.find_by_id(doc.id).get("n") == 2
    for write in (lambda: users.create({"name": "a"}), lambda: users.create([{"name": "b"}, {"name": "b"}]), lambda: users.load(spark.createDataFrame([('{"name": "a"}',)], "data string"))):
        with pytest.raises(QueryError, match="Duplicate"):
            write()
    users.create({"name": "b"})
    with pytest.raises(QueryError, match="Duplicate"):
        users.update_one({"name": "b"}, {"$set": {"name": "a"}})
    assert users.update_one({"name": "b"}, {"$set": {"name": "b", "n": 5}}).get("n") == 5 and users.count_documents() == 2
    users.load(spark.createDataFrame([('{"name": "c", "n": "7", "unknown": 1}',)], "data string"))
    assert users.find_one({"name": "c"}).data == {"name": "c", "n": 7}
    with pytest.raises(QueryError):
        users.load(spark.createDataFrame([('{"name": "d", "n": "no number"}',)], "data string"))
    users.delete_one({"id": doc.id})
    doc.set("n", 3)
    with pytest.raises(QueryError):
        users.save(doc)
    loose = db.model("Loose", Schema({"x": dict}))
    loose.create([{"x": {"v": "text"}}, {"x": {"v": 5}}])
    with pytest.raises(QueryError) as e:
        loose.find({"x.v": {"$gt": 4}}).count()
    assert e.value.to_json()["statement"] == "count" and e.value.__cause__ is not None


def test_a_change_rewrites_one_file_of_a_bulk_load(spark, tmp_path):
    rows = Connection(spark, str(tmp_path)).model("Row", Schema({"k": float}))
    rows.load(spark.range(400).select(F.to_json(F.struct(F.col("id").alias("k"))).alias("data")).repartition(4))
    before = set(rows.files.parts(rows.manifest()["segments"][0]))
    rows.update_one({"k": 7}, {"$set": {"k": -7}})
    rows.delete_one({"k": 300})
    kept = set(rows.manifest()["segments"]) & before
    assert len(before) == 4 and len(kept) >= 2 and rows.count_documents() == 399 and rows.find_one({"k": -7}) is not None and rows.find_one({"k": 300}) is None
