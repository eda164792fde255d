"""Collections on disk: Parquet segments named by a manifest.

A write adds a segment, or replaces those that hold the changed row, and then swaps the manifest by a rename, so readers see whole versions. One writer at a time.
"""

from __future__ import annotations

import json
import re
import secrets
import time
import uuid
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelOverwriteError, QueryError, SchemaError, ValidationError, running
from ..functions import paths
from ..functions.values import parse_time, to_json_value
from ..model.schema import Schema
from ..model.tracker import BASE, Document
from ..operators.accessors import VariantAccessor
from ..operators.updates import Update
from ..plans.query import Query


def uuid7() -> str:
    n = (int(time.time() * 1000) << 80) | secrets.randbits(80)
    n = n & ~(0xF << 76) | 0x7 << 76
    return str(uuid.UUID(int=n & ~(0x3 << 62) | 0x2 << 62))


class Files:
    """Small files through the cluster's own file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.jvm, self.root = jvm, root.rstrip("/")
        self.fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def swap(self, name: str, text: str) -> None:
        new = self.path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(new)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(new, self.path(name)):  # some stores refuse to rename onto a file
            self.fs.delete(self.path(name), False)
            self.fs.rename(new, self.path(name))


    def parts(self, name: str) -> list[str]:
        """The data files of a folder, by name."""
        return sorted(f"{name}/{s.getPath().getName()}" for s in self.fs.listStatus(self.path(name)) if s.getPath().getName().endswith(".parquet"))


class Collection:
    def __init__(self, spark: SparkSession, path: str, schema: Schema | None = None, name: str = "collection"):
        self.spark, self.path, self.schema, self.name, self.files = spark, path.rstrip("/"), schema, name, Files(spark, path)

    # Reading -------------------------------------------------------------------------------------------
    @property
    def id_type(self) -> str:
        return "string" if self.schema and self.schema.id_type == "uuid" else "bigint"

    def manifest(self) -> dict:
        text = self.files.read("manifest.json")
        return json.loads(text) if text else {"segments": [], "next_id": 1, "indexes": []}

    @property
    def df(self) -> DataFrame:
        segments = [f"{self.path}/{s}" for s in self.manifest()["segments"]]
        kind = f"id {self.id_type}, data variant, created_at timestamp, updated_at timestamp"
        return self.spark.read.schema(kind).parquet(*segments) if segments else self.spark.createDataFrame([], kind)

    def find(self, filter: dict | None = None) -> Query:
        return Query(self.df, self.schema, filter or {})

    def find_one(self, filter: dict | None = None) -> Document | None:
        return next(iter(Query(self.df, self.schema, filter or {}, one=True).documents()), None)

    def find_by_id(self, id: Any) -> Document | None:
        return self.find_one({"id": id})

    def count_documents(self, filter: dict | None = None) -> int:
        return self.find(filter).count()

    # Writing -------------------------------------------------------------------------------------------
    def _commit(self, manifest: dict) -> None:
        self.files.swap("manifest.json", json.dumps(manifest))

    def _write(self, df: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        df.select(F.col("id").cast(self.id_type).alias("id"), "data", "created_at", "updated_at").write.parquet(f"{self.path}/{name}")
        return name

    def ensure(self) -> None:
        """The empty collection and, with auto_index, its index definitions."""
        m = self.manifest()
        if self.schema and self.schema.auto_index:
            m["indexes"] = [i for spec in self.schema.indexes for i in index_definitions(self.name, spec)]
        self._commit(m)

    def load(self, docs: DataFrame) -> None:
        """Append a DataFrame with a data column (VARIANT, struct or JSON text) and perhaps id and times; ids are given where missing."""
        kind = docs.schema["data"].dataType.typeName()
        data = F.parse_json("data") if kind == "string" else F.col("data") if kind == "variant" else F.to_variant_object("data")
        now, m = F.current_timestamp(), self.manifest()
        out = docs.withColumn("data", data)
        for t in ("created_at", "updated_at"):
            out = out if t in docs.columns else out.withColumn(t, now)
        if "id" not in docs.columns:  # unique and increasing, with gaps: no shuffle and no single task
            out = out.withColumn("id", F.monotonically_increasing_id() + m["next_id"])
        if self.schema:
            out = out.withColumn("data", self._fitted(out))
        self._check_unique(out, m)
        with running("load"):
            segment = self._write(out)
        top = self.spark.read.parquet(f"{self.path}/{segment}").agg(F.max("id")).first()[0] if self.id_type == "bigint" else None
        self._commit(m | {"segments": [*m["segments"], segment], "next_id": max(m["next_id"], (top or 0) + 1)})

    def _fitted(self, rows: DataFrame) -> Column:
        """data as the schema has it (unknown keys gone, defaults, casts), in Arrow batches; a row that it refuses fails the load."""
        schema = self.schema

        @F.pandas_udf("string")
        def fit(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: json.dumps(to_json_value(schema.normalize(json.loads(t)))))

        return F.parse_json(fit(F.to_json("data")))

    def from_dict(self, doc: dict) -> Document:
        body = paths.expand({k: v for k, v in doc.items() if k not in ("id", "created_at", "updated_at")})
        return Document(self.schema, self.schema.normalize(body) if self.schema else body, doc.get("id"), doc.get("created_at"), doc.get("updated_at"))

    def create(self, docs: dict | list[dict]) -> Document | list[Document]:
        """Insert one document or several, in one write."""
        many = docs if isinstance(docs, list) else [docs]
        made = [self.from_dict(d) for d in many]
        self._insert(made)
        return made if isinstance(docs, list) else made[0]

    def _insert(self, made: list[Document]) -> None:
        """Give ids and times to new documents and store them, in one write; they are known and without changes afterwards."""
        if not made:
            return
        m, now = self.manifest(), datetime.now(UTC)
        rows = [(k, json.dumps(to_json_value(d.data))) for k, d in enumerate(made)]
        self._check_unique(self.spark.createDataFrame(rows, "id long, data string").withColumn("data", F.parse_json("data")), m)
        for d in made:
            if self.id_type == "string":
                d.id = (d.id or uuid7()).lower()
            elif d.id is not None:
                raise ValidationError("The collection gives the ids")
            else:
                d.id, m["next_id"] = str(m["next_id"]), m["next_id"] + 1
            d.created_at, d.updated_at = parse_time(d.created_at) or now, now
        rows = [(d.id, json.dumps(to_json_value(d.data)), d.created_at, d.updated_at) for d in made]
        df = self.spark.createDataFrame(rows, "id string, data string, created_at timestamp, updated_at timestamp").withColumn("data", F.parse_json("data"))
        with running("insert"):
            self._commit(m | {"segments": [*m["segments"], self._write(df.coalesce(1))]})
        for d in made:
            d.is_new = False
            d.rebase()

    insert_one = create

    def _check_unique(self, fresh: DataFrame, m: dict, instead: Any = None) -> None:
        """fresh: rows (data) to be written, in place of the row with the id ``instead``. One join per unique index, with the stored rows and within fresh; keys with a missing part are not compared."""
        for index in m["indexes"]:
            if not index.get("unique"):
                continue
            at = VariantAccessor("data")
            key = lambda df: df.select(F.struct(*[at.text(p.split(".")).alias(f"k{k}") for k, p in enumerate(index["paths"])]).alias("key")).where(" AND ".join(f"key.k{k} IS NOT NULL" for k in range(len(index["paths"]))))  # noqa: B023, E731
            stored = self.df if instead is None else self.df.where(F.col("id") != F.lit(instead))
            with running("unique check"):
                twice = key(fresh).groupBy("key").count().where("count > 1").select("key")
                if not twice.unionByName(key(fresh).join(key(stored), "key", "left_semi")).isEmpty():
                    raise QueryError("Duplicate key", index=index["name"])

    def _target(self, filter: dict) -> tuple[Any, str] | None:
        """The smallest matching id and the file that holds it, relative to the collection."""
        rows = Query(self.df.select("*", F.col("_metadata.file_path").alias("_file")), self.schema, filter).matching()
        with running("search for the row"):
            hit = rows.agg(F.min_by("_file", "id").alias("f"), F.min("id").alias("id")).first()
        return None if hit.id is None else (hit.id, re.findall(r"segment-[0-9a-f]{32}/.+$", hit.f)[-1])

    def _replace(self, file: str, change) -> None:
        """Write one file anew with a change. The manifest then names the other files of its segment one by one, so a bulk load is never rewritten as a whole."""
        m, segment = self.manifest(), file.split("/")[0]
        old = self.spark.read.schema(self.df.schema).parquet(f"{self.path}/{file}")
        with running("write"):
            fresh = self._write(change(old).coalesce(1))
        places = [x for s in m["segments"] for x in (self.files.parts(s) if s == segment else [s])]
        self._commit(m | {"segments": [fresh if s == file else s for s in places]})

    def update_one(self, filter: dict, update: dict) -> Document | None:
        """Change the matching document with the smallest id; the document as it is then, or None."""
        change = Update(update)
        if not change or (target := self._target(filter)) is None:
            return None
        on = F.col("id") == F.lit(target[0])
        m = self.manifest()
        if any(i.get("unique") for i in m["indexes"]):
            self._check_unique(self.df.where(on).withColumn("data", change.column(F.col("data"))), m, target[0])

        def changed(df: DataFrame) -> DataFrame:
            for t, v in change.times.items():
                df = df.withColumn(t, F.when(on, F.lit(parse_time(v))).otherwise(F.col(t)))
            return df.withColumn("data", F.when(on, change.column(F.col("data"))).otherwise(F.col("data")))

        self._replace(target[1], changed)
        return self.find_by_id(target[0])

    def delete_one(self, filter: dict) -> Document | None:
        if (target := self._target(filter)) is None:
            return None
        doc = self.find_by_id(target[0])
        self._replace(target[1], lambda df: df.where(F.col("id") != F.lit(target[0])))
        return doc

    def save(self, doc: Document) -> Document:
        """Insert a new document, or send the changes of a known one (and refresh updated_at)."""
        if doc.is_new:
            doc.data = self.schema.normalize(doc.data) if self.schema else doc.data
            self._insert([doc])
            return doc
        delta = doc.delta()
        if delta["set"] or delta["unset"]:
            Schema.validate(self.schema, doc.data) if self.schema else None
            fresh = self.update_one({"id": doc.id}, {**{"$set": {**{p.removeprefix("data."): v for p, v in delta["set"].items()}, "updated_at": datetime.now(UTC)}}, "$unset": [p.removeprefix("data.") for p in delta["unset"]]})
            if fresh is None:
                raise QueryError("The document is not stored any more", id=doc.id)
            doc.data, doc.updated_at = fresh.data, fresh.updated_at
            doc.rebase()
        return doc


def index_definitions(table: str, spec: dict, column: str = "data") -> list[dict]:
    """Named index definitions: ``True`` or ``"gin"`` is an index of a path's keys, 1 and -1 an ordered one; anything else is dropped."""
    ordered = {p: k for p, k in spec["paths"].items() if type(k) is int and k in (1, -1)}
    out = [{"name": f"idx_{table}_{column}_{p.replace('.', '_')}_gin".lower()[:63], "using": "gin", "paths": {p: 1}} for p, k in spec["paths"].items() if k is True or k == "gin"]
    if ordered:
        label = "_".join(f"{p.replace('.', '_')}_{'asc' if k == 1 else 'desc'}" for p, k in ordered.items())
        out.append({"name": f"idx_{table}_{column}_{label}_btree".lower()[:63], "using": "btree", "paths": ordered, "unique": bool(spec.get("unique"))})
    if spec.get("name") and len(out) == 1:
        out[0]["name"] = str(spec["name"])[:63]
    return out


def plural(name: str) -> str:
    name = name.lower()
    if re.search(r"[^aeiou]y$", name):
        return name[:-1] + "ies"
    return name + ("es" if re.search(r"(s|x|z|ch|sh)$", name) else "s")


class Connection:
    """A session, a folder for collections, and the models registered."""

    capabilities = {"supports_jsonpath": True, "supports_uuidv7": True}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.models = spark, root.rstrip("/"), {}
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    def model(self, name: str, schema: Schema, table: str | None = None) -> Collection:
        if name in self.models:
            if self.models[name].schema is not schema:
                raise ModelOverwriteError(f"Model {name} exists with another schema", model=name)
            return self.models[name]
        taken = sorted(m for m in schema.methods if hasattr(Document, m) or m in {*BASE, "schema", "data", "is_new"})
        if taken:
            raise SchemaError(f"Methods that documents have already: {', '.join(taken)}")
        table = table or plural(name)
        self.models[name] = Collection(self.spark, f"{self.root}/{table}", schema, table)
        return self.models[name]
