"""Lazy queries: where, sort, limit and skip, then a DataFrame, documents or a count."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import running
from ..operators.accessors import StructAccessor, VariantAccessor
from ..operators.filters import FilterCompiler
from ..operators.sorting import sort_columns, window


def accessor(df: DataFrame, data: str = "data") -> VariantAccessor:
    kind = df.schema[data].dataType
    return StructAccessor(kind, data) if isinstance(kind, T.StructType) else VariantAccessor(data)


@dataclass(frozen=True)
class Query:
    """df has id, data (VARIANT or a struct), created_at and updated_at. A later filter key replaces an earlier one."""

    rows: DataFrame
    schema: Any = None
    filter: dict | None = None
    order: dict | None = None
    most: Any = None
    first: Any = None
    one: bool = False

    def where(self, spec: dict | None) -> Query:
        return replace(self, filter={**(self.filter or {}), **(spec or {})})

    def sort(self, spec: dict) -> Query:
        return replace(self, order=spec)

    def limit(self, n: Any) -> Query:
        return replace(self, most=n)

    def skip(self, n: Any) -> Query:
        return replace(self, first=n)

    def matching(self) -> DataFrame:
        return self.rows.where(FilterCompiler(self.schema, accessor(self.rows)).compile(self.filter))

    def df(self) -> DataFrame:
        """id (text), data, created_at, updated_at."""
        out, columns = self.matching(), sort_columns(self.order, accessor(self.rows))
        out = window(out.orderBy(*columns) if columns else out, self.first, 1 if self.one else self.most)
        return out.select(F.col("id").cast("string").alias("id"), "data", "created_at", "updated_at")

    def select(self, **columns: str) -> DataFrame:
        """Scalars by path: name="path" gives text, name=("path", "type") another type."""
        at, out = accessor(self.rows), []
        for name, spec in columns.items():
            path, kind = spec if isinstance(spec, tuple) else (spec, "string")
            column = F.col(path) if path in ("id", "created_at", "updated_at") else at.text(path.split(".")) if kind == "string" else F.try_variant_get(at.json(path.split(".")), "$", kind)
            out.append(column.cast(kind).alias(name))
        return self.matching().select(*out)

    def count_df(self) -> DataFrame:
        return self.matching().agg(F.count(F.lit(1)).cast("int").alias("total_count"))

    def count(self) -> int:
        with running("count"):
            return self.count_df().first()[0]

    def documents(self) -> list:
        """Documents on the driver, normalised by the schema."""
        from ..model.tracker import Document

        with running("query"):
            rows = self.df().select("id", F.to_json("data").alias("data"), "created_at", "updated_at").collect()
        load = lambda t: self.schema.normalize(json.loads(t)) if self.schema else json.loads(t)
        return [Document(self.schema, load(r.data), r.id, r.created_at, r.updated_at, is_new=False) for r in rows]


