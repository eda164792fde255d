"""The same filters over streams: a compiled filter is a Column, so it applies to streaming rows as to stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.filters import FilterCompiler
from ..plans.query import accessor


def filter_stream(rows: DataFrame, spec: dict, schema=None) -> DataFrame:
    return rows.where(FilterCompiler(schema, accessor(rows)).compile(spec))
