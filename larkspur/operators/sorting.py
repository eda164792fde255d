"""Sort, skip and limit."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import paths
from ..functions.values import to_number
from .accessors import VariantAccessor
from .filters import BASE


def sort_columns(spec: Any, at: VariantAccessor) -> list[Column]:
    """-1 is descending, all else ascending; by text, NULLs last when ascending and first when descending."""
    out = []
    for path, way in (spec.items() if isinstance(spec, dict) else ()):
        root, *rest = path.split(".")
        if root in BASE and rest:
            raise QueryError(f"{path}: row columns have no paths")
        column = F.col(root) if root in BASE else at.text(paths.parse(path))
        out.append(column.desc_nulls_first() if to_number(way) == -1 else column.asc_nulls_last())
    return out


def whole(n: Any) -> int | None:
    number = None if n is None or isinstance(n, bool) else to_number(n)
    return None if number is None else math.floor(number)


def window(df: DataFrame, skip: Any, limit: Any) -> DataFrame:
    skip, limit = whole(skip), whole(limit)
    for name, n in (("limit", limit), ("skip", skip)):
        if n is not None and n < 0:
            raise QueryError(f"{name} must not be negative")
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)
