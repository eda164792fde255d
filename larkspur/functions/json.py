"""VARIANT helpers: text, number, array and object views of a JSON value."""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import NUMBER_LIKE

DECIMAL = "decimal(38,18)"


def child(x: Column, *keys: str) -> Column:
    """The value under identifier keys: NULL if missing, a variant null if JSON null."""
    return F.try_variant_get(x, "$" + "".join(f".{k}" for k in keys), "variant") if keys else x


def kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def is_number(x: Column) -> Column:
    return kind(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")


def raw_text(x: Column, *keys: str) -> Column:
    return F.try_variant_get(x, "$" + "".join(f".{k}" for k in keys), "string")


def number_text(t: Column) -> Column:
    """A number's text without trailing zeros or an exponent."""
    plain = F.when(t.contains("E"), F.coalesce(t.try_cast(DECIMAL).cast("string"), t)).otherwise(t)
    return F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")).otherwise(plain)


def text(x: Column, *keys: str) -> Column:
    """The text of a value (JSON null: NULL); numbers in one spelling."""
    raw = raw_text(x, *keys)
    return F.when(is_number(child(x, *keys)), number_text(raw)).otherwise(raw)


def text_for(operands: list[str], x: Column, *keys: str) -> Column:
    """The text to compare with operands: numbers need one spelling only where an operand looks like one."""
    return text(x, *keys) if any(NUMBER_LIKE.match(o) for o in operands) else raw_text(x, *keys)


def strip_nulls(column: Column, kind: T.DataType) -> Column:
    """A typed value as a variant without the members that are NULL: to a document they are missing, not JSON null."""
    if isinstance(kind, T.StructType):
        pairs = [F.struct(F.lit(f.name).alias("key"), strip_nulls(column.getField(f.name), f.dataType).alias("value")) for f in kind.fields]
        kept = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else F.create_map().cast("map<string,variant>")
        return F.when(column.isNotNull(), F.to_variant_object(kept))
    if isinstance(kind, T.ArrayType):
        if not has_struct(kind.elementType):
            return F.when(column.isNotNull(), F.to_variant_object(column))
        return F.when(column.isNotNull(), F.to_variant_object(F.transform(column, lambda e: strip_nulls(e, kind.elementType))))
    if isinstance(kind, (T.MapType, T.VariantType)):
        return F.when(column.isNotNull(), F.to_variant_object(column)) if isinstance(kind, T.MapType) else column
    return F.when(column.isNotNull(), F.try_variant_get(F.to_variant_object(F.struct(column.alias("v"))), "$.v", "variant"))


def has_struct(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) or isinstance(kind, T.ArrayType) and has_struct(kind.elementType)


def array(x: Column) -> Column:
    return x.try_cast("array<variant>")


def obj(x: Column) -> Column:
    return x.try_cast("map<string,variant>")


def any_of(items: Column, test) -> Column:
    """Two-valued: false for NULL arrays and unknown tests."""
    return F.coalesce(F.exists(items, test), F.lit(False))


def containing(value: Any):
    return lambda e: contains(e, value)


def contains(x: Column, value: Any) -> Column:
    """Whether a JSON value contains a literal: objects by key, arrays by element, scalars by kind and value."""
    if isinstance(value, dict):
        test = obj(x).isNotNull()
        for k, v in value.items():
            test = test & contains(F.try_element_at(obj(x), F.lit(k)), v)
    elif isinstance(value, (list, tuple)):
        test = array(x).isNotNull()
        for v in value:
            test = test & any_of(array(x), containing(v))
    elif value is None:
        test = F.is_variant_null(x)
    elif isinstance(value, bool):
        test = (kind(x) == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == value)
    elif isinstance(value, (int, float, Decimal)):
        test = is_number(x) & (F.try_variant_get(x, "$", DECIMAL) == F.lit(Decimal(str(value))).cast(DECIMAL))
    else:
        test = (kind(x) == "STRING") & (F.try_variant_get(x, "$", "string") == str(value))
    return F.coalesce(test, F.lit(False))


def has_key(x: Column, key: str) -> Column:
    """An object with the key, an array with the string, or the string itself; NULL for a missing value."""
    yes = F.coalesce(F.map_contains_key(obj(x), F.lit(key)), F.lit(False)) | any_of(array(x), lambda e: (kind(e) == "STRING") & (raw_text(e) == key)) | F.coalesce((kind(x) == "STRING") & (raw_text(x) == key), F.lit(False))
    return F.when(x.isNotNull(), yes)


def present(x: Column, keys: list[str]) -> Column:
    """Whether a path exists; arrays on the way are looked into."""
    if not keys:
        return x.isNotNull()
    direct = present(child(x, keys[0]), keys[1:])
    inside = any_of(array(x), lambda e: present(child(e, keys[0]), keys[1:]))
    return F.coalesce(direct, F.lit(False)) | inside
