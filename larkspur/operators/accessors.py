"""How a compiler reaches values: in one VARIANT column, or in typed struct columns.

Both give the same answers; a NULL member of a struct is a missing key. Struct columns are pruned and pushed down as ordinary nested Parquet columns; where an operator needs JSON semantics (containment, keys,
elements of mixed arrays) the part of the struct under the path's root is viewed as a variant.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json as J
from ..functions.values import NUMBER_LIKE


class VariantAccessor:
    def __init__(self, data: str = "data"):
        self.data = F.col(data)

    def json(self, keys: list[str]) -> Column:
        return J.child(self.data, *keys)

    def text(self, keys: list[str], operands: list[str] | None = None) -> Column:
        return J.text(self.data, *keys) if operands is None else J.text_for(operands, self.data, *keys)

    def compare(self, keys: list[str], op: str, number: Decimal) -> Column:
        return compare_text(J.raw_text(self.data, *keys), op, number)

    def contains(self, value: dict) -> Column:
        return J.contains(self.data, value)

    def present(self, keys: list[str]) -> Column:
        return J.present(self.data, keys)


def compare_text(t: Column, op: str, number: Decimal) -> Column:
    """A stored text against a number: exact while it fits, an error if it is no number."""
    ops = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
    exact = t.try_cast(J.DECIMAL)
    fits = abs(number) < Decimal(10) ** 20
    near = ops[op](t.cast("double"), F.lit(float(number)))
    return F.when(exact.isNotNull(), ops[op](exact, F.lit(number.quantize(Decimal(1).scaleb(-18)) if number.as_tuple().exponent < -18 else number).cast(J.DECIMAL))).otherwise(near) if fits else near


class StructAccessor(VariantAccessor):
    """data is a struct column of the given type."""

    def __init__(self, schema: T.StructType, data: str = "data"):
        self.name, self.schema = data, schema

    def _at(self, keys: list[str]) -> tuple[Column, T.DataType] | None:
        kind: T.DataType = self.schema
        for k in keys:
            if not isinstance(kind, T.StructType) or k not in kind.names:
                return None
            kind = kind[k].dataType
        return F.col(".".join([self.name, *keys])), kind

    def json(self, keys: list[str]) -> Column:
        for n in range(len(keys), 0, -1):
            found = self._at(keys[:n])
            if found:
                column, kind = found
                if isinstance(kind, T.VariantType):
                    return J.child(column, *keys[n:])
                if n < len(keys):
                    return F.lit(None).cast("variant") if not isinstance(kind, T.MapType) else J.child(F.to_variant_object(column), *keys[n:])
                return J.strip_nulls(column, kind)
        return F.lit(None).cast("variant")

    def text(self, keys: list[str], operands: list[str] | None = None) -> Column:
        found = self._at(keys)
        if found and isinstance(found[1], T.StringType):
            return found[0]
        if found and isinstance(found[1], T.BooleanType):
            return found[0].cast("string")
        if found and isinstance(found[1], T.NumericType):
            return J.number_text(found[0].cast("string"))
        return J.text(self.json(keys))

    def equals_number(self, keys: list[str], operand: str) -> Column | None:
        """Equality of canonical texts is equality of numbers on a numeric column, and can be pushed down."""
        found = self._at(keys)
        if found and isinstance(found[1], (T.NumericType,)) and NUMBER_LIKE.match(operand):
            return found[0] == F.lit(Decimal(operand) if isinstance(found[1], (T.DecimalType, T.IntegralType)) else float(operand))
        return None

    def compare(self, keys: list[str], op: str, number: Decimal) -> Column:
        found = self._at(keys)
        if found and isinstance(found[1], T.NumericType):
            value = float(number) if isinstance(found[1], T.FractionalType) and not isinstance(found[1], T.DecimalType) else number
            return {"$gt": found[0] > F.lit(value), "$gte": found[0] >= F.lit(value), "$lt": found[0] < F.lit(value), "$lte": found[0] <= F.lit(value)}[op]
        return compare_text(J.raw_text(self.json(keys)), op, number)

    def contains(self, value: dict) -> Column:
        test = F.lit(True)
        for k, v in value.items():
            test = test & J.contains(self.json([k]), v)
        return test

    def present(self, keys: list[str]) -> Column:
        """Presence of a path of plain structs is that the column is not NULL; arrays on the way are looked into as a variant."""
        found = self._at(keys)
        return found[0].isNotNull() if found else J.present(self.json(keys[:1]), keys[1:])
