"""Field types: casting and checking of single values, and the Spark type each has in struct collections."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

from ..errors import SchemaError, ValidationError
from ..functions.values import NUMBER_LIKE, parse_time, to_number, to_text

UUID7 = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
#: Values that booleans are read from; both sets may be changed.
TRUE: set = {True, "true", 1, "1", "yes"}
FALSE: set = {False, "false", 0, "0", "no"}
MISSING = object()


def refuse(kind: str, v: Any) -> ValidationError:
    return ValidationError(f"Cannot cast {to_text(v)!r} to {kind}")


class Field:
    name, spark_type = "Mixed", T.VariantType()

    def __init__(self, **options: Any):
        self.options = options
        self.required: Any = options.get("required", False)
        self.validator: Callable | None = options.get("validate")

    def default(self) -> Any:
        d = self.options.get("default", MISSING)
        return d() if callable(d) else d

    def apply_set(self, v: Any) -> Any:
        return self.options["set"](v) if self.options.get("set") else v

    def convert(self, v: Any) -> Any:
        return v

    def cast(self, v: Any) -> Any:
        return None if v is None else self.convert(v)

    def cast_operand(self, v: Any) -> Any:
        return self.cast(v)

    def check(self, v: Any) -> None:
        """The type's own rules; v may be MISSING."""

    def validate(self, v: Any) -> None:
        if self.validator is not None:
            ok = self.validator(None if v is MISSING else v)
            if ok is False:
                raise ValidationError("Validation failed")
        self.check(v)

    def normalize(self, v: Any) -> Any:
        """Setter, cast, required and checks: what each item of an array goes through."""
        v = self.cast(self.apply_set(v))
        if v is None and (self.required() if callable(self.required) else self.required):
            raise ValidationError("A value is required")
        if v is not None:
            self.validate(v)
        return v


class String(Field):
    name, spark_type = "String", T.StringType()

    def convert(self, v: Any) -> str:
        if isinstance(v, (list, tuple, dict, set)):
            raise refuse(self.name, v)
        v = to_text(v)
        v = v.strip() if self.options.get("trim") else v
        v = v.lower() if self.options.get("lowercase") else v
        return v.upper() if self.options.get("uppercase") else v

    def check(self, v: Any) -> None:
        o, t = self.options, None if v is MISSING else v
        if "match" in o and (t is None or not re.search(o["match"], t)):
            raise ValidationError("Value does not match")
        if "enum" in o and t not in o["enum"]:
            raise ValidationError("Value is not one of those allowed")
        if "minLength" in o and (t is None or len(t) < o["minLength"]):
            raise ValidationError("Value is too short")
        if "maxLength" in o and t is not None and len(t) > o["maxLength"]:
            raise ValidationError("Value is too long")


class Number(Field):
    name, spark_type = "Number", T.DoubleType()

    def number(self, v: Any) -> Decimal:
        n = None if isinstance(v, (list, tuple, dict)) or isinstance(v, str) and not v.strip() else to_number(v)
        if n is None:
            raise refuse(self.name, v)
        return n

    def convert(self, v: Any) -> Any:
        n = self.number(v)
        return int(n) if n == n.to_integral_value() and abs(n) < 2**53 else float(n)

    def check(self, v: Any) -> None:
        o, n = self.options, None if v is MISSING else v
        if "enum" in o and n not in o["enum"]:
            raise ValidationError("Value is not one of those allowed")
        if n is not None and ("min" in o and n < o["min"] or "max" in o and n > o["max"]):
            raise ValidationError("Value is out of range")


class Double(Number):
    name = "Double"

    def cast(self, v: Any) -> Any:
        return None if v is None or isinstance(v, str) and not v.strip() else self.convert(v)


class Int32(Double):
    name, spark_type = "Int32", T.IntegerType()

    def convert(self, v: Any) -> int:
        n = self.number(v)
        if n != n.to_integral_value() or not -(2**31) <= n < 2**31:
            raise refuse(self.name, v)
        return int(n)


class BigInt(Number):
    name, spark_type = "BigInt", T.DecimalType(38, 0)

    def convert(self, v: Any) -> int:
        n = self.number(v)
        if n != n.to_integral_value():
            raise refuse(self.name, v)
        return int(n)


class Decimal128(Field):
    name, spark_type = "Decimal128", T.DecimalType(38, 18)

    def convert(self, v: Any) -> str:
        t = v.strip() if isinstance(v, str) else to_text(v)
        if isinstance(v, (bool, list, dict)) or isinstance(v, float) and not math.isfinite(v) or not NUMBER_LIKE.match(t):
            raise refuse(self.name, v)
        return t


class Date(Field):
    name, spark_type = "Date", T.TimestampType()

    def convert(self, v: Any) -> datetime:
        t = parse_time(v)
        if t is None:
            raise refuse(self.name, v)
        return t

    def check(self, v: Any) -> None:
        if not isinstance(v, datetime):
            raise ValidationError("Value is not a date")
        for key, wrong in (("min", lambda a, b: a < b), ("max", lambda a, b: a > b)):
            if key in self.options and wrong(v, parse_time(self.options[key])):
                raise ValidationError("Value is out of range")


class Boolean(Field):
    name, spark_type = "Boolean", T.BooleanType()

    def convert(self, v: Any) -> bool:
        if isinstance(v, (bool, int, float, str)):
            if v in TRUE:
                return True
            if v in FALSE:
                return False
        raise refuse(self.name, v)


class UUIDv7(Field):
    name, spark_type = "UUIDv7", T.StringType()

    def convert(self, v: Any) -> str:
        if not isinstance(v, str) or not UUID7.match(v.lower()):
            raise refuse(self.name, v)
        return v.lower()


class Buffer(Field):
    name, spark_type = "Buffer", T.BinaryType()

    def convert(self, v: Any) -> bytes:
        if isinstance(v, dict) and v.get("type") == "Buffer":
            v = v.get("data")
        if isinstance(v, (bytes, bytearray)):
            return bytes(v)
        if isinstance(v, str):
            return v.encode()
        if isinstance(v, int) and not isinstance(v, bool):
            return bytes([v & 255])
        if isinstance(v, (list, tuple)):
            return bytes(int(x) & 255 for x in v)
        raise refuse(self.name, v)


class Mixed(Field):
    pass


class Array(Field):
    name = "Array"

    def __init__(self, of: Field | None = None, **options: Any):
        super().__init__(**options)
        self.of = of or Mixed()
        self.spark_type = T.ArrayType(self.of.spark_type)

    def default(self) -> Any:
        d = super().default()
        return None if d is MISSING else d

    def convert(self, v: Any) -> list:
        if not isinstance(v, (list, tuple)):
            raise refuse(self.name, v)
        return [self.of.normalize(x) for x in v]


class Map(Field):
    name = "Map"

    def __init__(self, of: Field | None = None, **options: Any):
        super().__init__(**options)
        self.of = of or Mixed()
        self.spark_type = T.MapType(T.StringType(), self.of.spark_type)

    def convert(self, v: Any) -> dict:
        if not isinstance(v, dict) or not all(isinstance(k, str) for k in v):
            raise refuse(self.name, v)
        return {k: self.of.normalize(x) for k, x in v.items()}


class Union(Field):
    name = "Union"

    def __init__(self, of: list[Field], **options: Any):
        super().__init__(**options)
        if not of:
            raise SchemaError("A union needs types")
        self.of_all = of

    def convert(self, v: Any) -> Any:
        kinds = {"String": str, "Boolean": bool, "Date": datetime, "Buffer": bytes, "Array": list, "Map": dict}
        last: Exception = refuse(self.name, v)
        for f in self.of_all:
            exact = isinstance(v, (int, float)) and not isinstance(v, bool) if f.name in ("Number", "Double", "Int32", "BigInt") else isinstance(v, kinds.get(f.name, ()))
            if exact:
                try:
                    f.validate(v)
                    return v
                except ValidationError as e:
                    last = e
        for f in self.of_all:
            try:
                out = f.cast(f.apply_set(v))
                f.validate(out)
                return out
            except ValidationError as e:
                last = e
        raise last


REGISTRY: dict[Any, type[Field]] = {}


def register(name: str, cls: type[Field], aliases: tuple = ()) -> None:
    for key in (name, cls, *aliases):
        REGISTRY[key] = cls


def resolve(key: Any) -> type[Field] | None:
    try:
        return REGISTRY.get(key)
    except TypeError:
        return None


for _cls, _aliases in ((String, (str,)), (Number, (float,)), (Date, (datetime,)), (Boolean, (bool,)), (UUIDv7, ()), (Buffer, (bytes,)), (Mixed, (dict,)), (Array, (list,)), (Map, ()), (Decimal128, (Decimal,)), (BigInt, (int,)), (Double, ()), (Int32, ()), (Union, ())):
    register(_cls.name, _cls, _aliases)
