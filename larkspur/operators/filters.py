"""Filter dictionaries compiled to one Column.

All entries are ANDed. Values decide what an entry means: a pattern is a regular expression, a dict with ``$`` keys a set of operators, another dict containment,
anything else equality of texts. Operators on a path under an array root hold if some element meets each of them.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import json as J
from ..functions import paths
from ..functions.values import iso, parse_time, to_number, to_text
from .accessors import VariantAccessor, compare_text

BASE = ("id", "created_at", "updated_at")
RANGE = ("$gt", "$gte", "$lt", "$lte")
TEXT_OPERATORS = ("$eq", "$ne", *RANGE, "$in", "$nin", "$regex")
JSON_OPERATORS = ("$contains", "$has_key", "$has_any_keys", "$has_all_keys", "$exists", "$size", "$all", "$elem_match")
UUID7 = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def every(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def is_operators(v: Any) -> bool:
    return isinstance(v, dict) and any(isinstance(k, str) and k.startswith("$") for k in v)


def as_list(v: Any) -> list:
    return list(v) if isinstance(v, (list, tuple, set, frozenset)) else [v]


def operators_of(spec: dict, allowed: tuple[str, ...]) -> list[tuple[str, Any]]:
    for op in spec:
        if op not in allowed and op != "$options":
            raise QueryError(f"Unsupported operator: {op}")
    return [(op, v) for op, v in spec.items() if op != "$options"]


# Escapes and classes of POSIX patterns, as Java spells them.
ESCAPES = {"m": r"\b(?=\w)", "M": r"\b(?<=\w)", "y": r"\b", "Y": r"\B", "Z": r"\z"}
CLASSES = {"alpha": r"\p{Alpha}", "digit": r"\d", "alnum": r"\p{Alnum}", "space": r"\s", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "blank": r"[ \t]"}


def java_pattern(text: str) -> str:
    """A POSIX pattern in Java's spelling: ``$`` is the end alone, escapes are read one by one, and what Java would read in another way is refused."""
    out, inside, k = [], False, 0
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            n = text[k + 1]
            out.append(ESCAPES[n] if not inside and n in ESCAPES else c + n)
            k += 2
            continue
        if inside and (named := re.match(r"\[:(\w+):\]", text[k:])):
            if named[1] not in CLASSES:
                raise QueryError("Unsupported class in $regex", value=named[0])
            out.append(CLASSES[named[1]])
            k += len(named[0])
            continue
        if inside and (c in "[&" and text[k : k + 2] in ("[.", "[=", "&&")):
            if text[k : k + 2] != "&&":
                raise QueryError("Unsupported class in $regex", value=text[k : k + 2])
            out.append("&\\&")
            k += 2
            continue
        if inside:
            out.append("\\[" if c == "[" else c)
            inside = c != "]"
        elif c == "[":
            head = re.match(r"\[\^?\]?", text[k:])[0]  # a bracket that comes first is itself
            out.append(head.replace("]", "\\]"))
            inside = True
            k += len(head)
            continue
        elif text.startswith("***", k):
            raise QueryError("Unsupported prefix in $regex", value=text)
        else:
            out.append(r"\z" if c == "$" else c)
        k += 1
    return "".join(out)


def pattern_of(v: Any, options: str = "") -> str:
    """A pattern for Java, from a compiled pattern or text; only the flag ``i`` counts."""
    if isinstance(v, re.Pattern):
        return ("(?is)" if v.flags & re.IGNORECASE else "(?s)") + java_pattern(v.pattern)
    return ("(?is)" if "i" in (options or "") else "(?s)") + java_pattern(str(v))


def number_operand(op: str, v: Any) -> Any:
    n = None if v is None else to_number(v)
    if n is None:
        raise QueryError(f"{op} needs a number", value=to_text(v))
    return n


def text_test(op: str, v: Any, text_of, compare, options: str = "", equals_number=None) -> Column:
    """One text operator. text_of(operands) gives the text, compare(op, number) a numeric test."""
    if op in ("$eq", "$ne"):
        t = to_text(v)
        native = equals_number(t) if equals_number else None
        same = text_of([t]) == F.lit(t) if native is None else native
        return same if op == "$eq" else ~same
    if op in RANGE:
        return compare(op, number_operand(op, v))
    if op in ("$in", "$nin"):
        items = [to_text(x) for x in as_list(v)]
        if not items:
            return F.lit(op == "$nin")
        found = text_of(items).isin(items)
        return found if op == "$in" else ~found
    if op == "$regex":
        return text_of(None).rlike(pattern_of(v, options))
    raise QueryError(f"Unsupported operator: {op}")


class FilterCompiler:
    def __init__(self, schema=None, accessor: VariantAccessor | None = None):
        self.schema, self.at = schema, accessor or VariantAccessor()

    def compile(self, spec: dict | None) -> Column:
        if spec is not None and not isinstance(spec, dict):
            raise QueryError("A filter is an object")
        return every([self.clause(path, v) for path, v in (spec or {}).items()])

    # Schema ------------------------------------------------------------------------------------------
    def field(self, path: str):
        return self.schema.path_type(path) if self.schema else None

    def is_array_root(self, keys: list[str]) -> bool:
        return bool(self.schema) and self.schema.is_array_root(keys[0])

    def cast(self, path: str, v: Any, child: bool = False) -> Any:
        field = self.field(path)
        if child:
            field = getattr(field, "of", None)
        return v if field is None or v is None else field.cast_operand(v)

    # Clauses -----------------------------------------------------------------------------------------
    def clause(self, path: str, v: Any) -> Column:
        if path.split(".")[0] in BASE:
            return self.base_clause(path, v)
        keys = paths.parse(path)
        if isinstance(v, re.Pattern):
            return self.operator(path, keys, "$regex", v, "")
        if isinstance(v, dict) and "$elem_match" in v:
            return self.elem_match(self.at.json(keys), v["$elem_match"])
        if is_operators(v):
            ops = operators_of(v, TEXT_OPERATORS + JSON_OPERATORS)
            return every([self.operator(path, keys, op, x, v.get("$options", "")) for op, x in ops])
        if isinstance(v, dict):
            return self.at.contains(paths.nested(path, v))
        if self.is_array_root(keys):
            cast = [self.cast(path, x, True) for x in v] if isinstance(v, (list, tuple)) else [self.cast(path, v, True)]
            return self.at.contains(paths.nested(path, cast))
        return self.scalar(path, keys, "$eq", v)

    def scalar(self, path: str, keys: list[str], op: str, v: Any, options: str = "") -> Column:
        if op in ("$in", "$nin"):
            v = [self.cast(path, x) for x in as_list(v)]
        elif op != "$regex":
            v = self.cast(path, v)
        native = getattr(self.at, "equals_number", None)
        return text_test(op, v, lambda o: self.at.text(keys, o), lambda o, n: self.at.compare(keys, o, n), options, (lambda t: native(keys, t)) if native else None)

    def operator(self, path: str, keys: list[str], op: str, v: Any, options: str) -> Column:
        if op in TEXT_OPERATORS:
            if len(keys) > 1 and self.is_array_root(keys):
                test = lambda e: element_test(J.child(e, *keys[1:]), op, v, options)
                return J.any_of(J.array(self.at.json(keys[:1])), test)
            return self.scalar(path, keys, op, v, options)
        x = self.at.json(keys)
        if op == "$contains":
            return self.at.contains(paths.nested(path, v))
        if op == "$has_key":
            return J.has_key(x, to_text(v))
        if op == "$has_any_keys":
            tests = [J.has_key(x, to_text(k)) for k in as_list(v)]
            return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
        if op == "$has_all_keys":
            return every([x.isNotNull(), *[J.has_key(x, to_text(k)) for k in as_list(v)]])
        if op == "$exists":
            if not isinstance(v, bool):
                raise QueryError("$exists needs a boolean")
            found = self.at.present(keys)
            return found if v else ~found
        if op == "$size":
            n = number_operand(op, v)
            return F.when(x.isNotNull(), F.size(x.cast("array<variant>")) == F.lit(int(n)) if n == int(n) else F.lit(False))
        if op == "$all":
            items = [self.cast(path, i, True) for i in as_list(v)]
            return F.when(x.isNotNull(), J.contains(x, items))
        return self.elem_match(x, v)

    def elem_match(self, x: Column, spec: Any) -> Column:
        """Some element meets all of spec."""
        if is_operators(spec):
            operators_of(spec, TEXT_OPERATORS)
        elif isinstance(spec, dict) and not spec:
            raise QueryError("$elem_match needs a condition")
        return J.any_of(J.array(x), lambda e: self.element(e, spec))

    def element(self, e: Column, spec: Any) -> Column:
        if isinstance(spec, re.Pattern):
            return element_test(e, "$regex", spec)
        if is_operators(spec):
            return every([element_test(e, op, v, spec.get("$options", "")) for op, v in operators_of(spec, TEXT_OPERATORS)])
        if isinstance(spec, dict):
            tests = []
            for path, v in spec.items():
                inner = J.child(e, *paths.parse(path))
                if isinstance(v, re.Pattern):
                    tests.append(element_test(inner, "$regex", v))
                elif is_operators(v):
                    tests += [element_test(inner, op, o, v.get("$options", "")) for op, o in operators_of(v, TEXT_OPERATORS)]
                else:
                    tests.append(element_test(inner, "$eq", v))
            return every(tests)
        return element_test(e, "$eq", spec)

    # Row columns -------------------------------------------------------------------------------------
    def base_clause(self, path: str, v: Any) -> Column:
        if "." in path:
            raise QueryError(f"{path}: row columns have no paths")
        if isinstance(v, re.Pattern) or v is None or isinstance(v, (list, tuple)):
            raise QueryError(f"Unsupported value for {path}")
        spec = v if isinstance(v, dict) else {"$eq": v}
        if not is_operators(spec) or "$options" in spec:
            raise QueryError(f"Unsupported value for {path}")
        allowed = ("$eq", "$ne", "$in", "$nin") + (() if path == "id" else RANGE)
        return every([self.base_test(path, op, x) for op, x in operators_of(spec, allowed)])

    def base_test(self, path: str, op: str, v: Any) -> Column:
        column = F.col(path)
        if op in ("$in", "$nin"):
            items = [self.base_value(path, x) for x in as_list(v)]
            if not items:
                return F.lit(op == "$nin")
            return column.isin(items) if op == "$in" else ~column.isin(items)
        value = self.base_value(path, v)
        return {"$eq": column == value, "$ne": column != value, "$gt": column > value, "$gte": column >= value, "$lt": column < value, "$lte": column <= value}[op]

    def base_value(self, path: str, v: Any) -> Column:
        if path == "id":
            if self.schema and self.schema.id_type == "uuid":
                if isinstance(v, str) and UUID7.match(v.lower()):
                    return F.lit(v.lower())
            elif isinstance(v, int) and not isinstance(v, bool) and abs(v) < 2**63:
                return F.lit(v).cast("long")
            elif isinstance(v, str) and re.fullmatch(r"\d{1,19}", v) and int(v) < 2**63:
                return F.lit(int(v)).cast("long")
            raise QueryError("Invalid id", value=to_text(v))
        t = parse_time(v)
        if t is None:
            raise QueryError(f"Invalid time for {path}", value=to_text(v))
        return F.lit(iso(t)).cast("timestamp")


def element_test(x: Column, op: str, v: Any, options: str = "") -> Column:
    return text_test(op, v, lambda operands: J.text(x) if operands is None else J.text_for(operands, x), lambda o, n: compare_text(J.raw_text(x), o, n), options)
