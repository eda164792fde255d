"""Schemas: declared paths, and what they do to documents - conform, defaults, cast, validate."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import Any

from pyspark.sql import types as T

from ..errors import SchemaError, ValidationError
from ..functions import paths
from . import fields as fd


class Schema:
    """definition: nested dicts of types, ``[type]``, ``{"type": ..., options}`` or plain objects.

    Options: id_type (``bigint`` or ``uuid``), auto_index, indexes.
    """

    def __init__(self, definition: dict, id_type: str = "bigint", auto_index: bool = True, indexes: list | None = None):
        if id_type not in ("bigint", "uuid"):
            raise SchemaError("id_type is bigint or uuid")
        if not isinstance(auto_index, bool):
            raise SchemaError("auto_index must be a boolean")
        self.definition, self.id_type, self.auto_index = definition, id_type, auto_index
        self.fields: dict[str, fd.Field] = {}
        self.aliases: dict[str, str] = {}
        self.methods: dict[str, Callable] = {}
        self.indexes: list[dict] = list(indexes or [])
        self._declare("", definition)
        self.order = sorted(self.fields, key=lambda p: (p.count("."), p))

    def _declare(self, prefix: str, spec: dict) -> None:
        for key, value in spec.items():
            path = f"{prefix}.{key}" if prefix else key
            paths.parse(path)
            if not prefix and key in ("id", "created_at", "updated_at"):
                continue
            if isinstance(value, dict) and value and fd.resolve(value.get("type")) is None and not isinstance(value.get("type"), list) and not isinstance(value.get("type"), fd.Field):
                self._declare(path, value)
                continue
            self.fields[path] = field = self.field(value)
            if (alias := field.options.get("alias")) is not None:
                paths.parse(alias)
                if alias in self.aliases or alias in definition_keys(self.definition):
                    raise SchemaError(f"Alias {alias} is taken")
                self.aliases[alias] = path
            if index := field.options.get("index"):
                self.indexes.append(self._index(path, index, bool(field.options.get("unique"))))

    @staticmethod
    def _index(path: str, index: Any, unique: bool) -> dict:
        """An index option, of its short or its long form (using, order, unique, name); an ordered one unless it says otherwise."""
        if not isinstance(index, dict):
            return {"paths": {path: index}, "unique": unique}
        kind = {"gin": "gin", "btree": index.get("order", 1)}.get(index.get("using", "btree"))
        return {"paths": {path: kind}, "unique": bool(index.get("unique", unique)), "name": index.get("name")}

    def add_method(self, name: str, function: Callable) -> Schema:
        """A method of the documents of this schema."""
        if not isinstance(name, str) or not name.isidentifier():
            raise SchemaError(f"Invalid method name: {name!r}")
        if not callable(function):
            raise SchemaError(f"Method {name} is no function")
        if name in self.methods:
            raise SchemaError(f"Method {name} exists")
        self.methods[name] = function
        return self

    def field(self, spec: Any) -> fd.Field:
        if isinstance(spec, fd.Field):
            return spec
        if isinstance(spec, list):
            if len(spec) > 1:
                raise SchemaError("An array has one type of items")
            return fd.Array(self.field(spec[0]) if spec else None)
        if isinstance(spec, dict) and spec:
            kind, options = spec["type"], {k: v for k, v in spec.items() if k not in ("type", "of")}
            if isinstance(kind, list):
                return fd.Array(self.field(kind[0]) if kind else None, **options)
            cls = fd.resolve(kind)
            of = spec.get("of")
            if cls is fd.Union:
                return fd.Union([self.field(x) for x in of or []], **options)
            if cls in (fd.Array, fd.Map):
                return cls(self.field(of) if of is not None else None, **options)
            if of is not None:
                raise SchemaError("of is for arrays, maps and unions")
            return cls(**options)
        cls = fd.resolve(dict if spec == {} else spec)
        if cls is None:
            raise SchemaError(f"Unknown type: {spec!r}")
        return cls()

    # Introspection -------------------------------------------------------------------------------------
    def path_type(self, path: str) -> fd.Field | None:
        return self.fields.get(path)

    def is_array_root(self, root: str) -> bool:
        return isinstance(self.fields.get(root), fd.Array)

    def struct_type(self) -> T.StructType:
        def build(spec: dict) -> T.StructType:
            return T.StructType([T.StructField(k, build(v) if isinstance(v, dict) else v.spark_type) for k, v in spec.items()])

        tree: dict = {}
        for path, f in self.fields.items():
            paths.write(tree, path, f)
        return build(tree)

    # Documents -----------------------------------------------------------------------------------------
    def conform(self, doc: dict) -> dict:
        """Without what is not declared."""
        out: dict = {}
        for path in self.order:
            if paths.has(doc, path):
                paths.write(out, path, copy.deepcopy(paths.read(doc, path)))
        return out

    def apply_defaults(self, doc: dict) -> dict:
        for path in self.order:
            if not paths.has(doc, path) and (d := self.fields[path].default()) is not fd.MISSING:
                parent = path.rpartition(".")[0]
                if not parent or isinstance(paths.read(doc, parent, {}), dict):
                    paths.write(doc, path, copy.deepcopy(d))
        return doc

    def cast(self, doc: dict) -> dict:
        errors = {}
        for path in self.order:
            if paths.has(doc, path):
                f = self.fields[path]
                try:
                    paths.write(doc, path, f.cast(f.apply_set(paths.read(doc, path))))
                except ValidationError as e:
                    errors[path] = e.message
        if errors:
            raise ValidationError("Cast failed", errors=errors)
        return doc

    def validate(self, doc: dict) -> dict:
        errors = {}
        for path in self.order:
            try:
                self.fields[path].validate(paths.read(doc, path, fd.MISSING))
            except ValidationError as e:
                errors[path] = e.message
        if errors:
            raise ValidationError("Validation failed", errors=errors)
        return doc

    def normalize(self, doc: dict) -> dict:
        return self.validate(self.cast(self.apply_defaults(self.conform(doc))))


def definition_keys(spec: dict) -> set[str]:
    return set(spec)
