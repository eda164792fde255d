"""Documents that know what has changed in them."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from ..errors import ValidationError
from ..functions import paths
from .schema import Schema

#: Row columns beside the data.
BASE = ("id", "created_at", "updated_at")


class Document:
    """One document with its row columns. Changes through set(), unset() and replace() make the delta that update() sends.

    The schema's methods are methods of the document.
    """

    def __init__(self, schema: Schema | None, data: dict, id: str | None = None, created_at: Any = None, updated_at: Any = None, is_new: bool = True):
        self.schema, self.data, self.id, self.created_at, self.updated_at, self.is_new = schema, data, id, created_at, updated_at, is_new
        self._watchers: list[list] = []
        self._held = 0
        self.rebase()

    def __getattr__(self, name: str) -> Any:
        schema = self.__dict__.get("schema")
        if schema is None or name not in schema.methods:
            raise AttributeError(name)
        return schema.methods[name].__get__(self)

    def _path(self, path: str) -> str:
        return self.schema.aliases.get(path, path) if self.schema else path

    def get(self, path: str, default: Any = None) -> Any:
        return getattr(self, path) if path in BASE else paths.read(self.data, self._path(path), default)

    def set(self, path: str, value: Any) -> None:
        if path == "id":
            raise ValidationError("id is read-only")
        if path in ("created_at", "updated_at"):
            setattr(self, path, value)
            return
        path = self._path(path)
        field = self.schema.path_type(path) if self.schema else None
        paths.write(self.data, path, field.cast(field.apply_set(value)) if field else value)
        self._notify()

    def unset(self, path: str) -> None:
        paths.remove(self.data, self._path(path))
        self._notify()

    def replace(self, data: dict) -> None:
        self.data = data
        self._notify()

    def watch(self, path: str, callback: Callable[[Any, Any], None], immediate: bool = False) -> Callable[[], None]:
        """callback(new, old) whenever the value at path (or below it) has changed; within batch() once, at its end. Returns what stops it."""
        entry = [self._path(path), callback, copy.deepcopy(self.get(path))]
        self._watchers.append(entry)
        if immediate:
            callback(copy.deepcopy(entry[2]), None)
        return lambda: self._watchers.remove(entry) if any(w is entry for w in self._watchers) else None

    @contextmanager
    def batch(self) -> Iterator[Document]:
        """Watchers hear of the changes within it together."""
        self._held += 1
        try:
            yield self
        finally:
            self._held -= 1
            self._notify()

    def _notify(self) -> None:
        if self._held:
            return
        for entry in list(self._watchers):
            path, callback, old = entry
            new = paths.read(self.data, path)
            if new != old or type(new) is not type(old):
                entry[2] = copy.deepcopy(new)
                callback(copy.deepcopy(new), old)

    def bind(self, target: Any) -> Any:
        """target with live properties of this document's root fields and row columns; a name that target has already is an error."""
        roots = dict.fromkeys([*BASE, *(p.split(".")[0] for p in (self.schema.fields if self.schema else self.data))])
        for name in roots:
            if hasattr(target, name):
                raise ValidationError(f"bind: target has a field {name}")
        forward = {n: property(lambda _, n=n: self.get(n), lambda _, v, n=n: self.set(n, v)) for n in roots}
        target.__class__ = type(type(target).__name__, (type(target),), forward)
        return target

    def rebase(self) -> None:
        """What is now is the state that changes are counted from."""
        self._base = copy.deepcopy(self.data)

    def reset(self) -> None:
        self.data = copy.deepcopy(self._base)
        self._notify()

    def delta(self) -> dict:
        """The smallest set of changes from the base: {"set": {path: value}, "unset": [path]}; what was changed back is not in it."""
        to_set: dict = {}
        unset: list[str] = []

        def walk(old: dict, new: dict, prefix: str) -> None:
            for k in old.keys() - new.keys():
                unset.append(prefix + k)
            for k, v in new.items():
                if k in old and isinstance(v, dict) and isinstance(old[k], dict):
                    walk(old[k], v, f"{prefix}{k}.")
                elif k not in old or old[k] != v or type(old[k]) is not type(v):
                    to_set[prefix + k] = copy.deepcopy(v)

        walk(self._base, self.data, "data.")
        return {"set": to_set, "unset": sorted(unset)}
