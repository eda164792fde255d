"""Updates compiled to one Column: ``$replace_roots``, then ``$unset``, then ``$set``, whatever the order they are given in.

Objects in ``$set`` are merged leaf by leaf; arrays and empty objects are set whole. A path whose parent is missing or no object is left alone.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import json as J
from ..functions import paths
from ..functions.values import parse_time, to_json_value

MOST = 1024
TIMES = ("created_at", "updated_at")


class Update:
    """A parsed update: replacement, paths to unset, leaves to set and row times."""

    def __init__(self, spec: dict):
        if not isinstance(spec, dict):
            raise QueryError("An update is an object")
        spec = dict(spec)
        if spec and set(spec) <= {"set", "unset", "replace_roots"}:  # what a tracker gives
            strip = lambda p: p.removeprefix("data.")
            spec = {"$replace_roots": spec.get("replace_roots", {}).get("data", spec.get("replace_roots", {})), "$unset": [strip(p) for p in spec.get("unset", []) if p != "data"], "$set": {strip(p): v for p, v in spec.get("set", {}).items()}}
        for op in spec:
            if op.startswith("$") and op not in ("$replace_roots", "$unset", "$set"):
                raise QueryError(f"Unsupported update operator: {op}")
        unset, to_set = spec.get("$unset", []), spec.get("$set", {})
        if not isinstance(unset, (list, tuple)):
            raise QueryError("$unset needs a list of paths")
        if not isinstance(to_set, dict):
            raise QueryError("$set needs an object")
        implicit = {k: v for k, v in spec.items() if not k.startswith("$")}
        merged = paths.merge(paths.expand(to_set), paths.expand(implicit))
        self.times = {k: merged.pop(k) for k in TIMES if k in merged}
        self.replace = paths.expand(spec.get("$replace_roots") or {})
        self.times = {k: self.replace.pop(k) for k in TIMES if k in self.replace} | self.times
        for k, v in self.times.items():
            if parse_time(v) is None:
                raise QueryError(f"Invalid time for {k}")
        self.unset = [".".join(paths.parse(p)) for p in unset]
        self.set = paths.leaves(merged)
        for p in self.set:
            paths.parse(p)
        if len(self.unset) + len(self.set) + bool(self.replace) > MOST:
            raise QueryError(f"An update has {MOST} changes at most")

    def __bool__(self) -> bool:
        return bool(self.replace or self.unset or self.set or self.times)

    def column(self, data: Column) -> Column:
        """The new document. Changes are applied as one tree, so each object on the way is rebuilt once."""
        doc = literal(self.replace) if self.replace else F.coalesce(data, literal({}))
        if self.unset:
            doc = _rebuild(doc, _tree(self.unset, dict.fromkeys(self.unset, _GONE)))
        if self.set:
            doc = _rebuild(doc, _tree(list(self.set), self.set))
        return doc


_GONE = object()


def _tree(order: list[str], values: dict[str, Any]) -> dict:
    """Nested dicts of the changed keys; leaves are ('leaf', value). A later path under or above an earlier one wins there."""
    top: dict = {}
    for p in order:
        at, parts = top, p.split(".")
        for k in parts[:-1]:
            if not isinstance(at.get(k), dict):
                at[k] = {}
            at = at[k]
        at[parts[-1]] = ("leaf", values[p])
    return top


def literal(value: Any) -> Column:
    return F.parse_json(F.lit(json.dumps(to_json_value(value), ensure_ascii=False)))


def _rebuild(x: Column, tree: dict) -> Column:
    """x with the tree's changes if it is an object, else x."""
    members = J.obj(x)
    gone = [k for k, v in tree.items() if not isinstance(v, dict)]
    kept = F.map_filter(members, lambda k, _: ~k.isin(gone)) if gone else members
    inner = {k: v for k, v in tree.items() if isinstance(v, dict)}
    if inner:
        def change(k: Column, v: Column) -> Column:
            out = v
            for name, sub in inner.items():
                out = F.when(k == name, _rebuild(v, sub)).otherwise(out)
            return out

        kept = F.transform_values(kept, change)
    fresh = [(k, v[1]) for k, v in tree.items() if not isinstance(v, dict) and v[1] is not _GONE]
    if fresh:
        kept = F.map_concat(kept, F.create_map(*[c for k, v in fresh for c in (F.lit(k), literal(v))]))
    return F.when(members.isNotNull(), F.to_variant_object(kept)).otherwise(x)
