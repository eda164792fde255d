"""Dotted document paths."""

from __future__ import annotations

import re
from typing import Any

from ..errors import QueryError

PATH = re.compile(r"^[a-zA-Z_]\w*(\.[a-zA-Z_]\w*)*$", re.ASCII)
#: Segments that no path may have.
RESERVED = {"__proto__", "constructor", "prototype"}


def parse(path: str) -> list[str]:
    if not isinstance(path, str) or not PATH.match(path):
        raise QueryError(f"Invalid path: {path}")
    parts = path.split(".")
    if RESERVED & set(parts):
        raise QueryError(f"Reserved segment in path: {path}")
    return parts


def nested(path: str, value: Any) -> dict:
    """{a: {b: value}} for the path a.b."""
    for part in reversed(parse(path)):
        value = {part: value}
    return value


def expand(doc: dict) -> dict:
    """Dotted keys become nested objects; plain objects are merged, later keys win."""
    out: dict = {}
    for key, value in doc.items():
        value = expand(value) if isinstance(value, dict) else value
        parts = [p for p in key.split(".") if p] or [key]
        at = out
        for p in parts[:-1]:
            if not isinstance(at.get(p), dict):
                at[p] = {}
            at = at[p]
        old = at.get(parts[-1])
        at[parts[-1]] = merge(old, value) if isinstance(old, dict) and isinstance(value, dict) else value
    return out


def merge(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def leaves(doc: dict, prefix: str = "") -> dict[str, Any]:
    """Leaf paths and values; empty objects and arrays are leaves."""
    out: dict[str, Any] = {}
    for k, v in doc.items():
        path = f"{prefix}.{k}" if prefix else k
        if isinstance(v, dict) and v:
            out |= leaves(v, path)
        else:
            out[path] = v
    return out


_MISSING = object()


def read(doc: Any, path: str, default: Any = None) -> Any:
    for p in path.split("."):
        doc = doc.get(p, _MISSING) if isinstance(doc, dict) else _MISSING
        if doc is _MISSING:
            return default
    return doc


def has(doc: Any, path: str) -> bool:
    return read(doc, path, _MISSING) is not _MISSING


def write(doc: dict, path: str, value: Any) -> None:
    parts = path.split(".")
    for p in parts[:-1]:
        if not isinstance(doc.get(p), dict):
            doc[p] = {}
        doc = doc[p]
    doc[parts[-1]] = value


def remove(doc: Any, path: str) -> None:
    parts = path.split(".")
    for p in parts[:-1]:
        doc = doc.get(p) if isinstance(doc, dict) else None
    if isinstance(doc, dict):
        doc.pop(parts[-1], None)
