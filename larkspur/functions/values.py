"""How operands become text and numbers: the coercions of the query language."""

from __future__ import annotations

import math
import re
from datetime import UTC, date, datetime
from decimal import Decimal, InvalidOperation
from typing import Any

NUMBER_LIKE = re.compile(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def iso(value: datetime) -> str:
    value = value.astimezone(UTC) if value.tzinfo else value.replace(tzinfo=UTC)
    return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"


def to_text(v: Any) -> str:
    """The text that equality compares."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if math.isfinite(v) and v == int(v) and abs(v) < 1e21 else repr(v)
    if isinstance(v, Decimal):
        t = format(v, "f")
        return t.rstrip("0").rstrip(".") if "." in t else t
    if isinstance(v, datetime):
        return iso(v)
    if isinstance(v, (list, tuple, set, frozenset)):
        return ",".join("" if x is None else to_text(x) for x in v)
    if isinstance(v, dict):
        return "[object Object]"
    return v.pattern if isinstance(v, re.Pattern) else str(v)


def to_number(v: Any) -> Decimal | None:
    """The exact number an operand stands for; None if it stands for none."""
    if isinstance(v, bool):
        return Decimal(int(v))
    if isinstance(v, int):
        return Decimal(v)
    if isinstance(v, float):
        return Decimal(repr(v)) if math.isfinite(v) else None
    if isinstance(v, Decimal):
        return v if v.is_finite() else None
    if isinstance(v, (datetime, date)):
        v = v if isinstance(v, datetime) else datetime(v.year, v.month, v.day, tzinfo=UTC)
        return Decimal(round((v if v.tzinfo else v.replace(tzinfo=UTC)).timestamp() * 1000))
    if isinstance(v, str):
        t = v.strip()
        try:
            return Decimal(0) if not t else Decimal(t) if NUMBER_LIKE.match(t) else None
        except InvalidOperation:
            return None
    return None


def parse_time(v: Any) -> datetime | None:
    """A UTC time from a datetime, epoch milliseconds or ISO text."""
    try:
        if isinstance(v, bool) or v is None:
            return None
        if isinstance(v, datetime):
            return v.astimezone(UTC) if v.tzinfo else v.replace(tzinfo=UTC)
        if isinstance(v, (int, float)):
            return datetime.fromtimestamp(v / 1000, UTC)
        if isinstance(v, str):
            t = datetime.fromisoformat(v.strip().replace("Z", "+00:00"))
            return t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC)
    except (ValueError, OverflowError, OSError):
        pass
    return None


def to_json_value(v: Any) -> Any:
    """What a document stores: times as ISO text, big integers and decimals as text, bytes as a tagged object, NaN as null."""
    if isinstance(v, dict):
        return {str(k): to_json_value(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set, frozenset)):
        return [to_json_value(x) for x in v]
    if isinstance(v, datetime):
        return iso(v)
    if isinstance(v, Decimal):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return {"type": "Buffer", "data": list(v)}
    if isinstance(v, float):
        return (int(v) if v == int(v) and abs(v) < 2**53 else v) if math.isfinite(v) else None
    if isinstance(v, int) and not isinstance(v, bool) and abs(v) > 2**53:
        return str(v)
    return v
