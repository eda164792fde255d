"""Spans of pattern matches as arrays of (start, end, kind, value), in code points, with built-in functions alone.

Everything here takes n log n steps in the number of spans of a text: an expression inside a lambda is computed for each element again, so what a
lambda needs is bound first (``let``), and running sums and maxima are scans of doubling steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start: int, end: int, kind: string, value: string>>"
#: Code points of a block: what lies around a place is cut from its block, as a substring counts from its string's start.
BLOCK = 4096
#: Products of sizes up to which spans are compared one by one.
FEW = 256


def none() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination (associative, such as a sum or the greatest) of an array's elements, in log n passes."""
    def all_of(v: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int"))
        return F.aggregate(steps, v, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= F.pow(F.lit(2), k).cast("int"), combine(x, F.get(acc, i - F.pow(F.lit(2), k).cast("int")))).otherwise(x)))

    return let(values, all_of)


def find(text: Column, pattern: str, kind: str, quick: Column | None = None) -> Column:
    """Leftmost non-overlapping matches. ``quick`` is a cheap condition that any text with a match meets.

    The pieces between the matches and the matches themselves give the places: each starts where the sum of what is before it ends.
    """
    def placed(hits: Column) -> Column:
        steps = F.zip_with(hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda v, gap: F.length(v) + F.length(gap))
        return F.zip_with(hits, scan(steps, lambda a, b: a + b), lambda v, end: F.struct((end - F.length(v)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), v.alias("value"))).cast(SPAN)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(text.rlike(pattern) if quick is None else quick & text.rlike(pattern), found).otherwise(none())


def clear_of(found: Column, base: Column) -> Column:
    """The spans that overlap none of base, in order of their ends.

    Few are compared one by one; else both are sorted together, each span by its end and each of base by its start, and a span is clear if no end of the base ones before it lies behind its start.
    """
    def swept(f: Column, b: Column) -> Column:
        events = F.sort_array(F.concat(
            F.transform(f, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("reach"), s.alias("span"))),
            F.transform(b, lambda s: F.struct(s["start"].alias("at"), s["end"].alias("reach"), F.lit(None).cast(SPAN[6:-1]).alias("span")))))
        return let(events, lambda e: F.transform(F.filter(
            F.zip_with(e, scan(F.transform(e, lambda x: x["reach"]), F.greatest), lambda x, reach: F.struct(x["span"].alias("span"), reach.alias("reach"))),
            lambda x: x["span"].isNotNull() & (x["reach"] <= x["span"]["start"])), lambda x: x["span"]))

    def clear(f: Column, b: Column) -> Column:
        plain = F.filter(f, lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
        return F.when(F.size(f) * F.size(b).cast("long") <= FEW, plain).otherwise(swept(f, b))

    return let(F.struct(found.alias("f"), base.alias("b")), lambda p: clear(p["f"], p["b"]))


def blocks(text: Column) -> Column:
    """text in pieces of BLOCK code points."""
    return F.transform(F.sequence(F.lit(0), F.length(text), F.lit(BLOCK)), lambda k: F.substring(text, k + 1, F.lit(BLOCK)))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive), of blocks."""
    first = F.floor(start / BLOCK).cast("int")
    long = F.array_join(F.slice(parts, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.substring(F.when(end <= (first + 1) * BLOCK, F.get(parts, first)).otherwise(long), start - first * BLOCK + 1, F.greatest(end - start, F.lit(0)))


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """text with every span (start, end) replaced by mark; overlapping ones become one."""
    def cut(parts: Column, s: Column, reach: Column) -> Column:
        # For each span the farthest end before it; those that start behind it are replaced, with what lies between.
        both = F.zip_with(s, F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1)), lambda x, at: F.struct(x["start"].alias("start"), at.alias("at"), (F.lit(0) < x["end"]).alias("on")))
        fresh = F.filter(both, lambda x: (x["start"] >= x["at"]) & x["on"])
        pieces = F.transform(fresh, lambda x: F.concat(between(parts, x["at"], x["start"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), between(parts, F.array_max(reach), F.length(text)))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    done = let(blocks(text), lambda parts: let(ordered, lambda s: let(scan(F.transform(s, lambda x: x["end"]), F.greatest), lambda reach: cut(parts, s, reach))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def listing(spans: Column, order: tuple[str, ...], by_kind: bool) -> Column:
    """``kind:start:end`` joined by commas, by kind (as in order, others after, by name) then start, or by start then kind."""
    place = lambda k: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), k), F.lit(0).cast("long")), F.lit(99).cast("long"))
    if by_kind:
        keyed = F.transform(spans, lambda s: F.struct(place(s["kind"]), s["kind"], s["start"].alias("start"), s["end"].alias("end")))
    else:
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s["kind"]), s["kind"], s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
