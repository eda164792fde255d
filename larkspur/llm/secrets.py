"""Secret scans with multipart credential linking.

Strong findings (assignments, access identifiers, long hex) stand alone. Weak candidates - opaque strings that may be secrets, identifier
fields, endpoints - are reported only when complementary parts co-occur: an interval join pairs the parts of one text whose starts are within
``scope`` code points. Parts that can join lie in one row, so it is a sweep over the row's parts in order of their starts, and nothing is shuffled, whatever text or key repeats.

Defined results: a null text is empty and has no spans (``redact`` leaves it null); repeated rows are all kept, each with its spans; added spans never overlap strong ones; other
columns are kept, but for ``strong`` and ``linked``, which ``scan`` replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S

KINDS = ("assign", "access", "hex")
SCOPE = 300  # code points between the starts of parts that belong together
SECRET = ("secret", "assign", "hex")  # kinds that are secret parts; the others identify
LINKED = "array<struct<start: int, end: int, kind: string>>"

# The patterns of strong findings.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: The value of an assignment, which must have 8 characters or more.
VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

# Weak parts: what each may be, and a condition that is cheap to test first.
# Runs are possessive and have no upper bound: a part ends where its value ends. An opaque string may follow "=" directly (KEY=value).
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+"
IDENTIFIER = r"""(?i)\b(?:user(?:name)?|login|client_?id|access_?key(?:_?id)?|account)["']?\x20?[:=]\x20?["']?[A-Za-z0-9_.@-]{3,}+"""
ENDPOINT = r"(?i)\b(?:https?|ftp|postgres(?:ql)?|mysql|redis|amqp|mongodb|s3)://[^\s\"'<>]{4,}+"


def strong(text: Column) -> Column:
    assign = F.filter(S.find(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_replace(s["value"], VALUE, "")) >= 8)
    return F.concat(assign, S.find(text, ACCESS, "access", text.contains("AKIA")), S.find(text, HEX, "hex"))


def weak(text: Column) -> Column:
    return F.concat(
        S.find(text, OPAQUE, "secret"), S.find(text, IDENTIFIER, "identifier", text.rlike("[:=]")), S.find(text, ENDPOINT, "endpoint", text.contains("://")),
    )


def link(parts: Column, scope: int = SCOPE) -> Column:
    """parts: an array of (start, end, kind, given: a strong finding). Weak parts with complementary ones near, as (start, end, kind), by start.

    The interval join is a sweep: parts are sorted by start, and for each the last and the next start of either role come from running maxima and minima.
    A ``secret`` needs an ``access`` or ``identifier`` part or an ``endpoint``; an ``identifier`` or ``endpoint`` needs a secret part (weak or strong).
    """
    far = 1 << 30

    def joined(p: Column) -> Column:
        secret = F.transform(p, lambda x: F.when(x["kind"].isin(*SECRET), x["start"]))
        other = F.transform(p, lambda x: F.when(~x["kind"].isin(*SECRET), x["start"]))
        last = lambda v: S.scan(F.transform(v, lambda x: F.coalesce(x, F.lit(-far))), F.greatest)
        following = lambda v: F.reverse(S.scan(F.reverse(F.transform(v, lambda x: F.coalesce(x, F.lit(far)))), F.least))
        near = lambda v: F.zip_with(last(v), following(v), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        sides = F.zip_with(near(secret), near(other), lambda s, o: F.struct(s.alias("s"), o.alias("o")))
        within = lambda x, v: (x["start"] - v["a"] <= scope) | (v["b"] - x["start"] <= scope)
        marked = F.zip_with(p, sides, lambda x, v: F.struct(x.alias("x"), (~x["given"] & F.when(x["kind"].isin(*SECRET), within(x, v["o"])).otherwise(within(x, v["s"]))).alias("on")))
        return F.transform(F.filter(marked, lambda m: m["on"]), lambda m: F.struct(m["x"]["start"].alias("start"), m["x"]["end"].alias("end"), m["x"]["kind"].alias("kind")))

    return S.let(F.array_sort(parts), joined)


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with ``strong`` and ``linked``: arrays of spans (start, end, kind, value; linked ones without value). Columns of those names are replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    part = lambda given: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(given).alias("given"))
    nothing = F.array().cast(LINKED)
    linked = lambda s: S.let(S.clear_of(weak(body), s), lambda w: F.when(F.size(w) > 0, link(F.concat(F.transform(s, part(True)), F.transform(w, part(False))), scope)).otherwise(nothing))
    both = S.let(strong(body), lambda s: F.struct(s.alias("strong"), linked(s).alias("linked")))
    rest = [c for c in docs.columns if c.lower() not in ("strong", "linked")]
    # The generator keeps the spans from being computed again for each use.
    return docs.select(*[F.col(f"`{c}`") for c in rest], F.inline(F.array(both)))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs with every span of their texts replaced by ``mark``; overlapping spans become one. Null texts stay null; other columns stay as they are."""
    names = [c if c == text else f"c{k}" for k, c in enumerate(docs.columns)]
    found = scan(docs.toDF(*[f"c{k}" for k in range(len(names))]), f"c{docs.columns.index(text)}", scope)
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    body = F.col(f"c{docs.columns.index(text)}")
    clean = S.redacted(body, F.concat(F.transform("strong", place), F.transform("linked", place)), mark)
    return found.select(*[(clean if c == text else F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)])
