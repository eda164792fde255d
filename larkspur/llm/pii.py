"""Personal data by weak supervision.

Validated patterns give base findings. Looser patterns give candidates, on which labelers vote yes, no or abstain: a pattern labeler (does the
value validate), a gazetteer labeler (top-level domains, country and area codes), a cue labeler (cue words and counter-cues before) and a neighbour labeler (stands alone, or touches
digits). Candidates are counted in Spark by kind, votes and shape - at most some 500,000 rows, whatever the corpus - and expectation-maximisation over these counts estimates each
labeler's reliability per kind. A logistic classifier, per kind over votes and over the shape that no labeler looks at (length, share of digits, separators, characters on both sides), is then trained
on the posteriors and applied as one column expression to add spans.

Defined results: a null text is empty; base findings always stay; an added span never overlaps a base one or an earlier added one of another pattern; without candidates nothing is added; repeated rows are
all kept; other columns are kept, but for ``base`` and ``added``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import hidden

KINDS = ("email", "ip", "card", "phone")

# Patterns of base findings. Possessive runs, and a look ahead for as many digits as a card has, give the same matches in linear time and without deep recursion.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"(?=[0-9](?:[\x20-]?[0-9]){12})[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# Candidates: kind and pattern. An account number of a listed country ends where its length says; of others, in a group of one to three after two to seven whole ones (spaced, it has
# a digit, so that a short word in capitals stays out).
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_LISTED = "|".join(
    rf"(?:{'|'.join(c for c, k in IBAN_LENGTHS.items() if k == n)})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n in sorted(set(IBAN_LENGTHS.values()))
)
IBAN = rf"(?<![A-Z0-9])(?:(?:{_LISTED})(?![A-Z0-9])|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:[A-Z0-9]{{1,3}}|\x20(?=[A-Z]{{0,2}}[0-9])[A-Z0-9]{{1,3}})?(?![A-Z0-9]))"
CANDIDATES = (
    ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\.|\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("iban", IBAN),  # before cards and phones, whose patterns match the digits of a spaced one
    ("phone", r"(?<![0-9+])(?:\(0?[0-9]{2,4}\)\x20?|0?[0-9]{2,4}[\x20./-])[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[.\x20]{1,2}[0-9]{4}){3}(?![0-9])"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
)
# Gazetteers and cue words.
DOMAINS = ("com", "net", "org", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "eu", "info", "biz")
IBAN_COUNTRIES = tuple(IBAN_LENGTHS)
CUES = {"email": "mail|contact|write|reach|address", "phone": "phone|call|tel|fax|mobile|cell|whatsapp", "card": "card|visa|credit|payment", "id": "ssn|social|security", "iban": "iban|bank|account|konto"}
COUNTER_CUES = "version|isbn|order|sku|page|part|serial|invoice|model"
AROUND = 40  # code points of context
#: Where expectation-maximisation starts: chances of a yes, an abstention and a no on true and on false spans, for each labeler (pattern, gazetteer, cue, digits around).
START = (((0.8, 0.15, 0.05), (0.5, 0.2, 0.3)), ((0.8, 0.15, 0.05), (0.5, 0.2, 0.3)), ((0.5, 0.45, 0.05), (0.05, 0.55, 0.4)), ((0.7, 0.25, 0.05), (0.5, 0.2, 0.3)))
LABELERS = len(START)
#: Observations in the shape of the start that each estimate begins with, for each span: they keep labels from swapping. A labeler that votes alike on all spans of a kind is left out, as
#: it tells them not apart; where all do, the start's chances decide.
PSEUDO = 0.1


def luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(backwards, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base(text: Column) -> Column:
    email = S.find(text, EMAIL, "email", text.contains("@"))
    ip = F.filter(S.find(text, IP, "ip"), lambda s: s["value"].rlike(IP_PARTS))
    runs = S.find(text, CARD, "card", text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"))
    card = F.filter(runs, lambda s: F.length(digits_of(s["value"])).between(13, 19))
    card = F.filter(card, lambda s: luhn(digits_of(s["value"])))
    phone = F.filter(S.find(text, PHONE, "phone", text.contains("+")), lambda s: F.length(digits_of(s["value"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def candidates(docs: DataFrame, base_of: Callable[[Column, Column], Column]) -> DataFrame:
    """docs (with ``t``, the text) with ``base``, by base_of (from the text and whether it has candidates), and ``c``: spans that may be personal data, clear of base ones and of earlier patterns' ones."""
    text = F.col("t")
    quick = {"email": text.rlike(r"(?i)@|\bat\b|at[\])]"), "phone": text.rlike("[0-9]{4}"), "card": text.rlike("[0-9]{4}"), "id": text.rlike("[0-9]-[0-9]"), "iban": text.rlike("[A-Z]{2}[0-9]{2}")}
    rest = docs.columns
    # A step for each pattern: lambdas in lambdas would be resolved one by one.
    df = docs.select(*rest, F.struct(*[S.find(text, pattern, kind, quick[kind]).alias(kind) for kind, pattern in CANDIDATES]).alias("raw"))
    some = sum((F.size(F.col("raw")[kind]) for kind, _ in CANDIDATES[1:]), F.size(F.col("raw")[CANDIDATES[0][0]])) > 0
    df = df.select(*rest, "raw", base_of(text, some).alias("base"), S.none().alias("c"))
    for kind, _ in CANDIDATES:
        own = F.col("raw")[kind]
        more = F.when(F.size(own) > 0, F.concat("c", S.clear_of(own, F.concat("base", "c")))).otherwise(F.col("c"))
        df = df.select(*rest, "raw", "base", more.alias("c"))
    # A generator: no filter on these columns is pushed below it, where it would take the steps apart.
    return df.select(*rest, F.inline(F.array(F.struct("base", "c"))))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def around(parts: Column, s: Column) -> Column:
    """A span of a text (given as blocks) with what lies before and after it."""
    before, after = S.between(parts, F.greatest(s["start"] - AROUND, F.lit(0)), s["start"]), S.between(parts, s["end"], s["end"] + 6)
    return F.struct(s["kind"].alias("kind"), s["value"].alias("value"), before.alias("before"), after.alias("after"), digits_of(s["value"]).alias("digits"))


def votes(x: Column) -> list[Column]:
    """One column per labeler of a span with its surroundings: 1, -1, or 0 (abstains)."""
    kind, value, digits, before, after = (x[k] for k in ("kind", "value", "digits", "before", "after"))
    cue = F.lit(False)
    for k, p in CUES.items():
        cue = F.when(kind == k, F.lower(before).rlike(rf"\b(?:{p})")).otherwise(cue)
    tail = F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1))
    valid = F.when(kind == "email", value.rlike(r"@|\[|\(")).when(kind == "phone", F.length(digits).between(9, 13)).when(kind == "card", luhn(F.when(kind == "card", digits).otherwise("0"))).when(
        kind == "id", ~value.rlike("^(?:000|666|9)|-00-|-0000$")).otherwise(F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34))
    listed = F.when(kind == "email", tail.isin(*DOMAINS)).when(kind == "phone", value.rlike(r"^\(?0?[2-9]")).when(kind == "card", digits.rlike("^(?:4|5[1-5]|3[47]|6)")).otherwise(F.substring(value, 1, 2).isin(*IBAN_COUNTRIES))
    touches = after.rlike(r"^[\x20.,;|/-]*[0-9]") | before.rlike(r"[0-9][\x20.,;|/-]*$")
    alone = before.rlike(r"(?:^|[\s:,;(])$") & after.rlike(r"^(?:$|[\s.,;)!?])")
    return [_vote(valid, ~valid), F.when(kind != "id", _vote(listed, ~listed)).otherwise(0), _vote(cue, F.lower(before).rlike(rf"\b(?:{COUNTER_CUES})")), _vote(alone & ~touches, touches)]


def shape(x: Column) -> list[Column]:
    """What the classifier sees of a span besides votes, as short texts: length, share of digits, separators, and the characters on both sides."""
    value, n = x["value"], F.greatest(F.length(x["value"]), F.lit(1))
    side = lambda c, name: F.when(c == "", name + "edge").when(c.rlike(r"\s"), name + "space").when(c.rlike(r"[\p{L}\p{N}]"), name + "word").otherwise(name + "mark")
    separator = F.when(value.rlike(r"[()\[\]]"), "bracket").when(value.contains("@"), "at").when(value.rlike("[-/]"), "dash").when(value.contains("."), "dot").when(value.contains(" "), "blank").otherwise("none")
    return [
        F.concat(F.lit("length"), F.least(F.floor(F.log2(n)), F.lit(6)).cast("string")), F.concat(F.lit("digits"), F.floor(F.length(x["digits"]) * 4 / n).cast("string")), separator,
        side(F.right(x["before"], F.lit(1)), "after "), side(F.left(x["after"], F.lit(1)), "before "),
    ]


def em(counts: dict[tuple, float], rounds: int = 50, prior: float = 0.3) -> tuple[dict[tuple, float], dict]:
    """counts: (kind, votes...) -> how often. Posteriors of the same keys, and per kind the prior and the chances of a yes, an abstention and a no of each labeler, on true and on false spans."""
    post: dict[tuple, float] = {}
    model: dict[str, tuple[float, np.ndarray]] = {}
    start = np.array(START)  # labeler, side, vote
    place = {1: 0, 0: 1, -1: 2}
    for kind in sorted({k[0] for k in counts}):
        keys = [k for k in counts if k[0] == kind]
        n, vote = np.array([counts[k] for k in keys]), np.array([[place[v] for v in k[1:]] for k in keys])
        p, chance = prior, start
        labelers = np.flatnonzero(vote.min(0) < vote.max(0))
        learnt = len(labelers) > 0
        labelers = labelers if learnt else np.arange(vote.shape[1])
        prior_n = PSEUDO * n.sum()
        for _ in range(rounds):
            seen = np.log(chance)[labelers, :, vote[:, labelers]].sum(1)  # pattern, side
            true = 1 / (1 + np.exp(np.clip(seen[:, 1] + np.log(1 - p) - seen[:, 0] - np.log(p), -700, 700)))
            if not learnt:
                break
            side = np.stack([true, 1 - true], 1) * n[:, None]
            chance = prior_n * start
            for i in labelers:
                for v in range(3):
                    chance[i, :, v] += side[vote[:, i] == v].sum(0)
            chance = chance / chance.sum(2, keepdims=True)
            p = float(np.clip((side[:, 0].sum() + prior_n * prior) / (n.sum() + prior_n), 0.01, 0.99))
        post |= dict(zip(keys, true.tolist(), strict=True))
        model[kind] = p, chance
    return post, model


def names(kind: str, v: tuple, s: tuple) -> list[str]:
    """The classifier's features of a span: per kind its votes and its shape."""
    return [kind, *(f"{kind}:{i}:{x}" for i, x in enumerate(v)), *(f"{kind}:{x}" for x in s)]


def train(counts: dict[tuple, float], post: dict[tuple, float], rounds: int = 400, rate: float = 1.0, l2: float = 1e-3) -> dict[str, float]:
    """Logistic weights, fitted to the posteriors by gradient descent over the counted (kind, votes, shape)."""
    keys = sorted(counts)
    if not keys:
        return {}
    each = [names(*k) for k in keys]
    index = {f: i for i, f in enumerate(sorted({f for fs in each for f in fs}))}
    x = np.array([[index[f] for f in fs] for fs in each])
    n, y, w = np.array([counts[k] for k in keys]), np.array([post[k[0], *k[1]] for k in keys]), np.zeros(len(index))
    total = {kind: sum(counts[k] for k in keys if k[0] == kind) for kind in {k[0] for k in keys}}  # a rare kind learns as fast as a common one
    n = n / np.array([total[k[0]] for k in keys])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
        w -= rate * (np.bincount(x.ravel(), np.repeat((p - y) * n, x.shape[1]), minlength=len(w)) + l2 * w)
    return {f: float(w[i]) for f, i in index.items()}


def fit(docs: DataFrame, text: str = "text") -> dict[str, float]:
    found = candidates(docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")), lambda t, some: F.when(some, base(t)).otherwise(S.none())).where("size(c) > 0")
    told = lambda x: F.struct(x["kind"].alias("kind"), F.array(*votes(x)).alias("v"), F.array(*shape(x)).alias("s"))
    near = found.select("c", S.blocks(F.col("t")).alias("parts")).select(F.explode(F.transform("c", lambda s: around(F.col("parts"), s))).alias("x"))
    one = near.select(told(F.col("x")).alias("x"))
    counts = {(r[0], tuple(r[1]), tuple(r[2])): float(r[3]) for r in one.groupBy("x.kind", "x.v", "x.s").count().collect()}  # bounded by the values that these can have
    voted: dict[tuple, float] = {}
    for (kind, v, _), n in counts.items():
        voted[kind, *v] = voted.get((kind, *v), 0.0) + n
    return train(counts, em(voted)[0])


def score(x: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability of a span with its surroundings."""
    known = F.create_map(*[F.lit(v) for f in sorted(weights) for v in (f, weights[f])])
    key = lambda *parts: F.coalesce(F.try_element_at(known, F.concat(x["kind"], *parts)), F.lit(0.0))
    total = key(F.lit(""))
    for i, v in enumerate(votes(x)):
        total = total + key(F.lit(f":{i}:"), v.cast("string"))
    for v in shape(x):
        total = total + key(F.lit(":"), v)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def scan(docs: DataFrame, weights: dict[str, float], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with ``base`` and ``added``: arrays of spans (start, end, kind, value)."""
    df, given = hidden(docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("base", "added")]))
    df = df.withColumnRenamed("c0", "t")
    if weights:
        df = candidates(df, lambda t, some: base(t))
        df = df.select("*", F.when(F.size("c") > 0, S.blocks(F.col("t"))).alias("parts"))
        near = F.transform("c", lambda s: F.struct(s.alias("s"), around(F.col("parts"), s).alias("x")))
        df = df.select("*", F.when(F.size("c") > 0, near).alias("near"))
        likely = F.transform(F.filter("near", lambda y: score(y["x"], weights) > threshold), lambda y: y["s"])
        added = F.when(F.size("c") > 0, likely).otherwise(S.none())
    else:
        df, added = df.select("*", base(F.col("t")).alias("base")), S.none()
    return df.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(given) if k], "base", added.alias("added"))
