"""Quality rules: text statistics as columns, and decision lists learnt from them.

``statistics`` uses built-in functions alone. ``learn`` fits an ordered list of threshold conjunctions by sequential
covering: each rule is grown on two thirds of the rows by the condition with the best FOIL gain, pruned on the other third,
and kept while it is precise; rows that it covers are removed and the next rule is sought. ``DecisionList.column`` is a
nested ``CASE WHEN`` that Catalyst compiles.

Defined results: a null text has no words; a statistic per word of a text without words is 0; labels that are null or belong to
no document are ignored; without any rejected label the list is empty and keeps everything; rows that repeat are counted as often.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden, settle, words

#: At most this many labelled rows are used to fit (chosen by hash of the id).
SAMPLE_ROWS = 10_000
#: Imprecise rules that are dropped before the search for more ends.
MISSES = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "symbol_share", "repeat_share", "dup_line_share", "mean_word_chars", "upper_share", "pipe_share", "digit_share", "distinct_share", "stop_share")


def window_hashes(w: Column) -> Column:
    """A hash of each 3-word window."""
    return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of COUNTS and the shares of FEATURES added (columns of those names are replaced; others stay, whatever they are called)."""
    own = {*COUNTS, *FEATURES}
    given = docs.select(F.col(f"`{text}`").alias("t"), *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own])
    df, names = hidden(given)
    df = df.withColumn("_w", words(F.col("c0")))
    df = df.withColumn("_g", window_hashes(F.col("_w")))
    # Only where a window repeats: windows sorted by hash, those with an equal neighbour, and their places in order.
    ordered = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), ordered))
    df = df.withColumn("_p", F.expr(
        "CASE WHEN _s IS NOT NULL THEN sort_array(transform(filter(transform(_s, (x, i) -> struct(x.p AS p, (i > 0 AND get(_s, i - 1).h <=> x.h) OR (get(_s, i + 1).h <=> x.h) AS twice)), y -> y.twice), y -> y.p)) END"))
    repeats = F.expr("CASE WHEN _p IS NULL THEN 0L WHEN size(_p) = 0 THEN 0L ELSE aggregate(transform(_p, (x, i) -> least(3, coalesce(get(_p, i + 1) - x, 3))), 0L, (a, x) -> a + x) END")
    body = F.coalesce(F.col("c0"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = F.length(F.array_join("_w", ""))
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", chars.cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long")).withColumn("_l", lines)
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).withColumn("n_repeat_words", repeats)
    per_word = lambda c: F.when(F.col("n_words") > 0, c / F.col("n_words")).otherwise(F.lit(0.0))
    per_char = lambda c: F.when(F.col("word_chars") > 0, c / F.col("word_chars")).otherwise(F.lit(0.0))
    df = df.withColumns({
        "symbol_share": per_word(F.col("n_symbols")), "repeat_share": per_word(F.col("n_repeat_words")), "mean_word_chars": per_word(F.col("word_chars")),
        "dup_line_share": F.when(F.size("_l") > 0, F.col("n_dup_lines") / F.size("_l")).otherwise(F.lit(0.0)),
        "upper_share": per_char(F.regexp_count(body, F.lit(r"\p{Lu}"))), "digit_share": per_char(F.regexp_count(body, F.lit("[0-9]"))),
        "pipe_share": per_word(F.regexp_count(body, F.lit(r"\|"))), "distinct_share": per_word(F.size(F.array_distinct("_w"))),
        "stop_share": per_word(F.regexp_count(body, F.lit(r"[.!?]"))),
    })
    every = list(dict.fromkeys(COUNTS + FEATURES))
    done = settle(df.drop("_w", "_g", "_s", "_p", "_l"), *every)
    return done.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names) if k], *every)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= threshold, else feature < threshold
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v >= self.threshold if self.above else v < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction that rejects; what none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def column(self) -> Column:
        """Number of the first rule that holds (from 1), 0 if none does."""
        out = None
        for n, rule in enumerate(self.rules, 1):
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            out = F.when(test, n) if out is None else out.when(test, n)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> list[Condition]:
    rule: list[Condition] = []
    on = np.ones(len(y), bool)
    while len(rule) < most and on.any() and not y[on].all():
        p0, n0 = y[on].sum(), on.sum()
        best: tuple[float, Condition | None] = (1e-9, None)
        for f in FEATURES:
            v = x[f][on]
            order = np.argsort(v, kind="stable")
            v, pos = v[order], np.cumsum(y[on][order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            for above, p, n in ((False, pos[cut - 1], cut), (True, p0 - pos[cut - 1], n0 - cut)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Condition(f, above, float((v[cut[k] - 1] + v[cut[k]]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= best[1].holds(x)
    return rule


def _prune(rule: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> list[Condition]:
    """The prefix with the best (p - n) / (p + n) on rows that did not grow it; the shortest of equals."""
    def worth(k: int) -> float:
        on = np.logical_and.reduce([c.holds(x) for c in rule[:k]])
        return (2 * y[on].sum() - on.sum()) / max(on.sum(), 1)
    return rule[: max(range(1, len(rule) + 1), key=lambda k: (round(worth(k), 6), -k))]


def fit(x: dict[str, np.ndarray], reject: np.ndarray, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.9, least: int = 5, seed: int = 7) -> DecisionList:
    rng, rules, misses = np.random.default_rng(seed), [], 0
    left = np.ones(len(reject), bool)
    while len(rules) < max_rules and reject[left].sum() >= least:
        rows = np.flatnonzero(left)
        held = rng.random(len(rows)) < 1 / 3
        part = lambda r: ({f: x[f][r] for f in FEATURES}, reject[r])
        rule = _grow(*part(rows[~held]), max_conditions)
        if not rule:
            break
        rule = _prune(rule, *part(rows[held]))
        on = left & np.logical_and.reduce([c.holds(x) for c in rule])
        if reject[on].sum() >= least and reject[on].mean() >= precision:
            rules.append(tuple(rule))
            left &= ~on
        else:  # not precise: dropped, and the next is grown on another split
            misses += 1
            if misses == MISSES:
                break
    return DecisionList(tuple(rules))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **how) -> DecisionList:
    """Fit on at most ``sample_rows`` labelled documents (labels: doc_id, quality; 0 is rejected)."""
    some = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_q"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "_id")
    )
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))).select("_q", *FEATURES).collect()
    table = np.array([tuple(r) for r in rows], dtype=float).reshape(-1, len(FEATURES) + 1)
    table = table[np.lexsort(table.T[::-1])]  # the same rows give the same list, however they arrive
    return fit({f: table[:, k + 1] for k, f in enumerate(FEATURES)}, table[:, 0] == 0, **how)


def apply(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs with statistics, base_failed, rule (0: none) and kept."""
    df = statistics(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("rule", rules.column()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
