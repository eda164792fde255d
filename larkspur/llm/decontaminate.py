"""Benchmark decontamination by spaced seeds.

Fixed masks select some of the tokens in a window and ignore the rest, so a window with substituted words still hashes as the benchmark's. Hashes
of training windows meet those of benchmark windows in an equi-join; around each hit, the best run of aligned tokens (matches add one,
substitutions take ``penalty``) must have enough matching tokens and identity. If it has not, but the diagonal holds a run that has, that
one counts: of all runs of enough matching tokens the one with most of them above ``min_identity`` of its length.

Tokens are runs of letters and digits, in lower case. Hits that continue one of the window before are verified once, at the first window.

Defined results: null or empty texts match nothing; a document or item that occurs in several rows gives one row per pair of ids, the best; an item
shorter than ``min_words`` must match whole, and is looked up by the hash of all of its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden, settle

#: Places that each mask looks at. Every run of MIN_WORDS matches or more with MIN_IDENTITY holds all places of one of them (a test enumerates the runs); for lower limits there is no such promise.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 5, 11, 12))
MIN_WORDS, MIN_IDENTITY, PENALTY = 10, 0.75, 1.5
#: Windows of the benchmark that are broadcast at most (about 32 bytes each, 64 MB); beyond, windows are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000


def token_hashes(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def windows(df: DataFrame, h: str, at: str, masks=MASKS) -> DataFrame:
    """A row for each window and mask: ``at`` (place), mask, seed (hash of the tokens that the mask looks at)."""
    placed = df.select("*", F.posexplode(h).alias(at, "_first"))
    seeds = [F.when(F.col(at) + m[-1] < F.size(h), F.struct(F.lit(k).alias("mask"), F.xxhash64(F.lit(k), *[F.get(F.col(h), F.col(at) + i) for i in m]).alias("seed"))) for k, m in enumerate(masks)]
    return placed.drop("_first").select("*", F.explode(F.array(*seeds)).alias("_s")).select("*", "_s.mask", "_s.seed").drop("_s").where("seed IS NOT NULL")


def _first_of_run(masks) -> Column:
    """No hit of the same mask one place before on the same diagonal."""
    tests = [F.forall(F.array(*map(F.lit, m)), lambda i: F.get(F.col("h"), F.col("at") + i - 1) == F.get(F.col("item_h"), F.col("item_at") + i - 1)) for m in masks]
    before = F.lit(False)
    for k, t in enumerate(tests):
        before = F.when(F.col("mask") == k, t).otherwise(before)
    return (F.col("at") == 0) | (F.col("item_at") == 0) | ~F.coalesce(before, F.lit(False))


def _verified(penalty: float) -> Column:
    """The best run on the diagonal: score, tokens, matches and its start in the document."""
    start = F.expr("named_struct('run', 0D, 'n', 0, 'same', 0, 'score', 0D, 'best_n', 0, 'best_same', 0, 'best_end', -1)")
    step = F.expr("sequence(greatest(0, -shift), least(size(item_h), size(h) - shift) - 1)")

    def add(acc: Column, j: Column) -> Column:
        hit = F.get(F.col("item_h"), j) == F.get(F.col("h"), j + F.col("shift"))
        fresh = acc["run"] <= 0
        run = F.when(fresh, F.lit(0.0)).otherwise(acc["run"]) + F.when(hit, F.lit(1.0)).otherwise(F.lit(-float(penalty)))
        n = F.when(fresh, F.lit(0)).otherwise(acc["n"]) + 1
        same = F.when(fresh, F.lit(0)).otherwise(acc["same"]) + F.when(hit, 1).otherwise(0)
        more = run > acc["score"]
        return F.struct(run.alias("run"), n.alias("n"), same.alias("same"), F.when(more, run).otherwise(acc["score"]).alias("score"),
                        F.when(more, n).otherwise(acc["best_n"]).alias("best_n"), F.when(more, same).otherwise(acc["best_same"]).alias("best_same"),
                        F.when(more, j + F.col("shift")).otherwise(acc["best_end"]).alias("best_end"))

    return F.aggregate(step, start, add)


def _passing(k: Column, least: Column, min_identity: float) -> Column:
    """Of the runs from match to match with at least so many matches the one whose matches exceed min_identity of its length by most: its first and last match.

    k: the places of the diagonal's matches. A run from the a-th to the b-th exceeds by (b + 1 - min_identity (k[b] + 1)) - (a - min_identity k[a]), so for each b the best a is
    the least of those that are far enough before; it passes if this is not negative, and if any run passes the chosen one does.
    """
    start = F.struct(F.lit(float("inf")).alias("low"), F.lit(0).alias("low_at"), F.lit(float("-inf")).alias("gain"), F.lit(0).alias("a"), F.lit(-1).alias("b"))

    def add(acc: Column, b: Column) -> Column:
        a = b - least + 1
        own = a - min_identity * F.get(k, a)
        low, low_at = F.least(acc["low"], own), F.when(own < acc["low"], a).otherwise(acc["low_at"])
        gain = b + 1 - min_identity * (F.get(k, b) + 1) - low
        more = gain > acc["gain"]
        return F.struct(low.alias("low"), low_at.alias("low_at"), F.when(more, gain).otherwise(acc["gain"]).alias("gain"),
                        F.when(more, low_at).otherwise(acc["a"]).alias("a"), F.when(more, b).otherwise(acc["b"]).alias("b"))

    return F.aggregate(F.sequence(least - 1, F.size(k) - 1), start, add)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", masks=MASKS,
             min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, penalty: float = PENALTY, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_tokens and n_same (of the best aligned run), start (token in the document), identity: the pairs that overlap."""
    d = docs.select(F.col(doc_id).alias("doc_id"), token_hashes(F.col(text)).alias("h"))
    items = benchmark.select(F.col(item_id).alias("item_id"), token_hashes(F.col(text)).alias("item_h")).where("size(item_h) > 0").distinct()
    keyed = items.withColumn("item_key", F.xxhash64("item_id", "item_h"))
    short = max(min_words, min(m[-1] for m in masks) + 1)  # items of fewer tokens get a mask of their whole length
    whole = [r[0] for r in items.select(F.size("item_h")).where(F.size("item_h") < short).distinct().collect()]
    own = F.lit(False)
    for k, n in enumerate(whole, len(masks)):
        own = own | ((F.col("mask") == k) & (F.size("item_h") == n))
    patterns, masks = len(masks), (*masks, *(tuple(range(n)) for n in whole))
    asked = windows(keyed, "item_h", "item_at", masks).where((F.col("mask") < patterns) | own).select("item_key", "item_at", F.col("mask").alias("m"), F.col("seed").alias("s"))
    items = keyed
    if asked.limit(broadcast_windows + 1).count() <= broadcast_windows:
        hits = windows(d, "h", "at", masks).join(F.broadcast(asked), (F.col("seed") == F.col("s")) & (F.col("mask") == F.col("m")))
        hits = hits.join(F.broadcast(items), "item_key")
    else:  # the arrays stay behind while windows are shuffled, and come back for the hits
        d = d.withColumn("d_key", F.xxhash64("doc_id", "h"))
        met = windows(d, "h", "at", masks).select("d_key", "at", "mask", "seed").join(asked, (F.col("seed") == F.col("s")) & (F.col("mask") == F.col("m")))
        hits = met.join(items, "item_key").join(d.dropDuplicates(["d_key"]), "d_key")
    hits = hits.where(_first_of_run(masks)).withColumn("shift", F.col("at") - F.col("item_at"))
    least = F.least(F.lit(min_words), F.size("item_h"))
    best = settle(hits.select("doc_id", "item_id", "h", "item_h", "shift", least.alias("least"), _verified(penalty).alias("v")), "v")
    enough = lambda n, same: (same >= F.col("least")) & (same >= min_identity * n)
    passes = enough(F.col("v.best_n"), F.col("v.best_same"))
    # Only where the best run fails are the places of all matches wanted.
    at = F.filter(F.expr("sequence(greatest(0, -shift), least(size(item_h), size(h) - shift) - 1)"), lambda j: F.get(F.col("item_h"), j) == F.get(F.col("h"), j + F.col("shift")))
    best = settle(best.withColumn("k", F.when(passes, F.array().cast("array<int>")).otherwise(at)), "k")
    best = settle(best.withColumn("r", F.when(F.size("k") >= F.col("least"), _passing(F.col("k"), F.col("least"), min_identity))), "r")
    first, last = F.get("k", F.col("r.a")), F.get("k", F.col("r.b"))
    best = best.select("doc_id", "item_id", "least", F.coalesce(last - first + 1, F.col("v.best_n")).alias("best_n"), F.coalesce(F.col("r.b") - F.col("r.a") + 1, F.col("v.best_same")).alias("best_same"),
                       F.coalesce(last + F.col("shift"), F.col("v.best_end")).alias("best_end"))
    good = best.where(enough(F.col("best_n"), F.col("best_same")))
    pairs = good.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("best_same").alias("n_same"), (-F.col("best_n")).alias("n"), (-(F.col("best_end") - F.col("best_n") + 1)).alias("s"))).alias("b"))
    return pairs.select("doc_id", "item_id", F.col("b.n_same").cast("long").alias("n_same"), (-F.col("b.n")).cast("long").alias("n_tokens"), (-F.col("b.s")).cast("long").alias("start"), (F.col("b.n_same") / -F.col("b.n")).alias("identity"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that overlap an item; rows without an id that overlap one go as well. Other columns, whatever their names are, stay as they are."""
    df, names = hidden(docs)
    key, body = (f"c{[n.lower() for n in names].index(how.get(k, k).lower())}" for k in ("doc_id", "text"))
    bad = overlaps(df.select(F.col(key).alias("doc_id"), F.col(body).alias("text")), benchmark, **{k: v for k, v in how.items() if k not in ("doc_id", "text")}).select("doc_id").distinct()
    return df.join(bad, F.col(key).eqNullSafe(F.col("doc_id")), "left_anti").toDF(*names)
