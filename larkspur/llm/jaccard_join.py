"""N-gram Jaccard join by vertical partitioning.

Sets of n-grams (64-bit hashes) are cut along a global order of n-grams, and what each fragment says is counted by itself and summed.

1. First fragment. Of the n-grams in one range of the hash order, each set's partial count of those that no other set has is taken. A set that misses more
   than 1 - num / den of its size links with nothing, whatever the other fragments hold, and leaves here: most sets do. One shuffle of a fraction of all
   n-grams; an n-gram that occurs often in a task is sent for two of its sets only, the others know already that it is shared.
2. The sets that are left are ordered by ascending frequency among themselves, ties by hash. Links share an n-gram of both prefixes, and at the first shared one at
   places i and j the sets differ in i + j n-grams or more. N-grams that one set alone has come first and meet nothing, so passages and copies below the threshold
   make no pairs.
3. Overlaps of candidate pairs are counted in each fragment and summed per pair, which decides exactly.

Equal sets are one node from the start. In the bucket of a prefix n-gram all members meet one centre first, the one with the least share of n-grams of its own; members that
are in another component than the centre's then meet the members of the others, dealt over blocks, where places, sizes and two parity sketches (of 256 and 2,048 bits: their
Hamming distance never exceeds the number of differing n-grams) allow a link. So a group of near copies costs a star, not all its pairs, and no link between components is lost.

Defined results: null or empty texts have empty sets and link with nothing; rows that share a doc_id are one document, and each row is returned; a null doc_id
links with nothing and has a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import U, mix, shingle_sets, slices
from .common import hidden
from .components import components
from .storage import forget, ship, written

#: Fragments in which overlaps are counted.
FRAGMENTS = 8
#: Ids of documents that are broadcast at most (8 bytes each) to pick their texts; beyond, a shuffle joins them.
BROADCAST_IDS = 1_000_000
#: Members of a bucket that one task compares with those that are still apart.
BLOCK = 1024
#: Bits of the wide sketch; the narrow one folds it into 256.
WIDE = 2048
NARROW = [f"s{i}" for i in range(4)]
#: Rows sent at once.
ROWS = 1 << 17


def first_fragment(num: int, den: int) -> int:
    """Where the first fragment of the hash order ends: it holds 7/4 of the share in which linked sets may differ, so that common n-grams leave room."""
    return min(2**64 - 1, 2**64 * 7 * (den - num) // (4 * den))


def _sums(sets: list[np.ndarray], salt: int) -> np.ndarray:
    return np.array([mix(s + U(salt)).sum(dtype=U) for s in sets], U)


def _profile(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """doc_id, size and two hashes of each set."""
    for batch in batches:
        for a, b in slices(batch.column(1)):
            sets = shingle_sets(batch.column(1).slice(a, b - a), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(_sums(sets, 1).view(np.int64)), pa.array(_sums(sets, 2).view(np.int64))], names=["doc_id", "n", "a", "b"])


def local_counts(sets: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the n-grams below end: hashes and owners of those to be sent (the first and the last owner of each), and per set minus those that are not known to be shared and not sent."""
    part = [s[: np.searchsorted(s, U(end))] for s in sets]
    size = np.array([len(s) for s in part], np.int64)
    g, o = np.concatenate([*part, np.zeros(0, U)]), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(g, kind="stable")
    g, o = g[order], o[order]
    new = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    sent = new | np.concatenate((new[1:], [True]))[: len(g)]
    return g[sent], o[sent], np.bincount(o[~sent], minlength=len(sets)) - size


def _first(batches: Iterator[pa.RecordBatch], n: int, end: int) -> Iterator[pa.RecordBatch]:
    """g, a, k: an n-gram of set a (k = 1), or for each set once in a task a row with its balance (k <= 0): shared n-grams not sent less all n-grams of the fragment."""
    seen: set[int] = set()
    for batch in batches:
        for p, q in slices(batch.column(1)):
            sets = shingle_sets(batch.column(1).slice(p, q - p), n)
            a = _sums(sets, 1)
            once = [i for i in np.unique(a, return_index=True)[1].tolist() if len(sets[i]) and int(a[i]) not in seen]
            sets, a = [sets[i] for i in once], a[once]
            seen.update(a.tolist())
            g, o, balance = local_counts(sets, end)
            g, own, k = np.concatenate([g, a]), np.concatenate([a[o], a]), np.concatenate([np.ones(len(o), np.int32), balance.astype(np.int32)])
            for at in range(0, max(len(g), 1), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + ROWS]) for x in (g.view(np.int64), own.view(np.int64), k)], names=["g", "a", "k"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """a, fragment, grams: each set in FRAGMENTS ranges of the hash order, empty ones left out; fragment -1 holds the wide sketch."""
    edges = np.arange(FRAGMENTS + 1, dtype=U)
    for batch in batches:
        for p, q in slices(batch.column(1)):
            sets = shingle_sets(batch.column(1).slice(p, q - p), n)
            rows: tuple[list, list, list] = ([], [], [])
            for key, s in zip(_sums(sets, 1).view(np.int64).tolist(), sets, strict=True):
                odd = (np.bincount((s >> U(7)).astype(np.int64) & (WIDE - 1), minlength=WIDE) & 1).astype(np.uint8)
                at = np.searchsorted(((s >> U(32)) * U(FRAGMENTS)) >> U(32), edges)
                parts = [(-1, np.packbits(odd).view(np.int64))] + [(f, s[at[f] : at[f + 1]].view(np.int64)) for f in range(FRAGMENTS) if at[f] < at[f + 1]]
                for f, x in parts:
                    for column, value in zip(rows, (key, f, x), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.list_(pa.int64()))], names=["a", "fragment", "grams"])


def _live(docs: DataFrame, nodes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The nodes (a, n, id) whose first fragment allows a link."""
    rows = docs.where("doc_id IS NOT NULL").mapInArrow(partial(_first, n=n, end=first_fragment(num, den)), "g long, a long, k int")
    alike = Window.partitionBy("g")
    told = rows.select("a", "k", F.min("a").over(alike).alias("low"), F.max("a").over(alike).alias("high")).where("k <= 0 OR low <> high")
    # A set is counted once in each task that has it, so its sums are multiples of the number of those tasks.
    summed = told.groupBy("a").agg(F.sum("k").alias("balance"), F.sum(F.when(F.col("k") <= 0, 1).otherwise(0)).alias("tasks"))
    return nodes.join(summed, "a").where((F.col("n") * F.col("tasks") + F.col("balance")) * den >= F.col("n") * F.col("tasks") * num).select("a", "n", "id")


def _prefixes(sets: DataFrame, live: DataFrame, num: int, den: int) -> DataFrame:
    """g, a, n, i, own: the n-grams of each set's prefix that other live sets have too, their places and how many come first that none has."""
    grams = sets.where("fragment >= 0").select("a", F.explode("grams").alias("g"))
    shared = grams.select("a", "g", F.count("*").over(Window.partitionBy("g")).alias("df")).where("df > 1")
    ordered = shared.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("s")).join(live, "a")
    ordered = ordered.withColumn("own", F.col("n") - F.size("s")).withColumn("take", F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1 - own").cast("int")).where("take > 0")
    prefix = ordered.select("a", "n", "own", F.posexplode(F.slice("s", F.lit(1), F.col("take"))).alias("place", "e"))
    return prefix.select(F.col("e.g").alias("g"), "a", "n", (F.col("place") + F.col("own")).alias("i"), "own")


def _may_link(num: int, den: int) -> Column:
    """Sizes and places of x and y allow the threshold."""
    total = F.col("x_n") + F.col("y_n")
    return (F.least("x_n", "y_n") * den >= F.greatest("x_n", "y_n") * num) & ((F.col("x_i") + F.col("y_i")) * (den + num) <= total * (den - num))


def _apart(x: Column, y: Column) -> Column:
    """Hamming distance of two sketches."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y, x_n, y_n) that link: what the wide sketches leave, with overlaps counted per fragment and summed per pair."""
    side = lambda p, f: sets.where(f).select(F.col("a").alias(p), "fragment", F.col("grams").alias(f"{p}_grams"))
    both = pairs.join(side("x", "fragment = -1").drop("fragment"), "x").join(side("y", "fragment = -1").drop("fragment"), "y")
    near = both.where(_apart(F.col("x_grams"), F.col("y_grams")) * (den + num) <= (F.col("x_n") + F.col("y_n")) * (den - num)).select("x", "y", "x_n", "y_n")
    near = written(near, "pairs")
    both = near.join(side("x", "fragment >= 0"), "x").join(side("y", "fragment >= 0"), ["y", "fragment"])
    overlap = both.select("x", "y", "x_n", "y_n", F.size(F.array_intersect("x_grams", "y_grams")).cast("long").alias("part"))
    summed = overlap.groupBy("x", "y").agg(F.first("x_n").alias("x_n"), F.first("y_n").alias("y_n"), F.sum("part").alias("o"))
    out = written(summed.where(F.col("o") * den >= (F.col("x_n") + F.col("y_n") - F.col("o")) * num).select("x", "y"), "linked")
    forget(near)
    return out


def _stars(prefix: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The centre of each bucket (g, centre, size), and the pairs of members with it that may link."""
    first = F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "a", "n", "i"))
    centres = prefix.groupBy("g").agg(first.alias("c"), F.count("*").alias("size")).where("size > 1")
    pairs = prefix.join(centres, "g").where("a <> c.a").select(F.col("c.a").alias("x"), F.col("a").alias("y"), F.col("c.n").alias("x_n"), F.col("n").alias("y_n"), F.col("c.i").alias("x_i"), F.col("i").alias("y_i"))
    return centres.select("g", F.col("c.a").alias("centre"), "size"), pairs.where(_may_link(num, den)).select("x", "y", "x_n", "y_n").distinct()


def _others(prefix: DataFrame, centres: DataFrame, placed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that may link of members that are in another component than their bucket's centre, with members of the other components. placed: a, c."""
    member = prefix.join(placed, "a").join(centres.join(placed.select(F.col("a").alias("centre"), F.col("c").alias("c0")), "centre"), "g")
    told = member.select("g", "a", "n", "i", "c", "c0", "size", F.max(F.col("c") != F.col("c0")).over(Window.partitionBy("g")).alias("mixed"))
    mixed = written(told.where("mixed").drop("mixed"), "members")
    folded = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.aggregate(F.sequence(k, F.lit(WIDE // 64 - 1), F.lit(4)), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.get(F.col("grams"), j))))
    sketch = sets.where("fragment = -1").select("a", F.col("grams").alias("wide"), folded.alias("f")).select("a", "wide", *[F.col("f")[k].alias(s) for k, s in enumerate(NARROW)])
    side = mixed.join(sketch.join(mixed.select("a").distinct(), "a", "left_semi"), "a")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    named = lambda df, p: df.select("g", "block", *[F.col(c).alias(f"{p}_{c}") for c in ("a", "n", "i", "c", "wide", *NARROW)])
    left = named(side.where("c <> c0").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))), "x")
    right = named(side.withColumn("block", F.pmod(F.xxhash64("a"), blocks).cast("int")), "y")
    total = (F.col("x_n") + F.col("y_n")) * (den - num)
    narrow = sum((F.bit_count(F.col(f"x_{s}").bitwiseXOR(F.col(f"y_{s}"))) for s in NARROW[1:]), F.bit_count(F.col("x_s0").bitwiseXOR(F.col("y_s0"))))
    allowed = (F.col("x_c") != F.col("y_c")) & _may_link(num, den) & (narrow * (den + num) <= total) & (_apart(F.col("x_wide"), F.col("y_wide")) * (den + num) <= total)
    met = left.alias("l").join(right.alias("r"), (F.col("l.g") == F.col("r.g")) & (F.col("l.block") == F.col("r.block")) & allowed)
    first = F.col("x_a") < F.col("y_a")
    way = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return met.select(way("x_a", "y_a").alias("x"), way("y_a", "x_a").alias("y"), way("x_n", "y_n").alias("x_n"), way("y_n", "x_n").alias("y_n")).distinct()


def _groups(docs: DataFrame, nodes: DataFrame, repeated: bool, ties: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node and component of the nodes' ids."""
    live = written(_live(docs, nodes, n, num, den), "live")
    ids = live.select(F.col("id").alias("wanted")).distinct()
    few = live.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(ids) if few else ids, docs.doc_id == ids.wanted, "left_semi").select("doc_id", "text")
    sets = wanted.mapInArrow(partial(_sets, n=n), "a long, fragment int, grams array<long>")
    if repeated:  # one id in several rows: of its sets the live ones, once
        sets = sets.join(live.select("a"), "a", "left_semi").dropDuplicates(["a", "fragment"])
    sets = written(sets, "sets")
    prefix = written(_prefixes(sets, live, num, den), "prefixes")
    centres, stars = _stars(prefix, num, den)
    centres, stars = written(centres, "centres"), written(stars, "stars")
    name = lambda links: links.join(live.select(F.col("a").alias("x"), F.col("id").alias("p")), "x").join(live.select(F.col("a").alias("y"), F.col("id").alias("q")), "y").select(F.col("p").alias("x"), F.col("q").alias("y"))
    links = _linked(stars, sets, num, den)
    found = components(name(links).unionByName(ties))
    placed = live.select("a", "id").join(found, F.col("id") == F.col("node"), "left").select("a", F.coalesce("component", "id").alias("c"))
    both = F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    rest = written(_others(prefix, centres, placed, sets, num, den).join(stars.select(*both), ["x", "y"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = _linked(rest, sets, num, den)
        found = components(name(links.unionByName(more)).unionByName(ties))
        forget(more)
    forget(live, sets, prefix, centres, stars, links, rest)
    return found


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text): links are pairs with den * intersection >= num * union."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = written(docs.mapInArrow(partial(_profile, n=n), "doc_id long, n long, a long, b long"), "profile")
    known = profile.where("n > 0 AND doc_id IS NOT NULL")
    nodes = written(known.groupBy("a", "b", "n").agg(F.min("doc_id").alias("id")), "nodes")
    # Documents of one set belong together. They are named in two levels, by a salted part of them and by all parts: a text that fills a third of the table is no one task's.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    named = known.select("doc_id", "a", F.min("doc_id").over(Window.partitionBy("a", "b", "n", salt)).alias("part"), "b", "n")
    parts = named.select("part", "a", "b", "n").distinct().join(nodes, ["a", "b", "n"]).select("part", "a", "id")
    # Rows of one document belong together, whatever their texts are.
    again = known.groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = not again.isEmpty()
    if repeated:
        own = named.join(again, "doc_id").join(parts, ["part", "a"]).select("doc_id", "id").distinct()
        ties = own.select(F.col("id").alias("x"), F.min("id").over(Window.partitionBy("doc_id")).alias("y"))
    else:
        ties = spark.createDataFrame([], "x long, y long")
    found = _groups(docs, nodes, repeated, ties, n, num, den)
    settled = parts.join(found, F.col("id") == F.col("node"), "left").select("part", "a", F.coalesce("component", "id").alias("component"))
    of = named.join(settled, ["part", "a"]).select(F.col("doc_id").alias("node"), "component").distinct()
    out = profile.select("doc_id", F.col("n").alias("n_shingles")).join(of, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id; rows without an id all stay. Other columns, whatever their names are, stay as they are."""
    df, names = hidden(docs)
    key = f"c{[x.lower() for x in names].index('doc_id')}"
    groups = join(docs.select("doc_id", "text"), n, num, den).where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = df.where(F.col(key).isNotNull()).join(groups, key, "left_semi").dropDuplicates([key])
    return kept.select(*df.columns).unionByName(df.where(F.col(key).isNull())).toDF(*names)
