"""URL filters: host-suffix and path-prefix expressions matched against rules by hash.

A URL is expanded into every (suffix of its host, prefix of its path) that a rule could name; expressions meet the
rules in an equi-join on the first 32 bits of their SHA-256, the whole digest confirms a hit, and the longest rule wins.
Work is done once per distinct (host, path), so a URL that fills a third of the table is judged once.

Defined results: a null URL or one without ``://`` has an empty host and path; an empty host matches no rule; repeated
rows are all kept; of two rules with the same host and path, ``block`` wins; an empty rule table leaves the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden, lower_ascii

#: Rules up to this many rows are broadcast (about 100 bytes each); larger tables are joined by a shuffle on the hash.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """All host suffixes that start at a label, each with the path prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("host"), p.alias("path")))))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules: host, path, action (``allow`` or ``block``). One row per (host, path), with digest and precedence."""
    return (
        rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .where("action IN ('allow', 'block') AND host <> ''")
        .groupBy("host", "path").agg(F.max("action").alias("action"))
        .withColumn("digest", _digest(F.col("host"), F.col("path"))).withColumn("short", F.substring("digest", 1, 8))
        .withColumn("rank", F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h")))
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added (columns of those names are replaced)."""
    ready = prepare_rules(rules)
    lengths = sorted(r[0] for r in ready.select(F.length("path")).distinct().collect())  # at most as many as a URL has characters
    given = pages.select(F.col(url).alias("u"), *[F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")])
    df, names = hidden(given)
    parts = df.withColumn("host", host_of(F.col("c0"))).withColumn("path", path_of(F.col("c0")))
    rest = [F.col(f"c{k}").alias(c) for k, c in enumerate(names) if k]
    if not lengths:
        return parts.select(*rest, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if ready.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        ready = F.broadcast(ready)
    asked = (
        parts.where("host <> ''").select("host", "path").distinct()
        .select(F.col("host").alias("url_host"), F.col("path").alias("url_path"), F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("e"))
        .withColumn("asked", _digest(F.col("e.host"), F.col("e.path"))).withColumn("short", F.substring("asked", 1, 8))
    )
    best = (
        asked.join(ready, "short").where("asked = digest")
        .groupBy("url_host", "url_path").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "action"), "rank").alias("hit"))
    )
    found = parts.join(best, (parts.host == best.url_host) & (parts.path == best.url_path), "left")
    return found.select(*rest, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"))
