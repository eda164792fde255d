"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; everything else is part of a word.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def bucket(key: str | Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n: a split that every engine can repeat."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % n


def add_row_id(df: DataFrame, name: str, *parts: Column) -> DataFrame:
    """A 128-bit key of the given columns: equal rows get equal keys, whatever the partitions are."""
    return df.withColumn(name, F.md5(F.to_binary(F.concat_ws("\x00", *[F.coalesce(F.hex(p.cast("string")), F.lit("-")) for p in parts]), F.lit("utf-8"))))


def text_key(text: Column) -> Column:
    """Two 64-bit hashes: a key of a text that is cheap to shuffle."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def hidden(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1 and so on, and their names: an operator's own columns then clash with none, however the input's are called."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), df.columns


def settle(df: DataFrame, *columns: str) -> DataFrame:
    """df with these columns computed once: they come out of a generator, which no filter on them is pushed below.

    Without it the optimizer replaces a column in a filter by its expression, as often as it occurs.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("_settled")).select(*rest, *[F.col(f"_settled.{c}").alias(c) for c in columns])
