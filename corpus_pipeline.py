"""A corpus pipeline in five stages, each written as Parquet and read again as the next one's documents.

Every stage works on all that the one before kept: quality rules drop what they reject, of each group of near duplicates the smallest doc_id stays,
documents that overlap the benchmark go, documents with secrets are redacted (spans become ``[SECRET]``), and the rest is packed into sequences.

Defined results: null and empty texts fail the quality rules; rows that share a doc_id are one document, of which one row stays; a row without an id stays unless it is rejected or overlaps the
benchmark; an empty table gives none. Stages keep further columns, whatever they are called; ``n_chars`` follows the redacted text where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decision_list, decontaminate, jaccard_join, packing, secrets
from larkspur.llm.common import table
from larkspur.llm.queries import tokenizer_path
from larkspur.llm.storage import new_path, remove


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = decision_list.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return decision_list.apply(docs, rules).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_group(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", packed),
]
#: Learnt rules and tokenization are beyond SQL; tests/llm/test_pipeline.py holds every stage and the whole against what was planted, and the stages' operators have brute-force tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
