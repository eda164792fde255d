"""The queries of this subpackage: thin wrappers that apply an operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decision_list, decontaminate, jaccard_join, language_model, packing, pii, secrets, spans, toxicity, url_filter
from .common import bucket, table

#: Rules of the URL query, as (host, path, action).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    back = chat.read_back(chat.formatted(rows.unionByName(extra)), "conv", "block", "n_blocks")
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    parts = back.select("conv", "block", "n_blocks", "conv_id", F.struct("first_turn", spoken.alias("said"), F.array_join("loss", "").alias("loss")).alias("p"), F.size("turns").alias("n"), "n_chars")
    joined = lambda p, f: F.array_join(F.transform(p, lambda x: x[f]), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    # A block is put together where it lies; a conversation of one block, as nearly all are, is digested there and sends no text on.
    blocks = parts.groupBy("conv", "block", "n_blocks", "conv_id").agg(F.sum("n").alias("n"), F.sum("n_chars").alias("n_chars"), F.sort_array(F.collect_list("p")).alias("p"))
    blocks = blocks.select("conv", "block", "n_blocks", "conv_id", "n", "n_chars", F.expr("p[0].first_turn").alias("first"), joined("p", "said").alias("said"), joined("p", "loss").alias("loss"))
    alone = F.when(F.col("n_blocks") == 1, F.struct(digest("said").alias("said"), F.length("loss").alias("chars"), digest("loss").alias("loss")))
    convs = blocks.select("conv", "conv_id", "n", "n_chars", alone.alias("alone"), F.when(F.col("n_blocks") > 1, F.struct("first", "said", "loss")).alias("p"))
    convs = convs.groupBy("conv", "conv_id").agg(F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.max("alone").alias("alone"), F.sort_array(F.collect_list("p")).alias("p"))
    said, loss = joined("p", "said"), joined("p", "loss")
    convs = convs.withColumn("d", F.coalesce("alone", F.struct(digest(said).alias("said"), F.length(loss).alias("chars"), digest(loss).alias("loss"))))
    return convs.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("d.said").alias("turns_sha256"),
        F.col("d.chars").cast("long").alias("loss_chars"), F.col("d.loss").alias("loss_sha256"), "formatted_chars",
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").where(bucket("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.learn(docs.select("doc_id", "text"), labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.learn(docs, table(spark, sf_dir, "labels"))
    return decision_list.apply(docs.select("doc_id", "text"), rules).select("doc_id", *decision_list.COUNTS, "base_failed", "kept", "rule")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (bucket("doc_id", 10) == 0).alias("held_out"), "text")
    scored = language_model.score(docs, docs.where("NOT held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies, on the driver as on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.scan(docs, pii.fit(docs))
    every = F.concat("base", "added")
    return found.select(
        "doc_id", *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(spans.listing(F.col("base"), pii.KINDS, True), 256).alias("base_sha256"), spans.listing(every, pii.KINDS, True).alias("spans"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    every = F.concat("strong", F.transform("linked", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit("").alias("value"))))
    return found.select(
        "doc_id", *[spans.count(F.col("strong"), k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(spans.listing(F.col("strong"), secrets.KINDS, False), 256).alias("base_sha256"), spans.listing(every, secrets.KINDS, False).alias("spans"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_url_filters": op10_url_filters,
}

ORACLES: dict[str, str] = {
    "op10_url_filters": r"""
        WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r(rule_host, rule_path, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        hit AS (SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(action, length(rule_host || rule_path)) AS verdict
                FROM (SELECT DISTINCT host, path FROM p) q JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (host, path)
    """,
}
