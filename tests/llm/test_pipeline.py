"""The corpus pipeline: every stage on its own input, and the whole of it on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import decision_list, decontaminate, jaccard_join, packing, queries, secrets, url_filter

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents (clean ones, junk, copies, benchmark passages, secrets, nulls), labels and a benchmark."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", "", "", "", ".", ","]) for _ in range(n))
    texts, kind = [], []

    def add(name, *new):
        texts.extend(new)
        kind.extend([name] * len(new))

    add("clean", *[prose(r.randint(80, 300)) for _ in range(60)])
    add("junk", *[" ".join(r.choice(["#", "|", "$$$", "x1", "&&"]) for _ in range(150)) for _ in range(60)])
    add("short", "one two", "", None, " \n")
    items = [prose(30) for _ in range(5)]
    add("leak", *[prose(70) + " " + i + " " + prose(70) for i in items])
    add("copy", *[t for t in texts[:8]])
    add("near", *[t.replace(t.split()[40], "edit", 1) for t in texts[8:14]])
    add("secret", *[prose(70) + " token = abcdefgh1234 " + prose(20) for _ in range(5)])
    rows = [(i, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows + rows[:2], COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(kind[i] != "junk"), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts, kind


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_every_stage_on_the_whole(spark, corpus):
    d, texts, kind = corpus
    docs, left = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left[name] = docs.collect()
    of = lambda name: {kind[r.doc_id] for r in left[name]}
    assert of("quality_rules") == {"clean", "leak", "copy", "near", "secret"} and len(left["quality_rules"]) == 60 + 2 + 5 + 8 + 6 + 5
    assert sorted(r.doc_id for r in left["ngram_jaccard_join"]) == [i for i, k in enumerate(kind) if k in ("clean", "leak", "secret")]
    assert sorted(r.doc_id for r in left["benchmark_decontamination"]) == [i for i, k in enumerate(kind) if k in ("clean", "secret")]
    for r in left["secret_scan"]:
        want = texts[r.doc_id].replace("token = abcdefgh1234", "[SECRET]")
        assert r.text == want and r.n_chars == len(want)
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == {i for i, k in enumerate(kind) if k in ("clean", "secret")}


def test_stages_of_awkward_tables(spark, corpus):
    d, texts, kind = corpus
    awkward = spark.createDataFrame([(None, texts[0], None, None, None), (1, None, "en", None, 5), (1, "", "en", "web", 0), (7, "word " * 3000, "en", "web", None), (7, "word " * 3000, "en", "web", None)], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.limit(0), d).count() == 0, name
        stage(spark, awkward, d).collect()


def test_columns_that_operators_use_themselves(spark, corpus):
    """Extra columns of any name stay as they are, and change nothing."""
    d, texts, kind = corpus
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[60:130])], "doc_id long, text string")
    extra = ["key", "_key", "_s", "_c", "_w", "_g", "_p", "_l", "_bad", "_kept", "hit", "h", "a", "b", "n", "t", "c", "id", "x", "y", "raw", "parts", "node", "component", "_settled", "wanted", "short", "asked", "c0", "doc_key"]
    wide = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in extra])
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    rules = spark.createDataFrame([("com", "/x", "block")], "host string, path string, action string")
    empty = decision_list.DecisionList(())
    for f in (
        lambda df: secrets.redact(df), lambda df: secrets.scan(df), lambda df: decontaminate.clean(df, bench), lambda df: jaccard_join.one_per_group(df, n=3, num=90),
        lambda df: decision_list.apply(df, empty), lambda df: url_filter.judge(df.withColumn("url", F.lit("http://a.com/x")), rules),
    ):
        plain, own = f(docs), f(wide)
        assert set(own.columns) == set(plain.columns) | set(extra)
        key = lambda rows, names: sorted(str([r[c] for c in names]) for r in rows)
        rows = own.collect()
        assert key(rows, plain.columns) == key(plain.collect(), plain.columns)
        assert all(r[c] == f"own {c}" for r in rows for c in extra)


def test_recall_under_substitutions(spark):
    """Benchmark items of 30 to 60 tokens with 5 to 25 % of them replaced at random places, in prose: at least 0.9 are found in all."""
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [words(r.randint(30, 60)) for _ in range(60)]
    docs, want = [], []
    for share in (0.05, 0.1, 0.15, 0.2, 0.25):
        for k, item in enumerate(items):
            out = set(r.sample(range(len(item)), round(share * len(item))))
            docs.append(" ".join(words(40) + [r.choice(vocabulary) if i in out else w for i, w in enumerate(item)] + words(40)))
            want.append((share, k))
    docs += [" ".join(words(150)) for _ in range(100)]
    of = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(of(docs, "doc_id"), of([" ".join(i) for i in items], "item_id")).collect()}
    hits = {s: sum((i, k) in got for i, (share, k) in enumerate(want) if share == s) / len(items) for s in (0.05, 0.1, 0.15, 0.2, 0.25)}
    assert sum(hits.values()) / len(hits) >= 0.9 and hits[0.15] == 1.0, hits
    assert all(i < len(want) and want[i][1] == k for i, k in got)
    kept = {x.doc_id for x in decontaminate.clean(of(docs, "doc_id"), of([" ".join(i) for i in items], "item_id")).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in got}
