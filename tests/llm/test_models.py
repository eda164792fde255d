import re
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import elias_fano, language_model, queries, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, universe in ((0, 10), (1, 1), (1, 2**64), (5, 6), (1000, 1001), (1000, 10**12), (5000, 2**64), (3000, 700)):
        v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        e = elias_fano.EliasFano(elias_fano.encode(v, universe))
        assert np.array_equal(e[np.arange(n)], v)
        asked = np.concatenate([v, rng.integers(0, universe, 200, dtype=np.uint64)])
        first = rng.integers(0, n + 1, len(asked))
        last = np.maximum(first, rng.integers(0, n + 1, len(asked)))
        want = np.array([a + np.searchsorted(v[a:b], x) for x, a, b in zip(asked, first, last)], np.int64)
        assert np.array_equal(e.successor(asked, first, last), want)


def tokens(t):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + ["<end>"]


def brute(rows, train, shards_of=None):
    learnt = [tokens(t) for t in train]
    uni = Counter(w for s in learnt for w in s)
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    pairs = Counter(p for s in learnt for p in zip(["<start>", *s], s))
    seen, kinds = Counter(), Counter()
    for (a, _), c in pairs.items():
        seen[a] += c
        kinds[a] += 1
    n1, n2 = sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values())
    d = n1 / (n1 + 2 * n2) if n1 else 0.5

    def p2(a, w):
        return p1(w) if not seen[a] else max(pairs[a, w] - d, 0) / seen[a] * (pairs[a, w] > 0) + d * kinds[a] / seen[a] * p1(w)

    for t in rows:
        s = tokens(t)
        yield len(s), sum(uni[w] > 0 for w in s), n, sum(log10(p1(w)) for w in s), sum(log10(p2(a, w)) for a, w in zip(["<start>", *s], s))


def test_language_model_against_brute_force(spark):
    texts = [None, "", "the THE the", "never seen words", "a b a b a b\x0ba", *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    train = df.where("doc_id % 3 <> 0 OR doc_id = 0")
    got = {r.doc_id: r for r in language_model.score(df, train, shards=1).collect()}
    kept = [t for i, t in enumerate(texts) if i % 3 or i == 0]
    for i, want in enumerate(brute(texts, kept)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], abs=0.02 * want[0] + 0.05)
    many = {r.doc_id: r.score for r in language_model.score(df, train, shards=7).collect()}
    assert all(many[i] == pytest.approx(got[i].score, rel=1e-9) for i in got)
    files = {r.doc_id: r.score for r in language_model.score(df.repartition(3), train.repartition(20)).collect()}
    assert all(files[i] == pytest.approx(got[i].score, rel=1e-9) for i in got)
    none = language_model.score(df, train.limit(0)).collect()
    assert len(none) == len(texts) and all(r.train_tokens == 0 and r.n_known == 0 for r in none)
    assert language_model.score(df.limit(0), train).count() == 0


def test_scores_do_not_depend_on_shards(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    one, many = ({r.doc_id: r for r in language_model.score(df, df, shards=k).collect()} for k in (1, 64))
    assert all(many[i].score == pytest.approx(one[i].score, abs=0.01 * one[i].n_tokens + 0.02) for i in one)


def test_language_model_beats_its_base_on_held_out_texts(spark):
    base, score = queries.op4_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_kernel_tolerates_gaps_and_insertions():
    k = toxicity.Kernel(["idiot", "worthless"])
    near = k(["idiot", "idxiot", "idiots", "thing", "worthlessly"])
    assert near[0, 0] == pytest.approx(1) and near[1, 0] > 0.5 and near[2, 0] > 0.7 and near[3, 0] < 0.1 and near[4, 1] > 0.8
    assert toxicity.units("You I-D-I-O-T, i d i o t yes") == ["you", "idiot", "idiot", "yes"]

    def slow(s, t):  # all pairs of triples
        def feats(w):
            out = Counter()
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for m in range(j + 1, min(len(w), i + toxicity.SPAN)):
                        out[w[i], w[j], w[m]] += toxicity.DECAY ** (m - i + 1)
            return out
        a, b = feats(s), feats(t)
        norm = lambda x: sum(v * v for v in x.values()) ** 0.5
        return sum(a[f] * b[f] for f in a) / (norm(a) * norm(b))

    for w in ("idiiotic", "wrthls", "idiot"):
        assert k([w])[0] == pytest.approx([slow(w, "idiot"), slow(w, "worthless")], abs=1e-5)


def test_units_cover_whole_texts():
    assert toxicity.units("i - d - i - o - t") == ["idiot"] and toxicity.units("a - word , b") == ["word"]
    for n in (60, 64, 65, 96, 97, 128, 500):
        long = ",".join(["blume"] * (n // 5) + ["x" * (n % 5)] + ["idiot"])
        got, plain = toxicity.units(long), long.replace(",", "")
        assert all(len(w) <= 64 for w in got) and got[0] == plain[:64] and any(w.endswith("idiot") for w in got)
        assert all(any(plain[k : k + 32] in w for w in got) for k in range(len(plain) - 31))


def test_toxicity_awkward_rows(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("aeioubcdfgklmnprst"), 6)) for _ in range(300)]
    clean = [". ".join(" ".join(rng.choice(vocabulary, 8)) for _ in range(5)) for _ in range(150)]
    model = toxicity.fit(clean + [c + " you stupid idiot are worthless." for c in clean[:80]], [0] * 150 + [1] * 80, n_landmarks=24)
    texts = [None, "", "  ", "... !", clean[0], clean[0] + " you i-d-i-o-t stu-pid x", "idiot " * 5000, "😀" * 10]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = [r.score for r in toxicity.score(df, model).orderBy("doc_id").collect()]
    assert all(0 <= x <= 1 for x in got) and len(set(got[:4])) == 1 and got[4] < 0.3 and got[5] >= 0.3 and got[6] > got[4]
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.fit([], []).probability(np.zeros(1))[0] < 1e-6 and toxicity.fit(["a"], [1]).probability(np.zeros(1))[0] > 0.99


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.6 and hit / sum(r.toxic for r in rows) > 0.6
