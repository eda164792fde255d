import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import bytewords, components, jaccard_join, packing, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def shingles(text, n):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if i is not None and j is not None and a and b and len(a & b) * den >= len(a | b) * num:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def corpus(r):
    vocabulary = [f"v{i}" for i in range(60)] + ["The", "the", "Ünï"]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \t", "one", "One", "a b", "a b", "a c"]
    line = words(12)
    for _ in range(12):
        base = words(r.choice([8, 12, 20, 40, 90, 200, 400]))
        texts.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                k = r.randrange(len(near))
                if r.random() < 0.5:
                    near[k] = "edit"
                else:
                    near.insert(k, "new")
            texts.append("  ".join(near))
        texts.append(" ".join(line + words(r.choice([2, 3, 10]))))
    return texts


@pytest.mark.parametrize("n,num,den,seed", [(3, 90, 100, 1), (5, 80, 100, 2), (2, 50, 100, 3)])
def test_join_against_brute_force(spark, n, num, den, seed):
    rows = list(enumerate(corpus(random.Random(seed)))) + [(None, "a b c d e"), (3, "one"), (20, "quite another text of its own")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(df, n, num, den).collect()), key=str)
    assert got == brute(rows, n, num, den)


def test_join_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op5_ngram_jaccard_join(spark, SF).collect()), key=str)
    assert got == brute(docs, 3, 90, 100)


def test_join_of_nothing_and_one_per_group(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(empty).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (9, None), (7, "g h i j k l m")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in jaccard_join.one_per_group(df).collect()) == ["2", "7", "9", "None"]


def test_first_fragment_counts():
    """Sent rows and balances together count what no other set has, however sets are dealt over tasks."""
    rng = np.random.default_rng(0)
    for num in (90, 80, 60, 10):
        end = jaccard_join.first_fragment(num, 100)
        pool = rng.integers(0, 2**64, 400, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(pool, 60), rng.integers(0, 2**64, 20, dtype=np.uint64)])) for _ in range(30)]
        df = {}
        for s in sets:
            for g in s.tolist():
                df[g] = df.get(g, 0) + 1
        want = [sum(df[g] == 1 for g in s[: np.searchsorted(s, np.uint64(end))].tolist()) for s in sets]
        owners, balance = {}, [0] * len(sets)
        for task in (range(0, 11), range(11, 12), range(12, 30)):
            g, o, k = jaccard_join.local_counts([sets[i] for i in task], end)
            for x, y in zip(g.tolist(), o.tolist(), strict=True):
                owners.setdefault(x, []).append(task[y])
            for y, v in enumerate(k.tolist()):
                balance[task[y]] += v
        for own in owners.values():
            for i in own:
                balance[i] += len(set(own)) > 1
        assert [-b for b in balance] == want
    assert len(jaccard_join.local_counts([], 5)[0]) == 0


@pytest.mark.parametrize("block", [1024, 3])
def test_join_of_groups_at_the_threshold(spark, monkeypatch, block):
    """Near copies of which some pairs link and some do not, chains, and passages that many share: against brute force, with many blocks too."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    r = random.Random(11)
    passage, rows = [f"p{i}" for i in range(60)], []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(r.choice([40, 60, 90]))]
        for _ in range(14):
            near = list(base)
            for k in r.sample(range(len(base)), r.choice([0, 1, 2, 3])):
                near[k] = r.choice(["edit", f"e{r.random()}"])
            rows.append(" ".join(near))
        for k in range(10):  # a chain: each drops one more word in front
            rows.append(" ".join(base[k:] + [f"t{group}x{j}" for j in range(k)]))
    rows += [" ".join(passage + [f"u{i}x{j}" for j in range(r.choice([5, 20, 60]))]) for i in range(20)]
    rows = list(enumerate(rows)) + [(3, rows[50]), (70, "quite another text"), (70, rows[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n, num in ((3, 90), (5, 80), (1, 80)) if block == 1024 else ((3, 90),):
        got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join(df, n, num, 100).collect()), key=str)
        assert got == brute(rows, n, num, 100)


def test_word_hashes_follow_words():
    texts = [None, "", "a", " A  b\x0bA ", "äÄ ä", "x" * 3000, "b", "z\u00a0z z"] + [r for r in corpus(random.Random(9))]
    h, at = bytewords.word_hashes(pa.array(texts))
    names = {}
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t or ""))
        assert at[i + 1] - at[i] == len(w)
        for x, y in zip(w, h[at[i] : at[i + 1]].tolist(), strict=True):
            assert names.setdefault(x, y) == y
    assert len(set(names.values())) == len(names)
    old, bytewords.SLICE = bytewords.SLICE, 64
    try:
        assert np.array_equal(bytewords.word_hashes(pa.array(texts))[0], h)
        assert list(bytewords.slices(pa.array(texts), 50))[-1][1] == len(texts)
    finally:
        bytewords.SLICE = old
    part = pa.array(texts).slice(3, 4)
    assert np.array_equal(bytewords.word_hashes(part)[0], h[at[3] : at[7]])


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def check_packing(rows, ids_of, size):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    for doc, own in by_doc.items():
        ids, own = ids_of[doc], sorted(own, key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0 and sum(r.length for r in own) == len(ids)
        assert all(r.length == size for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    return by_sequence


def test_packing_query(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.tokenizer_path())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids_of = {k: [*coder.encode(t, add_special_tokens=False).ids, 0] for k, t in docs.items()}
    rows = queries.op9_best_fit_packing(spark, SF).collect()
    sequences = check_packing(rows, ids_of, 2048)
    assert {r.doc_id for r in rows} == set(docs) and len(sequences) <= 1.02 * -(-sum(map(len, ids_of.values())) // 2048) + 1


def test_packing_awkward_rows(spark):
    texts = [None, "", "<|endoftext|> a", "é 漢字 😀 it's 'sound' I'll  \n\n x\t", "ab " * 3000, " " * 4000]
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.tokenizer_path())
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int").withColumn("length", F.lit("clash"))
    check_packing(packing.pack(df, queries.tokenizer_path(), 64).collect(), {i: [*coder.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}, 64)
    assert packing.pack(df.limit(0), queries.tokenizer_path()).count() == 0


def sweep(rows):
    """The items, in order, with the gap that each takes: the smallest one before it that is free."""
    free, took = [], {}
    for k, gap in enumerate(rows):
        if gap:
            free.append(k)
        elif free:
            took[k] = free.pop()
    return took


def test_sweep_over_ranges():
    r = random.Random(2)
    for _ in range(200):
        rows = [r.random() < 0.5 for _ in range(r.randint(1, 60))]
        gap, item = packing.brackets(np.array(rows))
        assert dict(zip(item.tolist(), gap.tolist(), strict=True)) == sweep(rows)
        # The same rows in ranges: matches inside them and those between them by rank give the same.
        edges = sorted({0, len(rows), *(r.randint(0, len(rows)) for _ in range(6))})
        got, left, places = {}, [], {}
        for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            own = sweep(rows[a:b])
            got |= {a + i: a + g for i, g in own.items()}
            items = [k for k in range(a, b) if not rows[k] and k - a not in own]
            gaps = [k for k in range(a, b) if rows[k] and k - a not in own.values()][::-1]
            left.append((p, len(items), len(gaps)))
            places[p] = items, gaps
        runs = packing.between(left)
        for n, (p, rank, q, first) in enumerate(runs):
            end = runs[n + 1][1] if n + 1 < len(runs) and runs[n + 1][0] == p else left[p][1]
            if q >= 0:
                got |= {places[p][0][rank + j]: places[q][1][first + j] for j in range(end - rank)}
        assert got == sweep(rows)


def test_fit_is_tight(spark):
    r = random.Random(4)
    cases = {
        "mixed": [r.randint(1, 200) for _ in range(1500)], "halves": [101] * 40 + [99] * 40, "equal": [67] * 300, "whole": [200] * 30,
        "over": [150] * 50 + [60] * 10, "one": [1], "tiny": [1] * 2000 + [r.randint(1, 9) for _ in range(500)],
    }
    for name, lengths in cases.items():
        df = spark.createDataFrame(list(enumerate(lengths)), "item long, length long").repartition(5)
        rows = packing.fit(df, 200).collect()
        assert sorted(x.item for x in rows) == list(range(len(lengths)))
        at = {}
        for x in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
            assert at.get(x.sequence_id, 0) == x.offset
            at[x.sequence_id] = x.offset + lengths[x.item]
        gaps = []  # best-fit decreasing
        for n in sorted(lengths, reverse=True):
            fit = [k for k, g in enumerate(gaps) if g >= n]
            if fit:
                gaps[min(fit, key=lambda k: gaps[k])] -= n
            else:
                gaps.append(200 - n)
        assert max(at.values()) <= 200 and len(at) <= 1.02 * len(gaps) + 1, (name, len(at), len(gaps))
