"""LM scoring with an Elias-Fano n-gram trie.

The trie has two levels, cut into shards by the hash of the context word; a shard is a folder of memory-mapped arrays in the shared folder. Level one holds the
shard's words (sorted hashes as an Elias-Fano sequence), their counts, 16-bit back-off weights, and monotone pointers into level two. Level two holds each word's
successors: ids made monotone by their context's offset, as one Elias-Fano sequence, and 16-bit codes of smoothed log-probabilities. A bigram is looked up by a
successor search between its context's pointers, so it costs a few bits read in place and no table is held in memory.

Smoothing is interpolated absolute discounting, p(w|v) = max(c(vw) - D, 0) / c(v) + D n(v) / c(v) p(w), with D = n1 / (n1 + 2 n2) and the additive unigram p(w) = (c + 0.1) / (N + 0.1 (V + 1)).
Everything is counted over all training rows: partitions send each shard their distinct words and bigrams with counts, so a frequent pair is one entry per partition. n1 and n2 are
summed over all shards before any shard is written, and all codes are of one grid that the totals fix, so a score depends on the rows alone, not on shards or files.

Tokens: lower-cased (A-Z) words and one end per text; the context of a text's first token is its start.

Defined results: a null text is empty and has the end alone; unseen words have count 0; without training rows every probability is that of count 0 among none (1); repeated rows count
as often as they occur and are all kept.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import U, slices, word_hashes
from .elias_fano import EliasFano, encode
from .storage import new_path, ship

ADD = 0.1
START, END = U(0x5374617274), U(0x456E64)  # hashes of the start and the end; both lie in shard 0
#: Distinct entries that a task gathers before it sends them.
GATHER = 2_000_000
BLOB = "shard int, blob binary"


def local(path: str) -> str:
    """A path that every executor can map: the shared folder must be a mounted one."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the trie is memory-mapped: spark.checkpoint.dir must be a mounted folder, not {parts.scheme}:")
    return parts.path


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with START before and END after; where each text's start lies (and one more)."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    begin = np.concatenate(([0], np.cumsum(n + 2)))
    out = np.empty(begin[-1], U)
    out[begin[:-1]], out[begin[1:] - 1] = START, END
    inner = np.ones(len(out), bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    out[inner] = h
    return out, begin


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U(32)) * U(shards)) >> U(32)


def _squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts: differences, byte by byte, compressed."""
    planes = np.concatenate([np.diff(keys, prepend=U(0)), counts.astype(U)]).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.compress(planes, 1)


def _expand(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1).T).view(U).ravel()
    n = len(both) // 2
    return np.cumsum(both[:n], dtype=U), both[n:].astype(np.int64)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _blobs(by_shard: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for s, parts in sorted(by_shard.items()):
        keys, counts = _merge([p[0] for p in parts], [p[1] for p in parts])
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_squeeze(keys, counts)], pa.binary())], names=["shard", "blob"])


def _gathered(entries: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """entries: shard, key, count, sorted by shard. A blob for each shard whenever enough has gathered."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0
    for shard, key, count in entries:
        cuts = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
            held.setdefault(int(shard[a]), []).append((key[a:b], count[a:b]))
        size += len(key)
        if size > GATHER:
            yield from _blobs(held)
            held, size = {}, 0
    yield from _blobs(held)


def _words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    def entries() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                k, c = np.unique(_tokens(batch.column(0).slice(a, b - a))[0], return_counts=True)
                yield shard_of(k, shards), k, np.where(k == START, 0, c)

    yield from _gathered(entries())


def _save(folder: str, arrays: dict[str, np.ndarray]) -> None:
    """Written beside and moved into place, so a task that runs twice leaves one whole folder."""
    beside = f"{folder}.{uuid.uuid4().hex}"
    os.makedirs(beside)
    for name, a in arrays.items():
        np.save(f"{beside}/{name}.npy", a)
    try:
        os.rename(beside, folder)
    except OSError:
        if not os.path.isdir(folder):
            raise
        shutil.rmtree(beside)  # another attempt of this task has written the same


def _mapped(path: str) -> np.ndarray:
    """A memory-mapped array, as a plain view: it is read in place all the same, and indexing costs less."""
    return np.load(path, mmap_mode="r").view(np.ndarray)


def _load(folder: str, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {n: _mapped(f"{folder}/{n}.npy") for n in names}


_SEQUENCE = ("low", "high", "ones", "zeros", "shape")


def _sequence(folder: str, name: str) -> EliasFano:
    return EliasFano({k: _mapped(f"{folder}/{name}_{k}.npy") for k in _SEQUENCE})


def _prefixed(name: str, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    return {f"{name}_{k}": v for k, v in encode(values, universe).items()}


def _write_words(group: pa.Table, path: str) -> pa.Table:
    shard = group.column("shard")[0].as_py()
    parts = [_expand(b) for b in group.column("blob").to_pylist()]
    keys, counts = _merge([p[0] for p in parts], [p[1] for p in parts])
    _save(f"{path}/words-{shard}", _prefixed("word", keys, 2**64) | {"count": counts})
    return pa.table({"shard": pa.array([shard], pa.int32()), "words": pa.array([len(keys)], pa.int64()), "known": pa.array([int((counts > 0).sum())], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})


class Words:
    """Level one: ids (rank of the hash over all shards) and counts of words."""

    def __init__(self, path: str, offsets: list[int]):
        self.path, self.offsets, self.open = path, offsets, {}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """h: sorted and distinct. Ids (-1: unknown) and counts."""
        shards = len(self.offsets) - 1
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        edges = np.searchsorted(shard_of(h, shards), np.arange(shards + 1, dtype=U))
        for s in range(shards):
            a, b = edges[s], edges[s + 1]
            if a == b or self.offsets[s] == self.offsets[s + 1]:
                continue
            if s not in self.open:
                self.open[s] = _sequence(f"{self.path}/words-{s}", "word"), _mapped(f"{self.path}/words-{s}/count.npy")
            words, count = self.open[s]
            there, at = words.find(h[a:b], np.zeros(b - a, np.int64), np.full(b - a, words.n))
            ids[a + there] = self.offsets[s] + at[there]
            counts[a + there] = count[at[there]]
        return ids, counts


def _pairs(tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (sorted), and each token's (but starts) word and context, as places among them."""
    words, place = np.unique(tokens, return_inverse=True)
    after = np.ones(len(tokens), bool)
    after[begin[:-1]] = False
    after = np.flatnonzero(after)
    return words, place[after], place[after - 1], after


def _bigrams(batches: Iterator[pa.RecordBatch], path: str, offsets: list[int]) -> Iterator[pa.RecordBatch]:
    level, bounds = Words(path, offsets), np.array(offsets)

    def entries() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                words, w, v, _ = _pairs(*_tokens(batch.column(0).slice(a, b - a)))
                ids = level.find(words)[0]
                if bounds[-1] >= 2**32:
                    raise ValueError("more than 2^32 distinct words: bigram keys hold ids of 32 bits")
                key, count = np.unique((ids[v].astype(U) << U(32)) | ids[w].astype(U), return_counts=True)
                shard = np.searchsorted(bounds, (key >> U(32)).astype(np.int64), "right") - 1
                yield shard, key - (bounds[shard].astype(U) << U(32)), count

    yield from _gathered(entries())


#: Steps of the grid of log-probabilities.
STEPS = 2**16 - 1


def grid(n: int, v: int, discount: float) -> float:
    """The step of the grid, from 0 to the least log-probability that the totals allow (a word seen once, after the commonest context that one can think of)."""
    return float(np.log10(discount / max(n, 1)) + np.log10(_unigram(1, n, v)) - 1) / STEPS


def _quantise(x: np.ndarray, step: float) -> np.ndarray:
    """16-bit codes: multiples of step."""
    return np.clip(np.rint(x / step), 0, STEPS).astype(np.uint16)


def _merge_bigrams(group: pa.Table, path: str) -> pa.Table:
    """Keep a shard's counted bigrams, and tell how many occur once and twice: the discount is of all shards."""
    shard = group.column("shard")[0].as_py()
    parts = [_expand(b) for b in group.column("blob").to_pylist()]
    keys, counts = _merge([p[0] for p in parts], [p[1] for p in parts])
    _save(f"{path}/pairs-{shard}", {"blob": np.frombuffer(_squeeze(keys, counts), np.uint8)})
    return pa.table({"shard": pa.array([shard], pa.int32()), "n1": pa.array([int((counts == 1).sum())], pa.int64()), "n2": pa.array([int((counts == 2).sum())], pa.int64())})


def _write_shards(batches: Iterator[pa.RecordBatch], **how) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.column(0).to_pylist():
            yield _write_bigrams(int(shard), **how)


def _write_bigrams(shard: int, path: str, offsets: list[int], n: int, v: int, discount: float) -> pa.RecordBatch:
    keys, counts = _expand(np.load(f"{path}/pairs-{shard}/blob.npy").tobytes())
    context, word = (keys >> U(32)).astype(np.int64), keys & U(2**32 - 1)
    size, total = offsets[shard + 1] - offsets[shard], offsets[-1]
    seen, kinds = np.bincount(context, counts, minlength=size), np.bincount(context, minlength=size)
    weight = np.where(seen > 0, discount * kinds / np.maximum(seen, 1), 1.0)
    # The words' own probabilities: successors are of every shard, so they are looked up in level one by id.
    p = np.maximum(counts - discount, 0) / seen[context] + weight[context] * _unigram(_counts_of(path, offsets, word), n, v)
    step = grid(n, v, discount)
    code, back = _quantise(np.log10(p), step), _quantise(np.log10(np.maximum(weight, 1e-12)), step)
    pointers = np.concatenate(([0], np.cumsum(kinds)))
    _save(f"{path}/next-{shard}", _prefixed("pointer", pointers, int(pointers[-1]) + 1) | _prefixed("next", context.astype(U) * U(total) + word, max(size, 1) * total) | {"code": code, "back": back, "step": np.array([step])})
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64())], names=["shard", "bigrams"])


def _counts_of(path: str, offsets: list[int], ids: np.ndarray) -> np.ndarray:
    out, bounds = np.zeros(len(ids), np.int64), np.array(offsets)
    shard = np.searchsorted(bounds, ids.astype(np.int64), "right") - 1
    for s in np.unique(shard):
        on = shard == s
        out[on] = _mapped(f"{path}/words-{s}/count.npy")[ids[on].astype(np.int64) - bounds[s]]
    return out


def _unigram(count: np.ndarray, n: int, v: int) -> np.ndarray:
    return (count + ADD) / (n + ADD * (v + 1))


class Trie:
    def __init__(self, path: str, offsets: list[int], n: int, v: int):
        self.words, self.path, self.offsets, self.n, self.v, self.open = Words(path, offsets), path, np.array(offsets), n, v, {}

    def _next(self, s: int):
        if s not in self.open:
            folder = f"{self.path}/next-{s}"
            self.open[s] = (_sequence(folder, "pointer"), _sequence(folder, "next"), _load(folder, ("code", "back", "step"))) if os.path.isdir(folder) else None
        return self.open[s]

    def log10(self, v: np.ndarray, w: np.ndarray, uni: np.ndarray) -> np.ndarray:
        """Of words after contexts (ids, -1: unknown), given the words' own probabilities. v is sorted."""
        out = np.log10(uni)
        shard = np.searchsorted(self.offsets, v, "right") - 1
        cuts = np.flatnonzero(np.diff(shard, prepend=-2))
        for a, b in zip(cuts, [*cuts[1:], len(v)], strict=True):
            if v[a] < 0 or (level := self._next(int(shard[a]))) is None:
                continue
            pointer, succ, arrays = level
            context = v[a:b] - self.offsets[shard[a]]
            first, last = pointer[context].astype(np.int64), pointer[context + 1].astype(np.int64)
            value = context.astype(U) * U(self.offsets[-1]) + np.maximum(w[a:b], 0).astype(U)
            hit, at = succ.find(value, first, last)
            hit = hit[w[a:b][hit] >= 0]
            res = out[a:b] + np.where(last > first, arrays["back"][context] * arrays["step"][0], 0.0)
            res[hit] = arrays["code"][at[hit]] * arrays["step"][0]
            out[a:b] = res
        return out


def _scored(batches: Iterator[pa.RecordBatch], path: str, offsets: list[int], n: int, v: int) -> Iterator[pa.RecordBatch]:
    trie = Trie(path, offsets, n, v)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for a, b in slices(texts):
            tokens, begin = _tokens(texts.slice(a, b - a))
            words, w, c, after = _pairs(tokens, begin)
            ids, counts = trie.words.find(words)
            uni = _unigram(counts, n, v) if n else np.ones(len(words))
            pair, which = np.unique((c.astype(U) << U(32)) | w.astype(U), return_inverse=True)
            left, right = (pair >> U(32)).astype(np.int64), (pair & U(2**32 - 1)).astype(np.int64)
            p = trie.log10(ids[left], ids[right], uni[right])[which]
            at = begin[:-1] - np.arange(len(begin) - 1)  # each text's first token once starts are left out
            sums = lambda x, at=at: np.add.reduceat(x, at) if len(at) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*[k.slice(a, b - a) for k in batch.columns[:-1]], pa.array(np.diff(begin) - 1, pa.int64()), pa.array(sums((counts[w] > 0).astype(np.int64)), pa.int64()), pa.array(sums(np.log10(uni)[w])), pa.array(sums(p))],
                names=[*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"],
            )


def score(docs: DataFrame, train: DataFrame, text: str = "text", shards: int | None = None) -> DataFrame:
    """The columns of docs but the text, with n_tokens, n_known, train_tokens, base_score and score, by the model of train's texts."""
    spark = docs.sparkSession
    ship(spark)
    path = local(new_path(spark, "trie"))
    os.makedirs(path, exist_ok=True)
    learnt = train.select(text)
    shards = shards or max(8, learnt.rdd.getNumPartitions())  # so that a shard is about as large as a partition
    words = learnt.mapInArrow(partial(_words, shards=shards), BLOB).groupBy("shard").applyInArrow(lambda t: _write_words(t, path), "shard int, words long, known long, tokens long").collect()
    sizes = {r.shard: r.words for r in words}
    n, v = sum(r.tokens for r in words), sum(r.known for r in words)
    offsets = np.concatenate(([0], np.cumsum([sizes.get(s, 0) for s in range(shards)]))).tolist()
    if words:
        pairs = learnt.mapInArrow(partial(_bigrams, path=path, offsets=offsets), BLOB).groupBy("shard").applyInArrow(lambda t: _merge_bigrams(t, path), "shard int, n1 long, n2 long").collect()
        n1, n2 = sum(r.n1 for r in pairs), sum(r.n2 for r in pairs)
        there = spark.createDataFrame([(r.shard,) for r in pairs], "shard int").repartition(len(pairs))
        how = {"path": path, "offsets": offsets, "n": n, "v": v, "discount": n1 / (n1 + 2 * n2) if n1 else 0.5}
        there.mapInArrow(partial(_write_shards, **how), "shard int, bigrams long").collect()
        for r in pairs:
            shutil.rmtree(f"{path}/pairs-{r.shard}")
    others = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    ready = docs.select(*others, text)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ready.schema.fields[:-1])
    scored = ready.mapInArrow(partial(_scored, path=path, offsets=offsets, n=n, v=v), fields + "n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
