"""Best-fit packing in bulk-synchronous supersteps.

Documents become pieces of at most ``size`` tokens, the items. Gaps start as that many whole sequences as the tokens fill. A superstep range-sorts items and gaps together, longest first, and sweeps them: an
item takes the smallest gap before it that is still free, as a closing bracket takes its opening one, so no two items compete. A task sweeps its range alone; what stays open there is a run of items, then a
run of gaps, and these are matched between ranges by rank: the driver sees two counts a range and gives ranges of ranks, and a join brings the ranks together. A gap that holds the longest item left several
times is offered as so many parts. Gaps shrink by what they took, and the next superstep follows with the items that are left. Items longer than every gap get new sequences.

Defined results: a null text is empty and gives one piece, the end id; rows that repeat are packed as often; an empty table gives no rows; size must be positive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import ship, written

SIZE, END = 2048, 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A swept row: an item with its gap if both are there, else one that stays open, by its rank in its range.
SWEPT = "item long, length long, sequence long, gap long, part int, rank long"
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The vocabulary of a tokenizers file, run by tiktoken: the same ids, several times faster. ``<|endoftext|>`` in a text is its special token, as the file says."""
    if path not in _encoders:
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The file spells bytes as printable characters: printable Latin-1 stands for itself, the others for 256 and on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    """Pieces, each with a number of its own."""
    coder = encoder(path)
    item = TaskContext.get().partitionId() << 40
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.array([*coder.encode(text or "", allowed_special="all"), end], "<u4")
            first = len(ids) % size or size
            for k, start in enumerate([0, *range(first, len(ids), size)]):
                part = ids[start : first if k == 0 else start + size]
                for column, x in zip(rows, (doc, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                    column.append(x)
        n = len(rows[0])
        columns = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:]], pa.array(np.arange(item, item + n))]
        item += n
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "item"])


def brackets(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of gaps and of the items that take them: each item the nearest free gap before it, as brackets match."""
    depth = np.cumsum(np.where(is_gap, 1, -1))
    level = depth + ~is_gap  # of a gap after it, of an item before it: a path crosses a level up and down in turn
    order = np.argsort(level, kind="stable")
    a, b = order[:-1], order[1:]
    pair = (level[a] == level[b]) & is_gap[a] & ~is_gap[b]
    return a[pair], b[pair]


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of gaps and items, longest first: its matches, and what stays open with ranks (items in order, gaps from the last)."""
    rows = list(batches)
    if not rows:
        return
    is_gap, length, key = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in rows]) for c in ("is_gap", "length", "key"))
    gap, item = brackets(is_gap)
    open_ = np.ones(len(key), bool)
    open_[gap] = open_[item] = False
    items, gaps = np.flatnonzero(open_ & ~is_gap), np.flatnonzero(open_ & is_gap)[::-1]
    n, m, k = len(item), len(items), len(gaps)
    at_item, at_gap = np.concatenate([item, items, np.zeros(k, np.int64)]), np.concatenate([gap, np.zeros(m, np.int64), gaps])
    no_item, no_gap = np.arange(n + m + k) >= n + m, (np.arange(n + m + k) >= n) & (np.arange(n + m + k) < n + m)
    rank = np.concatenate([np.zeros(n, np.int64), np.arange(m), np.arange(k)])
    part = np.full(n + m + k, TaskContext.get().partitionId(), np.int32)
    columns = [pa.array(key[at_item], mask=no_item), pa.array(length[at_item], mask=no_item), pa.array(key[at_gap], mask=no_gap), pa.array(length[at_gap], mask=no_gap), pa.array(part), pa.array(rank)]
    yield pa.RecordBatch.from_arrays(columns, names=["item", "length", "sequence", "gap", "part", "rank"])


def between(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """left: for each range, in order, its number and how many items and gaps stayed open. Matches between ranges as
    (range of the items, first rank, range of the gaps, first rank), each up to the next one of its range; no gaps (-1) end the list of a range.
    """
    stack: list[list[int]] = []  # range, next rank, how many
    out = []
    for part, items, gaps in left:
        rank = 0
        while rank < items and stack:
            top = stack[-1]
            took = min(items - rank, top[2])
            out.append((part, rank, top[0], top[1]))
            rank, top[1], top[2] = rank + took, top[1] + took, top[2] - took
            if not top[2]:
                stack.pop()
        if rank < items:
            out.append((part, rank, -1, 0))
        if gaps:
            stack.append([part, 0, gaps])
    return out


def _ranked(batches: Iterator[pa.RecordBatch], runs: list[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Open items with the range and rank of their gaps, or with keys of their own that no gap has."""
    by_part: dict[int, list[np.ndarray]] = {}
    for part in {r[0] for r in runs}:
        by_part[part] = [np.array(c, np.int64) for c in zip(*[r[1:] for r in runs if r[0] == part], strict=True)]
    for batch in batches:
        part, rank = batch.column("part").to_numpy(), batch.column("rank").to_numpy()
        to, at = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        for p in np.unique(part).tolist():
            on = np.flatnonzero(part == p)
            first, of, first_gap = by_part[p]
            k = np.searchsorted(first, rank[on], "right") - 1
            to[on] = np.where(of[k] < 0, -1 - p, of[k])
            at[on] = np.where(of[k] < 0, rank[on], first_gap[k] + rank[on] - first[k])
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("length"), pa.array(to), pa.array(at)], names=["item", "length", "to", "at"])


def _superstep(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """state: is_gap, length, key. What the ranges matched inside them and what came of the rest, as two tables of item, length, sequence and gap (nulls: nothing matched).

    They are written: a checkpoint keeps the plan's constraints, which grow from step to step.
    """
    order = [F.col("length").desc(), F.col("is_gap").desc(), F.col("key")]
    swept = written(state.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_swept, SWEPT), "swept")
    counts = swept.where("item IS NULL OR sequence IS NULL").groupBy("part").agg(F.count("item"), F.count("sequence")).collect()  # a row a range
    runs = between(sorted(tuple(r) for r in counts))
    items = swept.where("sequence IS NULL").mapInArrow(partial(_ranked, runs=runs), "item long, length long, to long, at long")
    gaps = swept.where("item IS NULL").select("sequence", "gap", F.col("part").cast("long").alias("to"), F.col("rank").alias("at"))
    met = written(items.join(gaps, ["to", "at"], "full").select("item", "length", "sequence", "gap"), "met")
    return swept.where("item IS NOT NULL AND sequence IS NOT NULL").select("item", "length", "sequence", "gap"), met


def fit(items: DataFrame, size: int) -> DataFrame:
    """item, sequence_id and offset (its place there) for each of items (item, length), packed into sequences of at most size."""
    spark = items.sparkSession
    flag = lambda x: F.lit(x).alias("is_gap")
    state = items.select(flag(False), "length", F.col("item").alias("key"))
    placed = items.select("item", "length", F.lit(0).cast("long").alias("sequence_id")).where("false")
    opened = 0
    while left := {(r.is_gap, r["length"]): r["count"] for r in state.groupBy("is_gap", "length").count().collect()}:  # at most 2 * size rows
        lengths = [n for is_gap, n in left if not is_gap]
        if not lengths:
            break
        # Items that no gap can take open new sequences: as many as their tokens fill. At first these are all items.
        widest = max((n for is_gap, n in left if is_gap), default=0)
        new = -(-sum(n * c for (is_gap, n), c in left.items() if not is_gap and n > widest) // size)
        gaps = state.where("is_gap").unionByName(spark.range(opened, opened + new).select(flag(True), F.lit(size).cast("long").alias("length"), F.col("id").alias("key")))
        opened += new
        # Parts of a gap differ by the remainder, which the first one gets; each holds any item that is left.
        parts = F.greatest(F.lit(1), F.expr(f"length div {max(lengths)}"))
        gaps = gaps.where(F.col("length") >= min(lengths)).select("*", parts.alias("parts")).select("*", F.explode(F.sequence(F.lit(1), "parts")).alias("which"))
        gaps = gaps.select(flag(True), F.expr("length div parts + if(which = 1, length % parts, 0)").alias("length"), "key")
        inside, rest = _superstep(gaps.unionByName(state.where("NOT is_gap")))
        took = inside.unionByName(rest.where("sequence IS NOT NULL"))
        placed = placed.unionByName(took.where("item IS NOT NULL").select("item", "length", F.col("sequence").alias("sequence_id")))
        gaps = took.groupBy("sequence").agg(F.sum(F.col("gap") - F.coalesce("length", F.lit(0))).alias("length")).where("length > 0")
        state = gaps.select(flag(True), "length", F.col("sequence").alias("key")).unionByName(rest.where("sequence IS NULL").select(flag(False), "length", F.col("item").alias("key")))
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("item", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text)."""
    ship(docs.sparkSession)
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_pieces, path=path, size=size, end=end), PIECE + ", item long"), "pieces")
    return pieces.join(fit(pieces.select("item", "length"), size), "item").drop("item")
