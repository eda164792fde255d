"""Chat formatting with budgeted windows.

Each conversation is cut into windows whose turns are whole. Prefix sums of turn tokens choose them: the axis of tokens
is divided into cells of one payload, turns inside a cell form a span, and a turn that crosses a border is a span of its
own, so no span exceeds the payload unless a single turn does. Every window repeats the leading system turn and
the turns that start within ``history`` tokens before its span; the loss mask covers the assistant turns of the span only, so
each target is learnt once.

Prefix sums are taken in two levels (blocks of turns, then blocks of a conversation), so one huge conversation is
spread over tasks; a span ends with its block. Texts are shuffled once, by conversation and block: spans, history and windows form where they lie, and only
conversations of several blocks send turns on (the system turn, and those that the next block's first windows repeat). Texts and roles are escaped reversibly: ``\\`` ``<`` ``[`` ``|`` become ``\\\\`` ``\\l`` ``\\b`` ``\\p``,
so no control string of this or of bracketed templates can occur inside a turn.

Defined results: a null text or role is empty; rows of the same turn are ordered by role, then text, and repeated rows stay; a null
conversation id is a conversation; a null turn sorts first; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512  # turns whose prefix sums one task makes together


def escape(s: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def unescape(s: Column) -> Column:
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\p"), F.lit("|"))
    return F.array_join(F.transform(F.split(s, r"\\\\"), plain), "\\")


def mark(role: Column, text: Column) -> Column:
    """One turn: ``<|role|>``, a line feed, the text, ``<|end|>`` and a line feed."""
    return F.concat(F.lit("<|"), escape(role), F.lit("|>\n"), escape(text), F.lit("<|end|>\n"))


def tokens(text: Column) -> Column:
    """Words and marks of a turn, with four for the template: a tokenizer-free measure that is never 0."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 4).cast("long")


def _turns(df: DataFrame) -> DataFrame:
    """Turns with their texts, dealt by (conv, block), with places, tokens and sums inside the block: the one shuffle of texts.

    ``conv`` is a text key of the conversation, never null, so that every later step is a plain equality on (conv, block).
    """
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.coalesce(F.expr(f"floor(turn / {BLOCK})").cast("long"), F.lit(-(2**63))).alias("block"), "turn", "role", "text", tokens(F.col("text")).alias("n"),
    )
    return rows


def _blocks(rows: DataFrame, history: int) -> DataFrame:
    """What a block must know of the others, without texts: sums before it, and the next blocks that its turns can be history of."""
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # A turn has four tokens at least, so turns of `history` tokens lie in that many blocks at most.
    later = whole.orderBy("block").rowsBetween(1, max(1, -(-history // 4)))
    blocks = rows.groupBy("conv", "block").agg(F.sum("n").alias("block_n"), F.count("*").alias("block_rows"))
    blocks = blocks.withColumn("block_before", F.coalesce(F.sum("block_n").over(earlier), F.lit(0))).withColumn("block_at", F.coalesce(F.sum("block_rows").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("n_blocks", F.count("*").over(whole)).withColumn("next", F.collect_list(F.struct("block", "block_before")).over(later))
    return blocks.select("conv", "block", "block_before", "block_at", "n_blocks", "next")


def _windows(df: DataFrame, budget: int, history: int) -> DataFrame:
    """conv, block, n_blocks, start and t: the turns of each window, in order."""
    rows = _turns(df)
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("at", F.count("*").over(inside))
    placed = placed.join(_blocks(rows, history), ["conv", "block"])
    placed = placed.withColumn("before", F.col("before") + F.col("block_before")).withColumn("at", F.col("at") + F.col("block_at"))
    is_system = F.expr("at = 0 AND role = 'system'")
    turn = F.struct("at", "role", "text", F.lit(True).alias("repeated"), "n", "before")
    # What later blocks need of earlier ones: the system turn (each) and the turns that their first windows repeat. Conversations of one block, nearly all, send nothing.
    long = placed.where("n_blocks > 1")
    tails = long.where(~is_system).select("conv", F.explode(F.filter("next", lambda x: x.block_before - F.col("before") <= history)).alias("to"), turn.alias("t")).select("conv", F.col("to.block").alias("block"), "t")
    systems = long.where(is_system).select(F.col("conv").alias("s_conv"), turn.alias("t"))
    others = _blocks(rows, history).where("n_blocks > 1 AND block_at > 0").select("conv", "block")
    systems = others.join(systems, F.col("conv") == F.col("s_conv")).select("conv", "block", "t")
    given = tails.unionByName(systems).groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("given"))
    given = given.withColumn("given_n", F.when(F.expr("given[0].at = 0 AND given[0].role = 'system'"), F.expr("given[0].n")))
    placed = placed.join(given.select("conv", "block", "given_n"), ["conv", "block"], "left")
    in_block = Window.partitionBy("conv", "block")
    s_n = F.coalesce("given_n", F.max(F.when(is_system, F.col("n"))).over(in_block), F.lit(0))
    placed = placed.withColumn("payload", F.greatest(F.lit(budget // 4), F.lit(budget - history) - s_n))
    # A span is the turns of the block inside one cell, or one turn that crosses a border; its start names it.
    span = F.struct(F.expr("before div payload").alias("cell"), F.when(F.expr("before div payload < (before + n - 1) div payload"), F.col("before")).otherwise(F.lit(-1)).alias("own"))
    ordered = in_block.orderBy("before")
    placed = placed.withColumn("span", span).withColumn("opens", F.coalesce(F.lag("span").over(ordered) != F.col("span"), F.lit(True)))
    placed = placed.withColumn("start", F.max(F.when(F.col("opens"), F.col("before"))).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    # Spans of the block that start less than `history` tokens after the turn's start repeat it; the frame holds history / 4 turns at most.
    reach = F.collect_list(F.when(F.col("opens"), F.col("before"))).over(ordered.rangeBetween(1, history)) if history > 0 else F.array().cast("array<long>")
    placed = placed.withColumn("reach", F.when(is_system, F.array().cast("array<long>")).otherwise(reach))
    copies = placed.select("conv", "block", "n_blocks", "at", "role", "text", "n", "start", F.explode(F.concat(F.array("start"), "reach")).alias("of"))
    own = F.struct("at", "role", "text", (F.col("of") != F.col("start")).alias("repeated"), "n")
    windows = copies.groupBy("conv", "block", "n_blocks", "of").agg(F.sort_array(F.collect_list(own)).alias("t"))
    # The system turn, in its own block, is at the head of the first window; in others it came with what was given.
    head = F.max(F.when(F.expr("t[0].at = 0 AND t[0].role = 'system'"), F.array(F.struct(F.expr("t[0].at").alias("at"), F.expr("t[0].role").alias("role"), F.expr("t[0].text").alias("text"), F.lit(True).alias("repeated"), F.expr("t[0].n").alias("n"))))).over(in_block)
    windows = windows.withColumn("head", head).join(given.select("conv", "block", "given"), ["conv", "block"], "left")
    kept = F.filter("given", lambda g: ((g.at == 0) & (g.role == "system")) | (g.before >= F.col("of") - history))
    kept = F.transform(kept, lambda g: F.struct(g["at"].alias("at"), g["role"].alias("role"), g["text"].alias("text"), g["repeated"].alias("repeated"), g["n"].alias("n")))
    none = F.filter("t", lambda t: F.lit(False))
    head = F.when(F.expr("t[0].at = 0 AND t[0].role = 'system'"), none).otherwise(F.coalesce("head", none))
    return windows.select("conv", "block", "n_blocks", F.col("of").alias("start"), F.concat(head, F.coalesce(kept, none), F.col("t")).alias("t"))


def format_windows(df: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """One row per window: conv_id, first_turn (the place in the conversation), n_repeated, n_new, n_tokens, formatted, loss_spans (start and length in
    code points of ``formatted``, all in order).

    A system turn longer than half of the budget is repeated all the same; the payload is then a quarter of the budget.
    """
    return formatted(df, budget, history).drop("conv", "block", "n_blocks")


def formatted(df: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """``format_windows`` with conv (a key of the conversation that is never null), block and n_blocks; rows lie by (conv, block), which later groupings can use."""
    windows = _windows(df, budget, history)
    windows = windows.withColumn("m", F.transform("t", lambda t: mark(t.role, t.text)))
    new = F.filter("t", lambda t: ~t.repeated)
    # Starts of marks: each depends on the lengths before it; windows are bounded by the budget, so this fold is short.
    ends = F.aggregate("m", F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(s))))
    windows = windows.withColumn("ends", ends)
    loss = F.filter(
        F.transform("t", lambda t, i: F.struct(
            (F.get(F.col("ends"), i) + F.length(escape(t.role)) + 5).alias("start"), F.length(escape(t.text)).alias("length"), (~t.repeated & (t.role == "assistant")).alias("on"))),
        lambda x: x.on,
    )
    conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, 2**31 - 1).cast(df.schema["conv_id"].dataType))
    return windows.select(
        conv_id.alias("conv_id"), "conv", "block", "n_blocks", F.get(new, F.lit(0)).getField("at").alias("first_turn"),
        F.size(F.filter("t", lambda t: t.repeated)).alias("n_repeated"), F.size(new).alias("n_new"),
        F.aggregate("t", F.lit(0).cast("long"), lambda acc, t: acc + t.n).alias("n_tokens"),
        F.array_join("m", "").alias("formatted"), F.transform(loss, lambda x: F.struct(x.start.alias("start"), x.length.alias("length"))).alias("loss_spans"),
    )


def read_back(windows: DataFrame, *keep: str) -> DataFrame:
    """New turns (role, text) and loss text of each window, parsed from ``formatted`` and ``loss_spans`` alone, with the columns to keep."""
    parts = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")
    parts = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.size(parts) - F.col("n_repeated"), F.lit(0)))
    turns = F.transform(parts, lambda x: F.struct(
        unescape(F.regexp_extract(x, r"(?s)\A<\|([^|]*)\|>\n", 1)).alias("role"), unescape(F.regexp_extract(x, r"(?s)\A<\|[^|]*\|>\n(.*)\z", 1)).alias("text")))
    loss = F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), x.start + 1, x.length)))
    return windows.select("conv_id", *keep, "first_turn", F.length("formatted").cast("long").alias("n_chars"), turns.alias("turns"), loss.alias("loss"))
