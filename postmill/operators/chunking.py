"""Greedy packing of message streams into bounded chunks.

A chunk takes messages while their total weight stays within a limit; a message heavier than
the limit is a chunk of its own. Where a chunk starts depends on where the one before ended. A channel
that fits one row is folded in order inside it. In a longer one the starts form a chain: every message has
one successor, the start that would follow if a chunk began there. The chain is followed in blocks: each block
of consecutive messages is reduced to its possible entries and the exit each of them leads to, blocks are
merged into larger ones until one block holds the channel, and the true entries are handed
back down. No task ever holds more than one block, however long a channel is, and all of it runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.replies import let
from postmill.functions.text import token_estimate
from postmill.operators.numbering import BLOCK, with_offsets
from postmill.session import cut_lineage, ship
from postmill.sources.folders import names_in

FAN_IN = 8


def successors(messages: DataFrame, weight: Column, limit: int, block: int = BLOCK) -> DataFrame:
    """Rows (channel, pos, start, nxt): dense position, weight before it, next chunk start."""
    w = messages.select("channel", "ordinal", weight.cast("bigint").alias("w"))
    placed = with_offsets(w, ["channel"], "ordinal", {"pos": F.lit(1), "start": F.col("w")}, block)
    placed = placed.select("channel", "ordinal", "pos", "start", "w")

    # Messages ending within the limit of a start: rank of start + limit among the distinct ends.
    width = 4 * max(limit, 1)
    ends = placed.groupBy("channel", (F.col("start") + F.col("w")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    asks = placed.select("channel", (F.col("start") + limit).alias("v")).distinct()
    both = ends.select("channel", "v", "n", F.lit(0).alias("ask")).unionByName(
        asks.select("channel", "v", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("ask"))
    ).withColumn("band", F.floor(F.col("v") / F.lit(width)))
    totals = both.groupBy("channel", "band").agg(F.sum("n").alias("n"))
    totals = with_offsets(totals, ["channel"], "band", {"n_before": F.col("n")}, block).select("channel", "band", "n_before")
    inside = W.partitionBy("channel", "band").orderBy("v", "ask").rowsBetween(W.unboundedPreceding, 0)
    ranks = (
        both.withColumn("n_inside", F.sum("n").over(inside))
        .where("ask = 1")
        .join(totals, ["channel", "band"])
        .select("channel", (F.col("v") - limit).alias("start"), (F.col("n_before") + F.col("n_inside")).alias("reach"))
    )
    return placed.join(ranks, ["channel", "start"]).select(
        "channel", "ordinal", "pos", "start", F.greatest(F.col("pos") + 1, F.col("reach")).alias("nxt")
    )


NODES = "array<struct<to:int,exit:bigint,last:bigint,hops:bigint>>"


def _in_one_row(nodes: DataFrame) -> DataFrame:
    """Per block its nodes in order of position."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "exit", "last", "hops")))
    return nodes.groupBy("channel", "blk").agg(listed.alias("nodes"))


def _linked(nodes: Column) -> Column:
    """Nodes with the place (from 1) of their exit in the block, 0 where it lies outside."""
    places = F.transform(nodes, lambda x: x["pos"])
    return let(places, lambda at: F.transform(nodes, lambda x: F.struct(
        F.array_position(at, x["exit"]).cast("int").alias("to"), x["exit"].alias("exit"), x["last"].alias("last"), x["hops"].alias("hops")
    ))).cast(NODES)


def _reduce_blocks(blocked: DataFrame) -> DataFrame:
    """Exit of every position of a block: first start beyond it, last start inside, starts passed.

    Each step doubles how far a node sees, so a block of n nodes takes log2(n) of them.
    """
    def doubled(acc: Column, _: Column) -> Column:
        def on(x: Column) -> Column:
            y = F.get(acc, x["to"] - 1)
            return F.when(x["to"] == 0, x).otherwise(F.struct(
                y["to"].alias("to"), y["exit"].alias("exit"), y["last"].alias("last"), (x["hops"] + y["hops"]).alias("hops")
            ))

        return F.transform(acc, on).cast(NODES)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size("nodes") + 1)).cast("int"))
    seen = _in_one_row(blocked).select("channel", "blk", F.transform("nodes", lambda x: x["pos"]).alias("pos"), F.aggregate(steps, _linked(F.col("nodes")), doubled).alias("n"))
    # Outer, as Spark would else fold every block once more for a filter on empty ones.
    rows = seen.select("channel", "blk", F.inline_outer(F.arrays_zip("pos", "n")))
    return rows.select("channel", "blk", "pos", "n.exit", "n.last", "n.hops")


def _walk_blocks(entered: DataFrame) -> DataFrame:
    """Positions of a block on the chain from its entry, with the number of starts before each and the start just before it."""
    step = "struct<at:int,entry:bigint,rank:bigint,prev:bigint>"
    rows = entered.groupBy("channel", "blk").agg(
        F.array_sort(F.collect_list(F.struct("pos", "exit", "last", "hops"))).alias("nodes"),
        F.first("entry").alias("entry"), F.first("rank").alias("rank"), F.first("prev").alias("prev"),
    ).withColumn("linked", _linked(F.col("nodes")))
    at = F.array_position(F.transform("nodes", lambda x: x["pos"]), F.col("entry")).cast("int")
    first = F.array(F.struct(at.alias("at"), F.col("entry").alias("entry"), F.col("rank").alias("rank"), F.col("prev").alias("prev"))).cast(f"array<{step}>")

    def onward(acc: Column, _: Column) -> Column:
        here = F.element_at(acc, -1)
        x = F.get(F.col("linked"), here["at"] - 1)
        go = F.struct(x["to"].alias("at"), x["exit"].alias("entry"), (here["rank"] + x["hops"]).alias("rank"), x["last"].alias("prev")).cast(step)
        return F.when(x["to"] == 0, acc).otherwise(F.concat(acc, F.array(go))).cast(f"array<{step}>")

    walked = rows.where(at > 0).select("channel", F.aggregate(F.sequence(F.lit(1), F.size("nodes")), first, onward).alias("w"))
    return walked.select("channel", F.inline_outer("w")).select("channel", "entry", "rank", "prev")


def chain_entries(nodes: DataFrame, width: int, block: int) -> DataFrame:
    """Nodes on the chain from position 0 as (channel, entry, rank, prev).

    ``nodes`` are (channel, pos, exit, last, hops): from a chunk start at ``pos``, the first
    start outside the node's reach, the last start within it, and how many lie within it.
    ``rank`` counts the starts before the entry, ``prev`` is the start just before it.
    """
    blocked = nodes.withColumn("blk", F.floor(F.col("pos") / F.lit(width)).cast("bigint"))
    first = blocked.select("channel").distinct().select(
        "channel", F.lit(0).cast("bigint").alias("entry"), F.lit(0).cast("bigint").alias("rank"),
        F.lit(-1).cast("bigint").alias("prev"),
    )
    longest = nodes.agg(F.max("pos")).first()[0]
    if longest is None or longest < width:
        entries = first
    else:
        reduced = cut_lineage(_reduce_blocks(blocked))
        doors = reduced.select("channel", F.col("exit").alias("pos")).unionByName(
            first.select("channel", F.col("entry").alias("pos"))
        ).distinct()
        upper = reduced.join(doors, ["channel", "pos"], "left_semi").drop("blk")
        entries = chain_entries(upper, width * FAN_IN, block)
    keyed = entries.withColumn("blk", F.floor(F.col("entry") / F.lit(width)).cast("bigint"))
    walk = blocked.join(keyed, ["channel", "blk"])
    return _walk_blocks(walk)


def chunk_index(messages: DataFrame, weight: Column, limit: int, block: int = BLOCK) -> DataFrame:
    """Rows (channel, ordinal, chunk_index) of the greedy packing."""
    steps = cut_lineage(successors(messages, weight, limit, block))
    nodes = steps.select(
        "channel", "pos", F.col("nxt").alias("exit"), F.col("pos").alias("last"), F.lit(1).cast("bigint").alias("hops")
    )
    width = min(block, ROW_MESSAGES)
    starts = chain_entries(nodes, width, width).select(
        "channel", F.col("entry").alias("pos"), F.lit(1).alias("is_start")
    )
    marked = steps.select("channel", "ordinal", "pos").join(starts, ["channel", "pos"], "left")
    counted = with_offsets(marked, ["channel"], "pos", {"before": F.coalesce("is_start", F.lit(0))}, block)
    return counted.select(
        "channel", "ordinal", (F.col("before") + F.coalesce("is_start", F.lit(0)) - 1).alias("chunk_index")
    )


ROW_MESSAGES = 2_048
ROW_CHARS = 4_000_000


def _folded(messages: DataFrame, weight: Column, limit: int, text: str, glue: str) -> DataFrame:
    """Chunks of channels that fit one row: their messages are folded in order, then cut at the starts."""
    row = F.struct("ordinal", weight.cast("bigint").alias("w"), F.col(text).alias("t"))
    rows = messages.groupBy("channel").agg(F.array_sort(F.collect_list(row)).alias("m"))
    state = "struct<total:bigint,starts:array<int>>"

    def take(acc: Column, x: Column) -> Column:
        opens = (F.size(acc["starts"]) == 0) | (acc["total"] + x["w"] > limit)
        return F.struct(
            F.when(opens, x["w"]).otherwise(acc["total"] + x["w"]).alias("total"),
            F.when(opens, F.concat(acc["starts"], F.array(x["i"]))).otherwise(acc["starts"]).alias("starts"),
        ).cast(state)

    weights = F.transform("m", lambda x, i: F.struct(x["w"].alias("w"), i.alias("i")))
    none = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<int>").alias("starts")).cast(state)
    cut = rows.select("channel", "m", F.aggregate(weights, none, take)["starts"].alias("starts"))
    # Outer, as Spark would else fold every channel once more for a filter on empty ones.
    each = cut.select("channel", "m", "starts", F.posexplode_outer("starts").alias("c", "s"))
    end = F.coalesce(F.get("starts", F.col("c") + 1), F.size("m"))
    part = F.slice("m", F.col("s") + 1, end - F.col("s"))
    return each.select("channel", F.col("c").cast("bigint").alias("chunk_index"), part.alias("part")).select(
        "channel", "chunk_index", F.array_join(F.transform("part", lambda x: x["t"]), glue).alias("text"), F.size("part").cast("bigint").alias("n_messages"),
        F.element_at("part", 1)["ordinal"].alias("first_ordinal"),
    )


def _packed(messages: DataFrame, weight: Column, limit: int, text: str, glue: str, block: int) -> DataFrame:
    """Chunks of all channels: short channels in one row each, the others by the chain of starts."""
    rows = messages.select("channel", "ordinal", text)
    sizes = rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"))
    long = sizes.where((F.col("n") > min(block, ROW_MESSAGES)) | (F.col("chars") > ROW_CHARS)).select("channel")
    if long.isEmpty():
        return _folded(rows, weight, limit, text, glue)
    long = cut_lineage(long)
    short, chained = rows.join(long, "channel", "left_anti"), rows.join(long, "channel", "left_semi")
    whole = _assemble(chained, chunk_index(chained, weight, limit, block), text, glue)
    return _folded(short, weight, limit, text, glue).unionByName(whole)


def _assemble(messages: DataFrame, index: DataFrame, text: str, glue: str) -> DataFrame:
    """Chunk texts in message order; a chunk is bounded by the limit and its heaviest message."""
    rows = messages.join(index, ["channel", "ordinal"])
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.col(text).alias("t"))))
    return rows.groupBy("channel", "chunk_index").agg(
        F.array_join(F.transform(parts, lambda x: x["t"]), glue).alias("text"),
        F.count(F.lit(1)).alias("n_messages"),
        F.min("ordinal").alias("first_ordinal"),
    )


def pack_chunks(messages: DataFrame, max_chars: int = 80_000, text: str = "block", block: int = BLOCK) -> DataFrame:
    """Chunks of at most ``max_chars`` characters; text before the first header is no message."""
    rows = messages.where(F.col("ordinal") >= 0)
    chunks = _packed(rows, F.length(text), max_chars, text, "", block)
    return chunks.where(chunks["text"].rlike(r"(?U)\S")).withColumn("n_chars", F.length("text"))


def pack_chunks_tokens(messages: DataFrame, limit: int = 50_000, text: str = "block", block: int = BLOCK) -> DataFrame:
    """Chunks of at most ``limit`` estimated tokens, messages joined by a blank line.

    A preamble before the first header is a message of its own, at ordinal -1.
    """
    rows = messages.withColumn("ordinal", F.col("ordinal") + 1)
    chunks = _packed(rows, token_estimate(text), limit, text, "\n\n", block)
    return chunks.withColumn("first_ordinal", F.col("first_ordinal") - 1).withColumn("n_tokens", token_estimate("text"))


def pending_chunks(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks without a result yet."""
    return chunks.join(results.select("channel", "chunk_index"), ["channel", "chunk_index"], "left_anti")


def annotate(df: DataFrame, fn, out_schema: str) -> DataFrame:
    """Apply a user function to batches of rows: ``fn`` maps one pandas batch to another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, out_schema)


OUTCOME = "call_key string, attempts int, error string, result array<struct<{0}>>"


def call_key(df: DataFrame) -> Column:
    """What a call is known by: the content of its whole row."""
    return F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)


class Calls:
    """Applies a user function to one row at a time, each up to a number of attempts."""

    def __init__(self, fn, columns: list[str], attempts: int) -> None:
        self.fn, self.columns, self.attempts = fn, columns, attempts

    def one(self, row: pd.DataFrame) -> tuple[int, str | None, list[dict]]:
        error = None
        for attempt in range(1, self.attempts + 1):
            try:
                return attempt, None, self.fn(row).to_dict("records")
            except Exception as e:  # the user's function may raise anything; what it says is kept
                error = f"{type(e).__name__}: {e}"[:2000]
        return self.attempts, error, []

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [(key, *self.one(batch.loc[[at], self.columns])) for at, key in zip(batch.index, batch["call_key"], strict=True)]
            yield pd.DataFrame(done, columns=["call_key", "attempts", "error", "result"])


def annotate_stored(df: DataFrame, fn, out_schema: str, path: str, attempts: int = 5, waves: int = 1) -> tuple[DataFrame, DataFrame]:
    """Apply a user function to every row and keep what came of it: (results, failed calls).

    ``fn`` maps a pandas frame of one row to a frame of any rows in ``out_schema``. Calls are known by the content of their row, so
    equal rows are one call. A call that raises is tried again, ``attempts`` times in all; then it is stored as failed, with
    its message. Calling this again on the same ``path`` calls only rows that have no result there: new ones, and those that failed.
    ``waves`` cut the calls into as many jobs, each stored before the next begins, which bounds what a lost job repeats.
    Results are the input's columns and those of ``out_schema``; failed calls the input's columns, ``attempts`` and ``error``.
    """
    spark, form = df.sparkSession, OUTCOME.format(out_schema)
    keyed = df.withColumn("call_key", call_key(df))

    def outcomes() -> DataFrame:
        runs = names_in(spark, path)
        return spark.read.schema(f"{form}, run int").option("basePath", path).parquet(*[f"{path}/{r}" for r in runs]) if runs else spark.createDataFrame([], f"{form}, run int")

    for wave in range(waves):
        known = outcomes().where("error IS NULL").select("call_key")
        missing = keyed.where(F.pmod(F.xxhash64("call_key"), F.lit(waves)) == wave).dropDuplicates(["call_key"]).join(known, "call_key", "left_anti")
        run = max((int(n.removeprefix("run=")) for n in names_in(spark, path)), default=0) + 1
        missing.mapInPandas(Calls(fn, df.columns, attempts), form).write.parquet(f"{path}/run={run}")
    # Of several runs of a call the one with a result holds, else the last.
    order = F.struct(F.col("error").isNull(), F.col("run"))
    last = outcomes().groupBy("call_key").agg(F.max_by(F.struct("attempts", "error", "result"), order).alias("o"))
    both = keyed.join(last, "call_key")
    results = both.where("o.error IS NULL").select(*df.columns, F.inline("o.result"))
    return results, both.where("o.error IS NOT NULL").select(*df.columns, "o.attempts", "o.error")


ship(__name__)
