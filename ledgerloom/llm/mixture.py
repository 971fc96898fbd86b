"""Mixing sources to target weights by fixed-length blocks.

The words of each source, in order of its packs, form one stream, cut into
blocks of `block_words`. Every output shard draws how many of its slots each
source fills, from a multinomial over what the sources still have to give in
the shard's group, so each group of shards hits its share of the targets
exactly. A slot of a source has a running number; the number is mapped to a
block by a pseudorandom permutation of the source's block numbers, a new one
per pass over the source. Slots and blocks meet by (source, block number).

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating. The
targets add up to all words; a target above `most` times its source stops
there and the excess goes to the others by weight. As no source has more slots
than `most` times its blocks, no block and no document is taken more often.

Defined results: a null or blank text has no words and is taken 0 times. A null
source is a source of its own. Repeated rows are documents of their own. Other
columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import null_safe, stage, word_array

BLOCK_WORDS = 64
MOST = 3
SHARD_SLOTS = 1 << 12
GROUP_SHARDS = 16
SEED = 20240601


def waterfill(sizes: list[int], weights: list[int], most: float = MOST) -> list[float]:
    """Shares of the total by weight, none above `most` times its size; the excess is dealt again by weight."""
    target, total = [0.0] * len(sizes), float(sum(sizes))
    free, left = {i for i, n in enumerate(sizes) if n > 0}, total
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = most * float(sizes[i])
            left -= target[i]
        free -= over
    return target


def _rows(docs: DataFrame, text: bool) -> DataFrame:
    """doc_id, source, size and a row number `_row`, with the other columns in `_rest`; staged, since the number must not change."""
    rest = [F.col(c) for c in docs.columns if c != "text"] if text else []
    columns = ["doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("_fp"), F.monotonically_increasing_id().alias("_row")]
    return stage(docs.select(*columns, *([F.struct(*rest).alias("_rest"), "text"] if text else [])), "mixture-rows")


def _streams(rows: DataFrame) -> DataFrame:
    """First word of every document in its source's stream: totals of the packs before, then order inside the pack.

    The place depends on doc_id and text alone, never on where a row is stored. Equal rows
    stand side by side; which is which changes nothing, so they are numbered by partition.
    Documents are dealt to about as many packs as a pack has documents, so both orders stay
    small for a source of any size.
    """
    same = ["source", "doc_id", "_fp"]
    packs = math.isqrt(rows.count()) + 1
    # a row number holds the number of its partition in its upper bits
    narrow = rows.select(*same, "size", "_row", F.shiftrightunsigned("_row", 33).alias("_part"))
    copies = narrow.groupBy(*same, "_part").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    nth = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    copies = copies.withColumn("_earlier", F.coalesce(F.sum("n").over(nth), F.lit(0)))

    whole = copies.groupBy(*same).agg(F.sum(F.col("n") * F.col("size")).alias("words"))
    whole = whole.withColumn("_pack", F.pmod(F.xxhash64("doc_id", "_fp"), F.lit(packs)))
    by_source = Window.partitionBy("source").orderBy("_pack").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.groupBy("source", "_pack").agg(F.sum("words").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(by_source), F.lit(0))).drop("n")
    inside = Window.partitionBy("source", "_pack").orderBy(F.col("doc_id").asc_nulls_last(), "_fp")
    placed = whole.withColumn("_inside", F.sum("words").over(inside) - F.col("words"))
    placed = null_safe(placed, before, ["source", "_pack"]).select(*same, (F.col("_before") + F.col("_inside")).alias("_first"))

    started = null_safe(copies, placed, same).select(*same, "_part", (F.col("_first") + F.col("_earlier") * F.col("size")).alias("_first"))
    within = Window.partitionBy(*same, "_part").orderBy("_row")
    numbered = narrow.withColumn("_copy", F.row_number().over(within) - 1)
    joined = null_safe(numbered, started, [*same, "_part"])
    return joined.select("_row", "source", "size", (F.col("_first") + F.col("_copy") * F.col("size")).alias("begin"))


def source_plan(rows: DataFrame, block_words: int = BLOCK_WORDS, most: float = MOST) -> pd.DataFrame:
    """One row per source: number, size, weight, target, blocks, slots. A row per source reaches the driver."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size")).toPandas()
    names = [None if pd.isna(s) else s for s in sizes["source"]]
    plan = sizes.iloc[sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))].reset_index(drop=True)
    plan["weight"] = [i % 3 + 1 for i in range(len(plan))]
    plan["target"] = waterfill(plan["size"].tolist(), plan["weight"].tolist(), most)
    plan["blocks"] = -(-plan["size"] // block_words)
    # the last block may be short: slots by the mean size of a block
    fill = plan["size"] / plan["blocks"].clip(lower=1)
    plan["slots"] = np.minimum(np.round(plan["target"] / fill.clip(lower=1)), most * plan["blocks"]).astype("int64")
    return plan


def permute(x: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1: a Feistel network, walked until it lands inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            k = np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9) & (2**64 - 1))
            z = (right + k) * np.uint64(0xD6E8FEB86659FD93)
            z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((z ^ (z >> np.uint64(29))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def draw_group(group: int, groups: int, slots: np.ndarray, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The shards of a group: number in the group, slots per source, first slot number per source.

    A shard draws a multinomial over what its group has left of each source;
    what a draw takes beyond that is drawn again from the others.
    """
    first = slots * group // groups
    left = slots * (group + 1) // groups - first
    rng = np.random.default_rng([seed, group])
    shard = 0
    while left.sum():
        want = np.zeros_like(left)
        while (missing := min(shard_slots, left.sum()) - want.sum()) > 0:
            rest = left - want
            want += np.minimum(rng.multinomial(missing, rest / rest.sum()), rest)
        yield shard, want, first.copy()
        first, left, shard = first + want, left - want, shard + 1


def draw_slots(rows: DataFrame, plan: pd.DataFrame, seed: int = SEED) -> DataFrame:
    """Every slot of the output: shard, slot, source, block. Groups of shards are drawn in parallel."""
    spark = rows.sparkSession
    slots = plan["slots"].to_numpy("int64")
    groups = int(max(1, slots.sum() // (SHARD_SLOTS * GROUP_SHARDS)))
    names, blocks = plan["source"].tolist(), plan["blocks"].tolist()

    def drawn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for group in part["id"]:
                for shard, count, first in draw_group(int(group), groups, slots, seed):
                    source = np.repeat(np.arange(len(count)), count)
                    at = np.concatenate([np.arange(n) for n in count]) if len(count) else source
                    number = first[source] + at
                    block = np.zeros(len(source), np.int64)
                    for s in np.flatnonzero(count):
                        of = np.flatnonzero(source == s)
                        turn = number[of] // blocks[s]
                        for t in np.unique(turn):
                            hit = of[turn == t]
                            block[hit] = permute(number[hit] % blocks[s], blocks[s], seed + 1009 * int(s) + 7919 * int(t))
                    place = np.random.default_rng([seed, int(group), shard]).permutation(len(source))
                    yield pd.DataFrame({"group": group, "shard": shard, "slot": place, "source": pd.array([names[s] for s in source], "string"), "block": block})

    tasks = min(groups, 10_000)
    return spark.range(0, groups, 1, tasks).mapInPandas(drawn, "group long, shard long, slot long, source string, block long")


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, most: float = MOST, seed: int = SEED, text: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, pd.DataFrame]:
    """Rows (staged; with their texts if asked for), pieces of the blocks, slots of the output, and the plan per source.

    A piece is the part of one document in one block: `_row`, source, block,
    `from_word` and `n_words`. Joined with the slots by (source, block) it gives
    the words of every slot of every shard.
    """
    rows = _rows(docs, text)
    plan = source_plan(rows, block_words, most)
    streams = _streams(rows).filter("size > 0")
    first, last = F.expr(f"begin div {block_words}"), F.expr(f"(begin + size - 1) div {block_words}")
    cut = streams.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("begin"), F.col("block") * block_words)
    end = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = cut.select("_row", "source", "block", (begin - F.col("begin")).alias("from_word"), (end - begin).alias("n_words"))
    return rows, pieces, draw_slots(rows, plan, seed), plan


def taken_pieces(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """Pieces with the number of slots (`times`) that took their block."""
    used = slots.groupBy(F.col("source").alias("_source"), F.col("block").alias("_block")).agg(F.count(F.lit(1)).alias("times"))
    used = stage(used, "mixture-used")
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    return pieces.join(used, on).drop("_source", "_block")


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Every document with size, source_size, target (of its source) and taken (words the mix takes)."""
    rows, pieces, slots, plan = mixed(docs, block_words, most, seed, text=False)
    taken = taken_pieces(pieces, slots).groupBy("_row").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    names = docs.sparkSession.createDataFrame(
        [(None if pd.isna(s) else s, int(n), float(t)) for s, n, t in plan[["source", "size", "target"]].itertuples(index=False)],
        "_name string, source_size long, target double",
    )
    out = rows.join(taken, "_row", "left").join(names, F.col("source").eqNullSafe(F.col("_name")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix as documents: copy k of a document has the words that at least k slots took, in order.

    A document taken whole keeps its text; otherwise its words are joined by a
    space. Returns the columns of `docs`.
    """
    rows, pieces, slots, _ = mixed(docs, block_words, most, seed)
    used = taken_pieces(pieces, slots)
    per_row = used.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "n_words", "times"))).alias("_pieces"), F.max("times").alias("_most")
    )
    copies = rows.join(stage(per_row, "mixture-pieces"), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_most"))))
    part = F.filter("_pieces", lambda p: p["times"] >= F.col("_copy"))
    copies = copies.withColumn("_pieces", part)
    whole = F.aggregate("_pieces", F.lit(0).cast("long"), lambda a, p: a + p["n_words"]) == F.col("size")
    joined = F.array_join(F.flatten(F.transform("_pieces", lambda p: F.slice("_words", (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")))), " ")
    copies = copies.withColumn("_words", word_array(F.col("text"))).withColumn("text", F.when(whole, F.col("text")).otherwise(joined))
    chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return copies.select(*[F.col("text") if c == "text" else chars.get(c, F.col("_rest")[c]).alias(c) for c in docs.columns])
