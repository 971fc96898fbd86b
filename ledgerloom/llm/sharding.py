"""Sharding by extendible hashing.

Each document has a bit string, the hash of its content. A directory, indexed
by leading bits, maps every prefix to a shard; a shard whose documents exceed
the byte limit is split on the next bit, others are not, until every shard fits.
A round measures all prefixes of one more stretch of bits at once, reads off
where each split stops, and passes only rows of prefixes that are still too
large on to the next round.

Defined results: the size of a document is the bytes of its text (null: 0). A
document above the limit gets a shard of its own, marked `oversized`. Identical
rows have equal content bits; behind them follow bits of a row number fixed
before the split, so any number of copies is spread, and copies are
interchangeable. Columns of the input pass through; the operator's own
columns have names that the input does not use. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

LIMIT = 16 << 20
ROUND_BITS = 10
CONTENT_BITS = 40
ROW_BITS = 63


def _path(content: Column, number: Column) -> Column:
    """Bits of the content hash, then the bits of the row number, lowest first."""
    head = F.lpad(F.bin(F.pmod(content, F.lit(1 << CONTENT_BITS))), CONTENT_BITS, "0")
    return F.concat(head, F.reverse(F.lpad(F.bin(number), ROW_BITS, "0")))


def _directory(cells: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """For each prefix `cell` of `depth` bits the number of bits at which its shard ends; null if it is still too large.

    A cell contributes to its prefixes of start..depth bits, where the bytes of
    each prefix are added up; the shortest prefix that fits is the shard.
    """
    levels = F.sequence(F.lit(start), F.lit(depth))
    paths = cells.select("cell", "bytes", "n", F.explode(levels).alias("level")).withColumn("prefix", F.expr("substr(cell, 1, level)"))
    totals = paths.groupBy("level", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    fits = totals.filter((F.col("bytes") <= limit) | (F.col("n") == 1))
    joined = paths.select("cell", "level", "prefix").join(fits.select("level", "prefix"), ["level", "prefix"], "left_semi")
    ends = joined.groupBy("cell").agg(F.min("level").alias("bits"))
    return cells.select("cell").join(ends, "cell", "left")


def assign(docs: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Rows and shards, both with a row number `_number`.

    Rows: `_rest` (the input row without its text), text. Shards: `bytes` and
    `shard` (the bit prefix; empty if one shard holds all), staged.
    """
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    content = F.xxhash64(*[F.col(c) for c in docs.columns])
    rows = docs.select(rest.alias("_rest"), "text", content.alias("_content"))
    sized = rows.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("_number", F.monotonically_increasing_id())
    # one written copy: the row number and the sizes stay what they are
    rows = stage(sized, "shard-rows")
    marked = rows.select("_number", "bytes", _path(F.col("_content"), F.col("_number")).alias("_path"))
    done, start, last = [], 0, CONTENT_BITS + ROW_BITS
    while True:
        total = marked.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
        if start == 0:
            # about one bit more than the first split needs, whatever the size
            depth = min(last, max(2, (total["b"] // limit + 1).bit_length() + 2))
        else:
            depth = min(last, start + ROUND_BITS)
        celled = marked.withColumn("cell", F.expr(f"substr(_path, 1, {depth})"))
        cells = celled.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        directory = stage(_directory(cells, start, depth, limit), "shard-directory")
        placed = celled.join(directory, "cell")
        ends = placed if depth == last else placed.filter("bits IS NOT NULL")
        done.append(ends.select("_number", "bytes", F.expr(f"substr(_path, 1, coalesce(bits, {depth}))").alias("shard")))
        if depth == last or directory.filter("bits IS NULL").isEmpty():
            break
        marked = stage(placed.filter("bits IS NULL").select("_number", "bytes", "_path"), "shard-split")
        start = depth + 1
    return rows.drop("_content", "bytes"), stage(reduce(DataFrame.unionByName, done), "shards")


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The input columns and shard, shard_bits, shard_bytes, shard_rows, oversized.

    Own columns whose name the input has get a leading underscore, as often as needed.
    """
    rows, placed = assign(docs, limit)
    totals = placed.groupBy(F.col("shard").alias("_shard")).agg(F.sum("bytes").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    own = {
        "shard": F.col("shard"),
        "shard_bits": F.length("shard"),
        "shard_bytes": F.col("_bytes"),
        "shard_rows": F.col("_rows"),
        "oversized": F.col("_bytes") > limit,
    }
    names = {}
    for name in own:
        names[name] = name
        while names[name] in docs.columns:
            names[name] = f"_{names[name]}"
    joined = rows.join(placed.join(totals, F.col("shard") == F.col("_shard")), "_number")
    given = [F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns]
    return joined.select(*given, *[v.alias(names[n]) for n, v in own.items()])


def write_shards(shards: DataFrame, path: str) -> None:
    """One folder per shard; the rows of a shard meet in one task, which the byte limit bounds.

    Folders are named by `s` and the bits, so that a reader takes no shard for a number or a null.
    """
    named = shards.withColumn("shard", F.concat(F.lit("s"), "shard"))
    named.repartition(F.col("shard")).write.partitionBy("shard").parquet(path)
