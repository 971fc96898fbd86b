"""Benchmark decontamination by spaced-seed hashing.

Texts become tokens: lower-cased maximal runs of letters and digits; in scripts
written without spaces every letter is a token (marks separate tokens, as
everywhere, and are not compared). A mask is
laid over consecutive tokens and hashes those at its marked positions only, so
a substituted token at an unmarked position does not hide a match. Hashes of
items and documents meet in a join; before it, document hashes are thinned out
by a bit filter of a fixed size over the item hashes, which loses none of them. A hit names an
item, a document and the offset between them. Tokens of the documents on these
offsets meet those of the items in a second join, and the overlap is verified
token by token: a stretch on that offset, where an equal token counts one and
another one less `PENALTY`, must have `LEAST` equal tokens (all tokens of a
shorter item but one in `LEAST`). Every maximal-scoring stretch is tested, not
only the best one of the offset. Nothing but the filters reaches the driver.

An item shorter than a mask is looked up whole, as one run of equal tokens;
items of fewer than `SHORTEST` tokens are too general and match nothing, unless
they have `LONG_CHARS` letters and digits.

Defined results: null and empty texts match nothing. Repeated items count once
per item_id; a null item_id is left out. Repeated rows get the same result. Of several
stretches with as many equal tokens, the first one of the document is named, then the longest.
Other columns are not looked at, whatever their names. Empty tables give no items.
A text is cut into tokens as a whole; the offsets of one row are those of `BLOCK`
tokens, so a long text with hits all over is read once for each of its blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import filters
from ledgerloom.llm import textarrays as ta
from ledgerloom.llm.common import null_safe, stage

# weight 7 over a span of 11: each ignores other tokens
MASKS = ("11101100101", "11010011011", "10110110011")
LEAST = 12
PENALTY = 2
SHORTEST = 5
# letters and digits of an item of fewer tokens that is looked up all the same
LONG_CHARS = 32
# Han, kana, bopomofo, Yi, and the scripts of South East Asia that put no spaces between words
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x312F),
    (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
# tokens of a text whose offsets make one row of the verification, as a power of two
BLOCK = 17


@cache
def _token_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, step = 0x110000, 1 << 12
    inside, lower, alone = np.zeros(size, bool), np.arange(size, dtype=np.uint32), np.zeros(size, bool)
    for first in range(0, size, step):  # a list of all characters would take over 100 MB of every worker
        chars = [chr(i) for i in range(first, first + step)]
        inside[first : first + step] = [c.isalnum() for c in chars]
        lower[first : first + step] = [ord(l) if len(l := c.lower()) == 1 else ord(c) for c in chars]
    for low, high in UNSPACED:
        alone[low : high + 1] = True
    return inside, lower, alone


def tokens(chunk: ta.Chunk) -> ta.Words:
    inside, lower, alone = _token_tables()
    return ta.words(chunk, inside[chunk.chars], lower[chunk.chars], alone[chunk.chars])


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the marked tokens from each position at which the mask fits."""
    out = np.full(max(0, len(hashes) - len(mask) + 1), zlib.crc32(mask.encode()), np.uint64)
    for i, mark in enumerate(mask):
        if mark == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(out) + i]
    return ta.mix(out)


def masks_for(n_tokens: int, n_chars: int) -> tuple[str, ...]:
    """The masks of an item: spaced ones, or the whole of a short item."""
    if n_tokens < SHORTEST and n_chars < LONG_CHARS:
        return ()
    fitting = tuple(m for m in MASKS if len(m) <= n_tokens)
    return fitting if len(fitting) == len(MASKS) else ("1" * n_tokens,)


def stretches(equal: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal-scoring stretches (Ruzzo and Tompa): start, end, score. Disjoint, in order."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).view(np.int8))).tolist()
    # start, end, score before the start, score at the end
    found: list[tuple[int, int, int, int]] = []
    done = score = 0
    for start, end in zip(edge[::2], edge[1::2], strict=True):
        before = score - PENALTY * (start - done)
        done, score = end, before + end - start
        k = len(found) - 1
        while k >= 0:
            if found[k][2] < before:
                if found[k][3] >= score:
                    break
                start, before = found[k][0], found[k][2]
                del found[k:]
            k -= 1
        found.append((start, end, before, score))
    return [(start, end, after - before) for start, end, before, after in found]


def verified(equal: np.ndarray, n_tokens: int) -> tuple[int, int, int] | None:
    """Equal tokens, start and end of the stretch with most of them on an offset (the first, then the longest), if they are enough for an item of `n_tokens`."""
    least = needed(n_tokens)
    if equal.sum() < least:
        return None
    if equal.all():
        return len(equal), 0, len(equal)
    most, back, end = max((int(equal[a:b].sum()), -a, b) for a, b, _ in stretches(equal))
    return (most, -back, end) if most >= least else None


def needed(n_tokens: int) -> int:
    return LEAST if n_tokens > LEAST else n_tokens - n_tokens // LEAST


ITEMS = "item_id long, variant long, tokens array<long>, masks array<string>"
SEEDS = "h long, variant long, place int, n int"
HITS = "doc_id long, fp long, h long, at int"
CUTS = "doc_id long, fp long, variant long, first int, low int, own array<long>"
OVERLAPS = "doc_id long, fp long, item_id long, equal_tokens int, from_token int, to_token int"


def _batch(columns: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c for _, c in columns], [name for name, _ in columns])


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, masks = [], []
        for text in b.column("text").to_pylist():
            words = tokens(next(ta.chunks([text])))
            found.append(_signed(words.hashes))
            masks.append(list(masks_for(len(words.hashes), int((words.ends - words.starts).sum()))))
        yield _batch([("item_id", b.column("item_id")), ("variant", b.column("variant")), ("tokens", pa.array(found, pa.list_(pa.int64()))), ("masks", pa.array(masks, pa.list_(pa.string())))])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for variant, own, masks in zip(b.column("variant").to_pylist(), b.column("tokens"), b.column("masks").to_pylist(), strict=True):
            item = own.values.to_numpy().view(np.uint64)
            for mask in masks:
                h = seeds(item, mask)
                yield _batch(
                    [("h", pa.array(_signed(h))), ("variant", pa.array(np.full(len(h), variant))), ("place", pa.array(np.arange(len(h)), pa.int32())), ("n", pa.array(np.full(len(h), len(item)), pa.int32()))]
                )


def _document_hits(shared, masks: list[str]):
    """Seeds of documents that may be among those of the items."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in ta.chunks(b.column("text").to_pylist()):
                words = tokens(chunk)
                text_of = words.text_of
                for mask in masks:
                    h = seeds(words.hashes, mask)
                    at = np.flatnonzero(filters.has(shared.value, h))
                    at = at[text_of[at] == text_of[at + len(mask) - 1]]
                    rows = pa.array(chunk.rows.start + text_of[at])
                    yield _batch(
                        [("doc_id", b.column("doc_id").take(rows)), ("fp", b.column("fp").take(rows)), ("h", pa.array(_signed(h[at]))), ("at", pa.array(at - words.first[text_of[at]], pa.int32()))]
                    )

    return hits


def _having(rows: DataFrame, column: str, hashes: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose 64-bit `column` may be among the hashes (`h`), or with inside=False is surely not."""
    shared = rows.sparkSession.sparkContext.broadcast(filters.bits_of(hashes, filters.width_for(hashes.count())))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(filters.has(shared.value, b.column(column).to_numpy().view(np.uint64)) == inside))

    return rows.mapInArrow(kept, rows.schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a document that lie on the items' offsets."""
    for b in batches:
        columns = [b.column(name) for name in ("doc_id", "fp", "text", "offsets")]
        for doc_id, fp, text, offsets in zip(*columns, strict=True):
            own = _signed(tokens(next(ta.chunks([text.as_py()]))).hashes)
            places = offsets.values
            variant, offset, n = (places.field(name).to_numpy() for name in ("variant", "offset", "n"))
            low, high = np.maximum(0, -offset), np.minimum(n, len(own) - offset)
            for some in range(0, len(variant), 1000):
                part = slice(some, some + 1000)
                cuts = [own[o + a : o + e] for o, a, e in zip(offset[part], low[part], high[part], strict=True)]
                size = len(cuts)
                yield _batch(
                    [("doc_id", pa.array([doc_id.as_py()] * size, pa.int64())), ("fp", pa.array([fp.as_py()] * size, pa.int64())), ("variant", pa.array(variant[part])),
                     ("first", pa.array((offset + low)[part], pa.int32())), ("low", pa.array(low[part], pa.int32())), ("own", pa.array(cuts, pa.list_(pa.int64())))]
                )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, spans = [], []
        first, low = (b.column(name).to_numpy() for name in ("first", "low"))
        for i, (own, item) in enumerate(zip(b.column("own"), b.column("tokens"), strict=True)):
            equal = own.values.to_numpy() == item.values.to_numpy()[low[i] : low[i] + len(own.values)]
            if span := verified(equal, len(item.values)):
                at.append(i)
                spans.append((span[0], first[i] + span[1], first[i] + span[2]))
        found = np.array(spans, np.int32).reshape(-1, 3)
        ids = [(name, b.column(name).take(pa.array(at, pa.int64()))) for name in ("doc_id", "fp", "item_id")]
        yield _batch([*ids, *[(name, pa.array(found[:, k])) for k, name in enumerate(("equal_tokens", "from_token", "to_token"))]])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: doc_id, fp (a hash of the text), item_id and the best stretch of the pair."""
    context = docs.sparkSession.sparkContext
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("fp"), "text").filter("text IS NOT NULL")
    texts = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    items = stage(texts.withColumn("variant", F.xxhash64("item_id", "text")).mapInArrow(_item_tokens, ITEMS), "items")
    item_seeds = stage(items.mapInArrow(_item_seeds, SEEDS), "item-seeds")
    masks = [r[0] for r in items.select(F.explode("masks").alias("mask")).distinct().collect()]  # these masks, and one for each short length
    shared = context.broadcast(filters.bits_of(item_seeds.select("h"), filters.width_for(item_seeds.count())))
    hits = keyed.mapInArrow(_document_hits(shared, sorted(masks)), HITS)

    # a pair meets once for each offset, however many seeds it shares on it
    offset = F.col("at") - F.col("place")
    met = hits.join(item_seeds, "h").select("doc_id", "fp", "variant", offset.alias("offset"), "n").distinct()
    place = F.struct("variant", "offset", "n")
    lists = met.groupBy("doc_id", "fp", F.shiftright("offset", BLOCK).alias("block")).agg(F.collect_list(place).alias("offsets"))
    lists = stage(lists, "offsets")
    texts = _having(keyed, "fp", lists.select(F.col("fp").alias("h")))
    cuts = null_safe(texts, lists, ["doc_id", "fp"]).select("doc_id", "fp", "text", "offsets").mapInArrow(_cut, CUTS)
    found = cuts.join(items.select("item_id", "variant", "tokens"), "variant").mapInArrow(_verify, OVERLAPS)
    best = F.max(F.struct("equal_tokens", (-F.col("from_token")).alias("back"), "to_token")).alias("best")
    return found.groupBy("doc_id", "fp", "item_id").agg(best).select(
        "doc_id", "fp", "item_id", "best.equal_tokens", (-F.col("best.back")).alias("from_token"), "best.to_token"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per contaminated document (doc_id, fp): the items in order and the largest number of equal tokens.

    The list is bounded by the overlaps that a document has room for.
    """
    found = stage(overlaps(docs, benchmark), "overlaps")
    return found.groupBy("doc_id", "fp").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("equal_tokens").alias("equal_tokens")
    )


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of `docs`: doc_id, contaminated, n_items, items, equal_tokens."""
    hits = contaminated(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), "items", "equal_tokens")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("fp"))
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f")), "left")
    return joined.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("equal_tokens", F.lit(0)).cast("long").alias("equal_tokens"),
    )


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without overlap, all columns.

    A filter over the contaminated texts lets nearly all rows pass as they are; only those it
    holds back are compared with the table of contaminated documents, so few texts move.
    """
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"))
    found = stage(found, "contaminated")
    # names that no column of the table has, in whatever case
    taken = {c.lower() for c in docs.columns}
    mark = next(name for i in range(len(taken) + 1) if (name := f"_text_{i}") not in taken)
    marked = docs.withColumn(mark, F.xxhash64("text"))
    hashes = found.select(F.col("_f").alias("h"))
    clean = _having(marked, mark, hashes, inside=False)
    same = F.col("l.doc_id").cast("long").eqNullSafe(F.col("r._d")) & (F.col(f"l.{mark}") == F.col("r._f"))
    doubtful = _having(marked, mark, hashes).alias("l").join(found.alias("r"), same, "left_anti")
    return clean.unionAll(doubtful).drop(mark)
