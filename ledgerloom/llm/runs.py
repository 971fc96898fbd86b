"""Periodic runs of words, found from Lyndon arrays by Baier grouping.

A run is a stretch with smallest period q whose neighbours do not continue the
period. Its Lyndon root under one of the two orders of the alphabet is the
longest Lyndon word at its place, so the Lyndon arrays under both orders hold a
seed for every run; the seed is extended both ways by longest common extensions.

1. Grouping is the first phase of Baier's suffix sorter: positions start in
   groups of equal words; groups are taken from the highest down, and the
   nearest position to the left that has not been taken moves up behind its
   group, which lengthens its Lyndon word by the words of the group taken. When
   a position is taken, that length is its entry of the Lyndon array.
2. Extensions are exact: names of all stretches of 2**k words answer how far two
   places agree in one step per k, for all seeds at once.
3. A run of at least `LEAST` words and `TIMES` periods repeats every stretch of
   `LEAST` - `LEAST` // `TIMES` words of its part before the last period. Words
   that no repeated stretch of that size covers are in no such run, so grouping
   only sees the covered parts of a document. Nothing is lost by that.

One pass over the documents, no shuffle. A document is worked on as a whole, in
memory of about 500 bytes for each word in a covered part and 100 for any other;
documents of a batch are taken one by one.

Defined results: a null or blank text has no words, no run and an empty digest.
A null doc_id counts as one whose text is not changed by `planted`. Repeated
rows get the same result each. Ties of the greatest exponent go to the least
start, then the least period. Other columns are not looked at. Empty tables
give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textarrays as ta

LEAST = 24
TIMES = 3

Run = tuple[int, int, int]
"""start, length, period"""


def lyndon_array(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every place, by Baier grouping."""
    n = len(symbols)
    out = [0] * n
    # the places not taken yet, linked; entry n closes the right end, and stands for the left end as entry -1
    before, after = list(range(-1, n)), list(range(1, n + 2))
    letters = {s: g for g, s in enumerate(sorted(set(symbols)))}
    group = [letters[s] for s in symbols]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(letters)
    below, above = list(range(-1, len(letters) - 1)), list(range(1, len(letters) + 1))
    top = len(letters) - 1
    while top >= 0:
        width = size[top]
        times: dict[int, int] = {}
        for i in members[top]:  # in rising order
            if group[i] == top:
                out[i] = width
                left, right = before[i], after[i]
                after[left], before[right] = right, left
                if left >= 0:
                    times[left] = times.get(left, 0) + 1
        members[top] = []
        if len(times) == 1:
            raised = {times[left]: [left] for left in times}
        else:
            raised = {}
            for left, k in times.items():
                raised.setdefault(k, []).append(left)
        for k in sorted(raised, reverse=True):
            fresh: dict[int, int] = {}
            for left in raised[k]:
                old = group[left]
                new = fresh.get(old)
                if new is None:  # directly above what stays of the old group
                    fresh[old] = new = len(members)
                    members.append([])
                    size.append(size[old] + k * width)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = below[up] = new
                members[new].append(left)
                group[left] = new
        top = below[top]
    return out


def _names(symbols: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 2**k symbols at every place: equal if and only if the stretches are. Ends where none repeats."""
    names, width = [symbols], 1
    while 2 * width <= len(symbols):
        last = names[-1].astype(np.int64)
        distinct, name = np.unique((last[:-width] << 32) | last[width:], return_inverse=True)
        if len(distinct) == len(name):
            break
        names.append(name.astype(np.int32))
        width *= 2
    return names


def _agree(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many symbols agree from places a < b onwards (step 1), or before them (step -1)."""
    n, a, b = len(names[0]), a.copy(), b.copy()
    far = np.zeros(len(a), np.int64)
    # fewer than twice the largest size agree, so every size is taken once at most
    for k in range(len(names) - 1, -1, -1):
        width = 1 << k
        fits = np.flatnonzero(b + width <= n if step > 0 else a >= width)
        u, v = (a[fits], b[fits]) if step > 0 else (a[fits] - width, b[fits] - width)
        go = fits[names[k][u] == names[k][v]]
        far[go] += width
        a[go] += step * width
        b[go] += step * width
    return far


def find(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """Runs of a sequence of small integers, by start, then period."""
    n, names, found = len(symbols), _names(symbols.astype(np.int32)), []
    for order in (1, -1):
        period = np.array(lyndon_array((order * symbols).tolist()), np.int64)
        place = np.arange(n)
        left = _agree(names, place, np.minimum(place + period, n), -1)
        right = _agree(names, place, np.minimum(place + period, n), 1)
        length = left + period + right
        good = length >= np.maximum(least, times * period)
        found.append(np.stack([place - left, length, period], axis=1)[good])
    return sorted({(s, length, q) for s, length, q in np.concatenate(found).tolist()}, key=lambda r: (r[0], r[2]))


def _covered(words: list[bytes], least: int, times: int) -> list[tuple[int, int]]:
    """Parts of a document in which every word lies in a stretch that the document repeats."""
    n, size = len(words), least - least // times
    if n < least:
        return []
    hashes = ta.mix(np.fromiter(map(hash, words), np.int64, n).view(np.uint64))
    stretches = ta.Sequences(hashes).stretch(np.arange(n - size + 1), size)
    ordered = np.sort(stretches)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    starts = np.flatnonzero(np.isin(stretches, again))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    cut = np.flatnonzero(inside[1:] != inside[:-1])
    return [(a, b) for a, b in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True) if b - a >= least]


def runs_of(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """Runs of a document of at least `least` words and `times` periods, by start, then period."""
    out: list[Run] = []
    for a, b in _covered(words, least, times):
        names: dict[bytes, int] = {}
        symbols = np.array([names.setdefault(w, len(names)) for w in words[a:b]], np.int64)
        out += [(a + s, length, q) for s, length, q in find(symbols, least, times)]
    return out


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words, of every run only those of the first period and those no run holds."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words with a periodic tail in one of ten documents, chosen by crc32 of the doc_id."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    once = words[a : a + period]
    return words[:a] + (once * ((n - a) // period + 1))[: n - a]


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(
    docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST, times: int = TIMES
) -> DataFrame:
    """Every document's runs and its words, joined by blanks, with each run cut to one period.

    `change` may change the words of a document before its runs are looked for.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, runs, texts = [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                # splitting bytes cuts at ASCII white space only
                words = (text.as_py() or "").encode().split()
                words = change(doc_id, words) if change else words
                here = runs_of(words, least, times)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in here])
                texts.append(b" ".join(collapsed(words, here)).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, _RUN), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Numbers and digests of what `periodic_runs` returns; the run with the greatest exact exponent."""

    def before(x: Column, y: Column) -> Column:
        # exponents as cross products; equal ones keep their order by start and period
        a, b = (x["length"].cast("decimal(19,0)") * y["period"], y["length"].cast("decimal(19,0)") * x["period"])
        tie = F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
        return F.when(a > b, -1).when(a < b, 1).otherwise(tie)

    best = F.get(F.array_sort("runs", before), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_words", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
