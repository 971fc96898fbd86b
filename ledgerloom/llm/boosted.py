"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

A document becomes `STATISTICS`: shares of kinds of characters, words and lines,
their lengths, and how much of it repeats. Boosted trees learn the quality label
from at most `SAMPLE_ROWS` labelled rows; of the documents only these numbers
reach the driver. Each statistic is cut into `BINS` bins of equal counts; a level of a tree is
found from one histogram of gradients and curvatures per node, statistic and bin.
A held-back fifth of the rows says how many trees are kept.

The trees are flattened into arrays (statistic, threshold, left child, value; a
leaf leads to itself), so scoring walks all trees and all rows of a batch a
level at a time with numpy, in one pass without a shuffle.

Defined results: a null, empty or blank text has statistics of zero and a score
like any other. Repeated rows get the same score; a label that is null or has no
doc_id is left out; a doc_id with several labels counts with its lowest, one
with several texts with one of them. Labels of one class, or none, give their
share (0.5 for none) as everyone's score. Other columns are not looked at. Texts are taken in
chunks of bounded size; a single longer text makes a chunk of its own and takes
about 60 bytes a character. Empty tables give no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textarrays as ta

SAMPLE_ROWS = 6000
BINS = 64
TREES = 120
DEPTH = 4
RATE = 0.15
PENALTY = 1.0
LEAST_CURVATURE = 2.0
PATIENCE = 20
THRESHOLD = 0.7
CLASSES = 128  # of characters, for the entropy

STATISTICS = (
    "chars words lines word_length word_spread longest_word letters upper digits punctuation symbols space "
    "wide bare_words upper_words closed_words hung_words distinct_words repeated_pairs repeated_fours top_word "
    "repeated_lines longest_line line_words closed_lines odd_lines entropy top_char"
).split()

_LETTER, _UPPER, _DIGIT, _PUNCTUATION, _SYMBOL = 1, 2, 4, 8, 16


@cache
def _kinds() -> np.ndarray:
    """Bits of the kind of every code point, by its Unicode category."""
    bits = {"L": _LETTER, "N": _DIGIT, "P": _PUNCTUATION, "S": _SYMBOL}
    out = np.zeros(0x110000, np.uint8)
    for i in range(len(out)):
        category = unicodedata.category(chr(i))
        out[i] = bits.get(category[0], 0) | (_UPPER if category == "Lu" else 0)
    return out


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(1, whole)


def _repeats(text_of: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct values, rows of values that occur twice or more, rows of the most frequent value."""
    key = ta.mix(hashes + text_of.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    owner = text_of[first]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, times)
    return np.bincount(owner, minlength=n), np.bincount(owner, times * (times > 1), n), most


def statistics(chunk: ta.Chunk) -> np.ndarray:
    """One row of numbers per text."""
    n, chars = len(chunk.first), chunk.chars
    kind, space = _kinds()[chars], ta.is_space(chars)
    sums = {b: chunk.sums((kind & b) > 0) for b in (_LETTER, _UPPER, _DIGIT, _PUNCTUATION, _SYMBOL)}
    length = chunk.lengths

    words = ta.words(chunk)
    text_of, size = words.text_of, (words.ends - words.starts).astype(np.float64)
    count = words.counts
    per_word = lambda v: np.bincount(text_of, v, n)
    mean = _share(per_word(size), count)
    spread = np.sqrt(np.maximum(0, _share(per_word(size * size), count) - mean * mean))
    longest = np.zeros(n)
    np.maximum.at(longest, text_of, size)
    total = {b: np.concatenate([[0], np.cumsum((kind & b) > 0)]) for b in (_LETTER, _UPPER, _PUNCTUATION | _SYMBOL)}
    inside = {b: t[words.ends] - t[words.starts] for b, t in total.items()}
    closed = kind[words.ends - 1] & (_PUNCTUATION | _SYMBOL) > 0
    hung = closed & (size > 2) & (kind[np.maximum(words.ends - 2, 0)] & (_PUNCTUATION | _SYMBOL) > 0)
    distinct, _, top = _repeats(text_of, words.hashes, n)
    sequences = ta.Sequences(words.hashes)
    again = []
    for k in (2, 4):
        begin = np.flatnonzero(text_of[k - 1 :] == text_of[: len(text_of) - k + 1]) if len(text_of) >= k else np.zeros(0, np.int64)
        _, twice, _ = _repeats(text_of[begin], sequences.stretch(begin, k), n)
        again.append(_share(twice, np.maximum(0, count - k + 1)))

    lines = ta.words(chunk, chars != 10)
    line_of, line_size = lines.text_of, (lines.ends - lines.starts).astype(np.float64)
    line_count = lines.counts
    line_distinct, _, _ = _repeats(line_of, lines.hashes, n)
    longest_line = np.zeros(n)
    np.maximum.at(longest_line, line_of, line_size)
    ends = np.isin(chars[lines.ends - 1], np.array([ord(c) for c in ".!?"], np.uint32)) if len(line_of) else np.zeros(0, bool)
    odd = kind[lines.starts] & _LETTER == 0 if len(line_of) else np.zeros(0, bool)

    place = np.repeat(np.arange(n), length)
    own = np.repeat(chunk.first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(len(place))
    histogram = np.bincount(place * CLASSES + chars[own] % CLASSES, minlength=n * CLASSES).reshape(n, CLASSES)
    p = _share(histogram, length[:, None])
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)

    columns = [
        np.log1p(length), np.log1p(count), np.log1p(line_count), mean, spread, np.log1p(longest),
        _share(sums[_LETTER], length), _share(sums[_UPPER], sums[_LETTER]), _share(sums[_DIGIT], length), _share(sums[_PUNCTUATION], length),
        _share(sums[_SYMBOL], length), _share(chunk.sums(space), length), _share(chunk.sums(chars > 127), length),
        _share(per_word(inside[_LETTER] == 0), count), _share(per_word((inside[_UPPER] == inside[_LETTER]) & (inside[_LETTER] > 1)), count),
        _share(per_word(closed), count), _share(per_word(hung), count), _share(distinct, count), *again, _share(top, count),
        _share(line_count - line_distinct, line_count), _share(longest_line, length), _share(count, line_count),
        _share(np.bincount(line_of, ends, n), line_count), _share(np.bincount(line_of, odd, n), line_count), entropy, p.max(axis=1, initial=0),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


@dataclass
class Model:
    """Trees as arrays of one row per tree; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            left = self.left[trees, node]
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = np.where(left > 0, left + right, node)
        return self.base + self.value[trees, node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -60, 60)))


def _tree(binned: np.ndarray, edges: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree in breadth-first order: node k of a level has its children next to each other."""
    rows, features = binned.shape
    nodes = 2 ** (DEPTH + 1) - 1
    feature, left = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    threshold, value = np.full(nodes, np.inf), np.zeros(nodes)
    node, used, level = np.zeros(rows, np.int64), 1, np.array([0])
    for depth in range(DEPTH + 1):
        g = np.bincount(node, gradient, nodes)[level]
        h = np.bincount(node, curvature, nodes)[level]
        value[level] = -g / (h + PENALTY)
        if depth == DEPTH:
            break
        slot = np.full(nodes, -1)
        slot[level] = np.arange(len(level))
        live = slot[node] >= 0
        cell = ((slot[node[live]] * features)[:, None] + np.arange(features)) * BINS + binned[live]
        shape = (len(level), features, BINS)
        sums = [np.bincount(cell.ravel(), np.repeat(v[live], features), int(np.prod(shape))).reshape(shape).cumsum(axis=2)[:, :, :-1] for v in (gradient, curvature)]
        gl, hl = sums
        gr, hr = g[:, None, None] - gl, h[:, None, None] - hl
        gain = gl**2 / (hl + PENALTY) + gr**2 / (hr + PENALTY) - (g**2 / (h + PENALTY))[:, None, None]
        gain[(hl < LEAST_CURVATURE) | (hr < LEAST_CURVATURE)] = 0
        flat = gain.reshape(len(level), -1)
        best = flat.argmax(axis=1)
        split = np.flatnonzero(flat[np.arange(len(level)), best] > 1e-9)
        fresh = []
        for k in split:
            f, b = divmod(int(best[k]), BINS - 1)
            at = level[k]
            feature[at], threshold[at], left[at] = f, edges[f, b], used
            mine = node == at
            node[mine] = used + (binned[mine, f] > b)
            fresh += [used, used + 1]
            used += 2
        if not fresh:
            break
        level = np.array(fresh)
    return feature, threshold, left, value


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Model:
    """Boosted trees with logistic loss; kept up to the least loss of a held-back fifth."""
    share = float(y.mean()) if len(y) else 0.5
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    nodes = 2 ** (DEPTH + 1) - 1
    none = np.zeros((0, nodes))
    if len(np.unique(y)) < 2:
        return Model(none.astype(np.int64), none, none.astype(np.int64), none, base)
    # a bin ends at a value that occurs, so the trees can compare the statistic itself
    edges = np.stack([np.quantile(c, np.arange(1, BINS) / BINS, method="lower") for c in x.T])
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    order = np.random.default_rng(seed).permutation(len(y))
    held, learn = order[: len(y) // 5], order[len(y) // 5 :]
    z, trees, least, kept = np.full(len(y), base), [], np.inf, 0
    for k in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = _tree(binned[learn], edges, (p - y)[learn], (p * (1 - p))[learn])
        tree[3][:] *= RATE
        trees.append(tree)
        one = Model(*(v[None] for v in tree), 0.0)
        z = z + one.logit(x)
        loss = np.logaddexp(0, np.where(y[held] > 0, -z[held], z[held])).sum()
        if loss < least - 1e-9:
            least, kept = loss, k + 1
        elif k + 1 - kept >= PATIENCE:
            break
    return Model(*(np.stack([t[i] for t in trees[:kept]]) if kept else none.astype(trees[0][i].dtype) for i in range(4)), base)


def held_out(doc_id: Column) -> Column:
    """Is a document kept back from learning: crc32 of its id as text is 2 modulo 4; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most `rows` labelled documents, drawn by a hash of doc_id."""
    wanted = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit("boosted")), "doc_id")
        .limit(rows)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("text").alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in ta.chunks(b.column("text").to_pylist()):
                x = statistics(chunk)
                part = b.slice(chunk.rows.start, len(x))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("quality").cast(pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    sample = chosen.mapInArrow(measured, "doc_id long, quality long, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(sample.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    return train(x, (sample.column("quality").to_numpy() == 1).astype(np.int64))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in ta.chunks(b.column("text").to_pylist()):
                p = shared.value.score(statistics(chunk))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(chunk.rows.start, len(p)), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(walk, "doc_id long, score double, predicted int")
