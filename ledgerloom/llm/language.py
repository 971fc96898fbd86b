"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters of the lower-cased text, with every stretch
of non-letters as one blank, are hashed. A document's feature is the share of
an n-gram among its n-grams times the inverse document frequency, counted over
all documents one may learn from. Weights are learned by
follow-the-regularised-leader with elastic-net penalties, which leaves most at
zero, from a bounded sample per language (`SAMPLE_ROWS`). A temperature, fitted
on a held-back part of the sample, calibrates the probabilities.

Scoring needs no feature vectors: the score of a class is the bias plus the
mean over all n-grams of (inverse document frequency times weight).

Defined results: `und` with score 0 if the text is null or has no letter, or if
there is nothing to learn from. Ties of the score go to the first language in
order. Repeated rows get the same prediction. Other columns are not looked at.
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

BITS = 16
SIZES = (1, 2, 3)
SAMPLE_ROWS = 1000
UNKNOWN = "und"
_LAST = 0x110000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter; its lower case (where that is one character)."""
    letter = np.zeros(_LAST, bool)
    lower = np.arange(_LAST, dtype=np.uint32)
    for i in range(_LAST):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            letter[i] = True
            if len(c.lower()) == 1:
                lower[i] = ord(c.lower())
    return letter, lower


def _slots(chunk: ta.Chunk) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the n-grams of each size, with the range of n-grams of every text, and its number of letters.

    Non-letters shrink to one blank; a text begins and ends with one.
    """
    letter, lower = _tables()
    is_letter = letter[chunk.chars]
    # the separator behind each text is a non-letter, so texts never touch
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    sequence = np.where(is_letter, lower[chunk.chars], 32)[keep].astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(keep)])
    begin, end = at[chunk.first], at[chunk.first + chunk.lengths + 1]
    slots = []
    padded = np.concatenate([sequence, np.full(max(SIZES), 32, np.uint64)])
    for size in SIZES:
        h = np.full(len(sequence), size, np.uint64)
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + padded[i : len(h) + i]
        slots.append((ta.mix(h) >> np.uint64(64 - BITS)).astype(np.int64))
    return slots, begin, end, chunk.sums(is_letter).astype(np.int64)


def _ranges(begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """End of the n-grams that lie in begin..end."""
    return np.maximum(begin, end - size + 1)


def document_slots(text: str | None) -> np.ndarray:
    """Slots of all n-grams of one text."""
    slots, begin, end, _ = _slots(next(ta.chunks([text])))
    return np.concatenate([s[begin[0] : _ranges(begin, end, k)[0]] for s, k in zip(slots, SIZES, strict=True)])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each hashed n-gram, and documents with a text, over the whole table. Counts meet by slot before the driver reads them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                mark = np.zeros(1 << BITS, bool)
                mark[document_slots(text)] = True
                counts += mark
                rows += 1
        at = np.flatnonzero(counts)
        slot = np.concatenate([at, [-1]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.concatenate([counts[at], [rows]]))], ["slot", "n"])

    found = docs.select("text").filter("text IS NOT NULL").mapInArrow(counted, "slot int, n long")
    table = found.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = table.column("slot").to_numpy(), table.column("n").to_numpy()
    out = np.zeros(1 << BITS, np.int64)
    out[slot[slot >= 0]] = n[slot >= 0]
    return out, int(n[slot < 0].sum())


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` documents of each language (all of a rarer one), drawn by a hash of the text; at most twice as many in all.

    Copies of a text with one language count once.
    """
    labelled = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / n))).otherwise(share)
    drawn = labelled.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    return drawn.dropDuplicates(["text", "lang"]).limit(2 * rows * max(1, len(counts)))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    """Inverse document frequency times weight: slot x language."""
    bias: np.ndarray
    temperature: float

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        return softmax(scores / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    slots: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, classes: int, seed: int = 11, epochs: int = 3,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (slot x class) and biases by FTRL-proximal, one document at a time."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    bias, bias_n = np.zeros(classes), np.full(classes, 1.0)

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, x = slots[i], values[i]
            w = weight(z[at], n[at])
            error = softmax(bias + x @ w)
            error[y[i]] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += error * error
            bias -= 0.1 * error / np.sqrt(bias_n)
    return weight(z, n), bias


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        p = softmax(scores / np.exp(t))[np.arange(len(y)), y]
        return -float(np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 11) -> Model | None:
    """Learn from `docs` (text, lang): document frequencies from all, weights from the sample."""
    frequency, total = document_frequencies(docs)
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float64)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, shares = [], []
            for text in b.column("text").to_pylist():
                every = document_slots(text)
                slot, count = np.unique(every, return_counts=True)
                slots.append(slot.astype(np.int32))
                shares.append((count / max(1, len(every))).astype(np.float32))
            arrays = [b.column("lang"), b.column("key"), pa.array(slots, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "key", "slots", "shares"])

    drawn = training_sample(docs, rows).withColumn("key", F.xxhash64("text", "lang"))
    sample = drawn.mapInArrow(featured, "lang string, key long, slots array<int>, shares array<float>").toArrow()
    sample = sample.sort_by([("key", "ascending"), ("lang", "ascending")])
    names = sample.column("lang").to_pylist()
    if not names:
        return None
    languages = sorted(set(names))
    y = np.array([languages.index(n) for n in names])
    slots, shares = ta.lists(sample.column("slots")), ta.lists(sample.column("shares"))
    # rare and frequent n-grams on one scale for the learner
    values = [s.astype(np.float64) * idf[k] * 30 for k, s in zip(slots, shares, strict=True)]
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 10 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    weights, bias = fit_ftrl([slots[i] for i in train], [values[i] for i in train], y[train], len(languages), seed)
    part = np.flatnonzero(held) if held.any() else train
    scores = np.stack([bias + values[i] @ weights[slots[i]] for i in part])
    return Model(languages, (weights * idf[:, None] * 30).astype(np.float32), bias, fit_temperature(scores, y[part]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = shared.value
        for b in batches:
            ids = b.column("doc_id")
            for chunk in ta.chunks(b.column("text").to_pylist()):
                n = len(chunk.first)
                if rule is None:
                    names, score = np.full(n, UNKNOWN, object), np.zeros(n)
                else:
                    slots, begin, end, letters = _slots(chunk)
                    total, count = np.zeros((n, len(rule.languages))), np.zeros(n)
                    for of, size in zip(slots, SIZES, strict=True):
                        stop = _ranges(begin, end, size)
                        total += np.stack([ta.segment_sums(rule.table[of, c], begin, stop) for c in range(len(rule.languages))], axis=1)
                        count += stop - begin
                    p = rule.probabilities(rule.bias + total / np.maximum(1, count)[:, None])
                    best = p.argmax(axis=1)
                    names = np.where(letters > 0, np.array(rule.languages, object)[best], UNKNOWN)
                    score = np.where(letters > 0, p[np.arange(n), best], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(chunk.rows.start, n), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents one must not learn from: crc32 of doc_id as text leaves 2 on division by 4. A null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
