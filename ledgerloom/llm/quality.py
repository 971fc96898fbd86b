"""Quality rules: a hashed n-gram classifier on top of plain counting rules.

Words (one and two) and characters (two to four) are hashed into one table of
weights. A document's score is the bias plus the mean weight of its word
n-grams plus the mean weight of its character n-grams, so scoring is one table
lookup per n-gram and needs no feature vectors. The weights come from a bounded
sample of labelled rows (`SAMPLE_ROWS`); a held-back fifth of it fits the
probability calibration. The threshold on the calibrated probability is fixed.

Defined results: a null or blank text has no words, fails the base rules and is
not kept. Repeated rows get the same verdict. Without labelled rows of both
classes there is no classifier: `p_quality` is null and the base rules decide.
Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textarrays as ta

BITS = 18
SAMPLE_ROWS = 1500
THRESHOLD = 0.5
CHAR_SIZES = (2, 3, 4)
SYMBOLS = "#*$%&|<>"

_GROUPS = 2  # words, characters


@dataclass
class Model:
    """Weights per hashed n-gram; `slope` and `shift` calibrate the logit."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -60, 60)))


def _word_slots(words: ta.Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of one-word and two-word n-grams, and the text of each."""
    text_of = words.text_of
    pair = np.flatnonzero(text_of[1:] == text_of[:-1])
    two = ta.mix(words.hashes[pair] * np.uint64(3) + words.hashes[pair + 1])
    slots = np.concatenate([words.hashes, two]) >> np.uint64(64 - BITS)
    return slots.astype(np.int64), np.concatenate([text_of, text_of[pair]])


def _char_slots(chunk: ta.Chunk, size: int) -> np.ndarray:
    """Slot of the character n-gram that starts at each character."""
    padded = np.concatenate([chunk.chars, np.zeros(size - 1, np.uint32)])
    h = np.full(len(chunk.chars), size, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + padded[i : len(h) + i]
    return (ta.mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


def _char_ends(chunk: ta.Chunk, size: int) -> np.ndarray:
    """First character from which an n-gram would pass the end of its text."""
    return chunk.first + np.maximum(0, chunk.lengths - size + 1)


def logits(chunk: ta.Chunk, words: ta.Words, model: Model) -> np.ndarray:
    n = len(chunk.first)
    slots, text_of = _word_slots(words)
    total = np.bincount(text_of, model.weights[slots], n)
    out = model.bias + total / np.maximum(1, np.bincount(text_of, minlength=n))
    total, count = np.zeros(n), np.zeros(n)
    for size in CHAR_SIZES:
        end = _char_ends(chunk, size)
        total += ta.segment_sums(model.weights[_char_slots(chunk, size)], chunk.first, end)
        count += end - chunk.first
    return out + total / np.maximum(1, count)


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct slots of each text and their shares, as `logits` weighs them."""
    for text in texts:
        chunk = next(ta.chunks([text]))
        slots, _ = _word_slots(ta.words(chunk))
        parts = [(slots, 1 / max(1, len(slots)))]
        chars = [_char_slots(chunk, k)[: max(0, chunk.lengths[0] - k + 1)] for k in CHAR_SIZES]
        parts += [(c, 1 / max(1, sum(map(len, chars)))) for c in chars]
        every = np.concatenate([p for p, _ in parts])
        share = np.concatenate([np.full(len(p), s) for p, s in parts])
        slot, place = np.unique(every, return_inverse=True)
        yield slot, np.bincount(place, share, len(slot)).astype(np.float32)


def _within(texts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hash of the pair (text, hash)."""
    return ta.mix(hashes + texts.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def base_counts(chunk: ta.Chunk, words: ta.Words) -> dict[str, np.ndarray]:
    n, chars = len(chunk.first), chunk.chars
    symbol = np.isin(chars, np.array([ord(c) for c in SYMBOLS], np.uint32))
    text_of = words.text_of
    # three-word windows
    begin = np.flatnonzero(text_of[2:] == text_of[:-2]) if len(text_of) > 2 else np.zeros(0, np.int64)
    windows = _within(text_of[begin], ta.Sequences(words.hashes).stretch(begin, 3))
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = begin[times[place] > 1]
    covered = np.zeros(len(text_of), bool)
    for i in range(3):
        covered[again + i] = True
    # lines that hold a word
    lines = ta.words(chunk, chars != 10)
    seen = np.concatenate([[0], np.cumsum(~ta.is_space(chars))])
    full = seen[lines.ends] > seen[lines.starts]
    line_text = lines.text_of[full]
    distinct = line_text[np.unique(_within(line_text, lines.hashes[full]), return_index=True)[1]]
    return {
        "n_words": words.counts,
        "word_chars": np.bincount(text_of, words.ends - words.starts, n).astype(np.int64),
        "n_symbols": chunk.sums(symbol).astype(np.int64),
        "n_dup_lines": np.bincount(line_text, minlength=n) - np.bincount(distinct, minlength=n),
        "n_repeat_words": np.bincount(text_of, covered, n).astype(np.int64),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, p_quality double"


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and quality of at most `rows` labelled documents, drawn by a hash of doc_id.

    A repeated doc_id counts once: with its lowest label and one of its texts.
    """
    wanted = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(wanted), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, rounds: int = 12, seed: int = 7) -> Model | None:
    """Logistic regression by mini-batches with per-weight step sizes, then calibration."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, shares = zip(*features(b.column("text").to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("quality").cast(pa.int32()),
                    pa.array([s.astype(np.int32) for s in slots], pa.list_(pa.int32())),
                    pa.array(list(shares), pa.list_(pa.float32())),
                ],
                ["doc_id", "quality", "slots", "shares"],
            )

    schema = "doc_id long, quality int, slots array<int>, shares array<float>"
    sample = training_sample(docs, labels, rows).mapInArrow(featured, schema).toArrow().sort_by("doc_id")
    y = sample.column("quality").to_numpy()
    if len(np.unique(y)) < 2:
        return None
    slots, shares = ta.lists(sample.column("slots")), ta.lists(sample.column("shares"))
    del sample
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    weights, bias = np.zeros(1 << BITS, np.float32), 0.0
    square, square_bias = np.full(1 << BITS, 1e-8, np.float32), 1e-8
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            at = np.concatenate([slots[i] for i in part])
            x = np.concatenate([shares[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(slots[i]) for i in part])
            z = bias + np.bincount(row, weights[at] * x, len(part))
            error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[part]
            gradient = np.bincount(at, x * error[row], 1 << BITS).astype(np.float32) / len(part)
            square += gradient * gradient
            weights -= 0.5 * gradient / np.sqrt(square)
            square_bias += error.mean() ** 2
            bias -= 0.5 * error.mean() / square_bias**0.5
    model = Model(weights, bias)
    part = held if len(np.unique(y[held])) == 2 else order
    z = np.array([bias + weights[slots[i]] @ shares[i] for i in part])
    model.slope, model.shift = calibrate(z, y[part])
    del slots, shares
    pa.default_memory_pool().release_unused()
    return model


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logit by penalised Newton steps, with labels drawn in a little from 0 and 1."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, at = np.where(y > 0, high, low), np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -60, 60)))
        gradient = x @ (p - target) + 1e-3 * (at - [1, 0])
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        at = at - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def verdicts(chunk: ta.Chunk, model: Model | None, threshold: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray | None]:
    """Counts, base_failed, kept and probability of every text."""
    found = ta.words(chunk)
    counts = base_counts(chunk, found)
    failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
    p = None if model is None else model.probability(logits(chunk, found, model))
    return counts, failed, ~failed if p is None else ~failed & (p >= threshold), p


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base rules and verdict of every document, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = shared.value
        for b in batches:
            ids = b.column("doc_id")
            for chunk in ta.chunks(b.column("text").to_pylist()):
                counts, failed, kept, p = verdicts(chunk, rule, threshold)
                size = len(failed)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(chunk.rows.start, size),
                        *[pa.array(counts[c], pa.int64()) for c in COUNTS],
                        pa.array(failed),
                        pa.array(kept),
                        pa.nulls(size, pa.float64()) if p is None else pa.array(p),
                    ],
                    ["doc_id", *COUNTS, "base_failed", "kept", "p_quality"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, SCHEMA)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled rows among `docs` and judge every row of `docs`."""
    return score(docs, fit(docs, labels), threshold)


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = shared.value
        for b in batches:
            for chunk in ta.chunks(b.column("text").to_pylist()):
                _, _, kept, _ = verdicts(chunk, rule, threshold)
                yield b.slice(chunk.rows.start, len(kept)).filter(pa.array(kept))

    return docs.mapInArrow(filtered, docs.schema)
