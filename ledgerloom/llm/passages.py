"""Substring dedup by repeated-phrase automata.

A window is `WINDOW` consecutive words of one document; a word goes if a window
that covers it has a word sequence that starts anywhere else too.

1. Anchors: of the `GRAM`-word grams in every window the first one with the least
   hash. Windows with the same words have the same anchor, so only windows whose
   anchor gram occurs twice can repeat. Consecutive windows with their anchor at
   one place give one row with a hash of all their words.
2. Confirm: an anchor all of whose occurrences have the same hash confirms all
   its windows. The others are expanded to their windows, and those whose
   sequence occurs twice are confirmed.
3. Automata: confirmed windows that follow each other are one passage. The
   documents, joined with what is confirmed for them, are dealt to tasks; each
   task compiles the passages of a shard of documents (some hundred thousand
   words) into an Aho-Corasick automaton over word numbers, and streams the
   shard's documents through it to locate every occurrence of every passage.
   What is located is removed.

Work and memory follow the documents: a shard's automaton holds no more words
than the shard.

Defined results: a null text has no words. Documents of fewer words than a
window lose nothing. Every row is a document of its own, so repeated rows
remove each other's words from the window length on. Null doc_ids are keys like
others. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textarrays as ta
from ledgerloom.llm.common import keyed, null_safe, stage

WINDOW = 35
GRAM = 8

KEY = ["doc_id", "fp"]
_DOC = [("doc_id", pa.int64()), ("fp", pa.int64())]


def windows(chunk: ta.Chunk) -> tuple[ta.Words, ta.Sequences, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their stretches; per window that stays in one text: its first word, its anchor, the place of the anchor."""
    words = ta.words(chunk)
    stretches = ta.Sequences(words.hashes)
    n = len(words.hashes)
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return words, stretches, none, none.view(np.uint64), none
    grams = stretches.stretch(np.arange(n - GRAM + 1), GRAM)
    text_of = words.text_of
    begin = np.flatnonzero(text_of[: n - WINDOW + 1] == text_of[WINDOW - 1 :])
    place = ta.sliding_argmin(grams, WINDOW - GRAM + 1)[begin]
    return words, stretches, begin, grams[place], place


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run; `breaks` is true where a run begins."""
    first = np.flatnonzero(breaks)
    return first, np.concatenate([first[1:], [len(breaks)]])[: len(first)] - 1


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, anchor, around): a row per run of windows with one anchor; `around` hashes all words of the run."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, prints = b.column("doc_id"), b.column("fp")
            for chunk in ta.chunks(b.column("text").to_pylist()):
                words, stretches, begin, anchor, place = windows(chunk)
                if not len(begin):
                    continue
                text = words.text_of[begin]
                first, last = _runs(np.concatenate([[True], place[1:] != place[:-1]]))
                around = stretches.stretch(begin[first], begin[last] - begin[first] + WINDOW)
                at = pa.array(text[first] + chunk.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), prints.take(at), pa.array(anchor[first].view(np.int64)), pa.array(around.view(np.int64))],
                    ["doc_id", "fp", "anchor", "around"],
                )

    return docs.mapInArrow(found, "doc_id long, fp long, anchor long, around long")


def _expanded(docs: DataFrame) -> DataFrame:
    """Windows of the documents whose anchor is among the row's `mixed` anchors."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, prints, mixed = b.column("doc_id"), b.column("fp"), b.column("mixed")
            for chunk in ta.chunks(b.column("text").to_pylist()):
                words, stretches, begin, anchor, _ = windows(chunk)
                if not len(begin):
                    continue
                text = words.text_of[begin]
                wanted = _member(text, anchor.view(np.int64), mixed.slice(chunk.rows.start, len(chunk.first)))
                at = pa.array(text[wanted] + chunk.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), prints.take(at), pa.array(stretches.stretch(begin[wanted], WINDOW).view(np.int64))], ["doc_id", "fp", "window"]
                )

    return docs.mapInArrow(found, "doc_id long, fp long, window long")


def _member(text: np.ndarray, values: np.ndarray, lists: pa.Array) -> np.ndarray:
    """True where a text's value is in the text's own list."""
    out = np.zeros(len(values), bool)
    edge = np.searchsorted(text, np.arange(len(lists) + 1))
    for i, own in enumerate(lists):
        if own.is_valid and len(own.values) and edge[i] < edge[i + 1]:
            out[edge[i] : edge[i + 1]] = np.isin(values[edge[i] : edge[i + 1]], own.values.to_numpy())
    return out


def automaton(passages: list[tuple[int, ...]]) -> ahocorasick.Automaton:
    """Automaton over sequences of word numbers; a hit gives its passage's length."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for passage in passages:
        out.add_word(passage, len(passage))
    out.make_automaton()
    return out


def located(chunk: ta.Chunk, whole: pa.Array, single: pa.Array) -> tuple[ta.Words, np.ndarray]:
    """Words of a shard, and which of them an occurrence of a confirmed passage covers."""
    words, stretches, begin, anchor, _ = windows(chunk)
    covered = np.zeros(len(words.hashes) + 1, np.int64)
    if len(begin):
        text = words.text_of[begin]
        confirmed = _member(text, anchor.view(np.int64), whole) | _member(text, stretches.stretch(begin, WINDOW).view(np.int64), single)
        begin, text = begin[confirmed], text[confirmed]
    if len(begin):
        first, last = _runs(np.concatenate([[True], (begin[1:] != begin[:-1] + 1) | (text[1:] != text[:-1])]))
        number = np.unique(words.hashes, return_inverse=True)[1].astype(np.uint32)
        sequence = tuple(number.tolist())
        spans = sorted(zip(begin[first].tolist(), (begin[last] + WINDOW).tolist(), strict=True))
        search = automaton(list({sequence[a:b] for a, b in spans}))
        # documents without a confirmed window can hold no passage
        for i in np.unique(text).tolist():
            a, b = int(words.first[i]), int(words.first[i] + words.counts[i])
            for end, size in search.iter(sequence[a:b]):
                covered[a + end + 1 - size] += 1
                covered[a + end + 1] -= 1
    return words, np.cumsum(covered)[:-1] > 0


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _removed(joined: DataFrame, texts: bool) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, whole, single = b.column("doc_id"), b.column("whole"), b.column("single")
            values = b.column("text").to_pylist()
            for chunk in ta.chunks(values):
                part = slice(chunk.rows.start, chunk.rows.stop)
                n = part.stop - part.start
                words, gone = located(chunk, whole.slice(part.start, n), single.slice(part.start, n))
                digests, kept = [], []
                for i, text in enumerate(values[part]):
                    own = (text or "").encode("utf-8", "surrogatepass").split()
                    drop = gone[words.first[i] : words.first[i] + words.counts[i]]
                    if drop.any():
                        own = [own[k] for k in np.flatnonzero(~drop).tolist()]
                    line = b" ".join(own)
                    digests.append(hashlib.sha256(line).hexdigest())
                    kept.append(line.decode("utf-8", "surrogatepass") if texts else None)
                lost = np.concatenate([[0], np.cumsum(gone)])
                removed = lost[words.first + words.counts] - lost[words.first]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.start, n), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return joined.mapInArrow(cut, RESULT)


def confirmed(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, fp) with something to remove: `whole`, anchors all of whose windows repeat, and `single`, other windows that do."""
    rows = stage(anchors(docs), "passage-anchors")
    counted = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("low"), F.max("around").alias("high"))
    recurring = stage(counted.filter("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("same")), "passage-recurring")
    hits = rows.select(*KEY, "anchor").join(recurring, "anchor")
    lists = hits.groupBy(*KEY).agg(
        F.collect_list(F.when(F.col("same"), F.col("anchor"))).alias("whole"), F.collect_list(F.when(~F.col("same"), F.col("anchor"))).alias("mixed")
    )
    lists = stage(lists, "passage-lists")
    expanded = stage(_expanded(null_safe(docs, lists.filter(F.size("mixed") > 0).drop("whole"), KEY)), "passage-windows")
    twice = stage(expanded.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window"), "passage-twice")
    single = expanded.join(twice, "window").groupBy(*KEY).agg(F.collect_list("window").alias("single"))
    both = null_safe(lists.select(*KEY, "whole"), single, KEY, "left")
    return stage(both.filter((F.size("whole") > 0) | F.col("single").isNotNull()), "passage-confirmed")


def substring_dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: the words that stay, joined by a space."""
    rows = keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    return _removed(null_safe(rows, confirmed(rows), KEY, "left"), texts)
