"""Line dedup by winnowing over line hashes.

Lines that hold a word are hashed, stripped of white space at both ends. `GRAM`
consecutive lines make a gram; of every `WINDOW` consecutive grams the least is
a fingerprint. Two runs of `RUN` = GRAM + WINDOW - 1 equal lines therefore share
a fingerprint at the same place. A row is written per selected fingerprint; only
those found at two places are extended to the stretches of `RUN` lines that
selected them, and a hash of all lines of a stretch finds where it stood first
(the first place of a fingerprint need not be the first of each stretch around
it). Stretches that follow each other on the same pair of documents grow to
runs, and every run but the first is deleted.

A line goes if a stretch of `RUN` lines that covers it also started earlier, in
order of doc_id (null first), a hash of the text, and position; so of
overlapping repeats in one document the first lines stay. Lines without a word
stay and do not interrupt a run.

The functions take another least length as `run`. Below `RUN` lines the window
shrinks with it, then the gram, so repeats of `run` lines still share a
fingerprint; at one line every later copy of a line goes.

Defined results: a null text stays null and has no lines. Rows that repeat
doc_id and text count as one document and share its result. Other columns pass
through. Empty tables give no rows. The line feed is the only line end; a
carriage return is white space of its line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import keyed, stage

GRAM = 2
WINDOW = 4
RUN = GRAM + WINDOW - 1

KEY = ["doc_id", "fp"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it any number of times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _hashes(text: Column) -> Column:
    """Hashes of the lines that hold a word."""
    strip = lambda s: F.regexp_replace(s, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.transform(F.filter(_split(text), _has_word), lambda s: F.xxhash64(strip(s)))


def _upto(count: Column) -> Column:
    """0, 1, ... count - 1; empty for no or a negative count."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _fingerprints(hashes: Column, run: int) -> Column:
    """Selected fingerprints: the first stretch of `run` lines that selects it, the print, hashes of all stretches that do."""
    gram = min(GRAM, run)
    width = run - gram + 1

    def of(h: Column) -> Column:
        grams = F.transform(_upto(F.size(h) - (gram - 1)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(gram)]))

        def place(g: Column, j: Column) -> Column:
            window = [F.get(g, j + k) for k in range(width)]
            least = F.least(*window) if width > 1 else window[0]
            return F.coalesce(*[F.when(v == least, j + k) for k, v in enumerate(window)])

        def selected(g: Column, at: Column) -> Column:
            # places never go back, so the stretches of a fingerprint follow each other
            heads = F.filter(_upto(F.size(at)), lambda j: (j == 0) | (F.get(at, j - 1) != F.get(at, j)))
            whole = lambda j: F.xxhash64(*[F.get(h, j + k) for k in range(run)])

            def fingerprint(j: Column) -> Column:
                own = F.filter(F.sequence(j, j + (width - 1)), lambda i: F.get(at, i) == F.get(at, j))
                return F.struct(j.alias("line"), F.get(g, F.get(at, j)).alias("print"), F.transform(own, whole).alias("stretches"))

            return F.transform(heads, fingerprint)

        return _let(grams, lambda g: _let(F.transform(_upto(F.size(g) - (width - 1)), lambda j: place(g, j)), lambda at: selected(g, at)))

    return _let(hashes, of)


def repeated_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Runs to delete: doc_id, fp, from_line, n_lines, and where they stood first: first_id, first_fp, first_line.

    Line numbers count lines that hold a word, from 0.
    """
    rows = keyed(docs).filter("text IS NOT NULL")
    found = stage(rows.select(*KEY, F.explode(_fingerprints(_hashes(F.col("text")), run)).alias("s")).select(*KEY, "s.*"), "line-fingerprints")
    place = F.struct(*KEY, "line")
    prints = found.groupBy("print").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter(~F.col("low").eqNullSafe(F.col("high")))
    prints = stage(prints.select("print"), "line-prints")
    matched = found.join(prints, "print", "left_semi").select(*KEY, F.col("line").alias("head"), F.posexplode("stretches").alias("k", "stretch"))
    matched = stage(matched.select(*KEY, (F.col("head") + F.col("k")).alias("line"), "stretch"), "line-matches")
    here = F.struct(*KEY, "line")
    firsts = matched.groupBy("stretch").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
    firsts = stage(firsts.select("stretch", "first"), "line-firsts")
    later = matched.join(firsts, "stretch").filter(~here.eqNullSafe(F.col("first")))
    pair = later.select(*KEY, "line", F.col("first.doc_id").alias("first_id"), F.col("first.fp").alias("first_fp"), F.col("first.line").alias("first_line")).distinct()
    side = [*KEY, "first_id", "first_fp", (F.col("line") - F.col("first_line")).alias("shift")]
    order = Window.partitionBy(*KEY, "first_id", "first_fp", "shift").orderBy("line")
    placed = pair.select(*side, "line", "first_line").withColumn("island", F.col("line") - F.row_number().over(order))
    runs = placed.groupBy(*KEY, "first_id", "first_fp", "shift", "island").agg(
        F.min("line").alias("from_line"), (F.max("line") - F.min("line") + run).alias("n_lines"), F.min("first_line").alias("first_line")
    )
    return runs.drop("shift", "island")


def deduplicated(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The rows of `docs` with repeated runs cut out of the text, as `_row` (the input row without its text), text, n_lines, n_removed."""
    runs = repeated_runs(docs, run)
    spans = runs.groupBy(*KEY).agg(F.collect_set(F.struct("from_line", "n_lines")).alias("_runs"))
    spans = stage(spans.select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), "_runs"), "line-runs")
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    rows = docs.select(rest.alias("_row"), "text", F.xxhash64("text").alias("_fp"))
    # the runs grow with the documents: never a broadcast, the same plan at every size
    joined = rows.join(spans.hint("merge"), F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_fp") == F.col("_f")), "left")

    def gone(lines: Column) -> Column:
        """Positions of the deleted lines among all lines."""
        full = F.filter(_upto(F.size(lines)), lambda i: _has_word(F.get(lines, i)))
        numbers = F.array_distinct(F.flatten(F.transform("_runs", lambda r: F.sequence(r["from_line"], r["from_line"] + r["n_lines"] - 1))))
        return _let(full, lambda f: F.transform(numbers, lambda k: F.get(f, k)))

    def rest_of(lines: Column) -> Column:
        kept = lambda out: F.array_join(F.transform(F.array_except(_upto(F.size(lines)), out), lambda i: F.get(lines, i)), "\n")
        return _let(gone(lines), lambda out: F.struct(kept(out).alias("text"), F.size(out).alias("n")))

    cut = F.when(F.col("_runs").isNotNull(), _let(_split(F.col("text")), rest_of))
    return joined.withColumn("_cut", cut).select(
        "_row",
        F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.col("_cut.text")).alias("text"),
        F.coalesce(F.size(_split(F.col("text"))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("_cut.n", F.lit(0)).cast("long").alias("n_removed"),
    )


def line_dedup(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The columns of `docs`, with shortened texts (and their n_chars, where there is such a column)."""
    out = deduplicated(docs, run)
    chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*[F.col("text") if c == "text" else chars.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
