"""Secret scan with an incremental ledger of blobs.

Every version of every document is addressed by the SHA-256 of its text. The
ledger holds one row per (blob, rule version) that has been scanned, with the
findings. A run scans only pairs the ledger does not have, each blob once
however many documents share it, appends them, and joins the findings back to
all documents.

Defined results: a null text counts as empty and has no findings. Repeated rows
and repeated or null doc_ids each get the findings of their own text. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts when its `group` has at least `least` characters.

    `hints`: a text without any of these strings is not searched.
    """

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    hints: tuple[str, ...] = ()


RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, (":", "=")),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, ("AKIA",)),
    # runs shorter than the limit are dropped anyway
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 1, 0, ("gh",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1, 0, ("eyJ",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0, ("-----BEGIN ",)),
)
RULE_VERSION = "1"

FINDING = "array<struct<kind:string,start:int,end:int>>"


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """Findings by start, then in the order of the rules; code points, end exclusive."""
    out = []
    for place, rule in enumerate(rules):
        if rule.hints and not any(h in text for h in rule.hints):
            continue
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), place, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def address(docs: DataFrame) -> DataFrame:
    """doc_id and the blob address of each row."""
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path, or None before its first run."""
    try:
        return spark.read.schema(f"rule_version string, blob string, findings {FINDING}").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) -> (blob, findings)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, rules)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(found, kind)], ["blob", "findings"])

    return blobs.mapInArrow(scanned, f"blob string, findings {FINDING}")


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Scan what the ledger lacks, append it, and return the ledger's rows of this rule version."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    # one copy of each blob; copies meet before the shuffle
    blobs = docs.select(F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    known = read_ledger(spark, path)
    if known is not None:
        blobs = blobs.join(known.filter(F.col("rule_version") == version), "blob", "left_anti")
    fresh = scan_blobs(blobs, rules).select(F.lit(version).alias("rule_version"), "blob", "findings")
    fresh.write.mode("append").parquet(path)
    ledger = read_ledger(spark, path).filter(F.col("rule_version") == version)
    # a run that was repeated after a failure may have appended a blob twice
    return ledger.groupBy("blob").agg(F.any_value("findings").alias("findings")) if known is not None else ledger.select("blob", "findings")


def secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """doc_id, blob and findings of every row; `ledger` is the folder kept between runs."""
    path = ledger or scratch_path(docs.sparkSession, "blob-ledger")
    scanned = update_ledger(docs, path, rules, version)
    return address(docs).join(scanned, "blob").select("doc_id", "blob", "findings")
