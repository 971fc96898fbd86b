import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, node string, size string, shard string, label string, anchor string"


def make_rows():
    """Documents with nulls in every column, empty, blank and very long texts, ties, repeats and shared passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß漢x") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(60)
    rows = []
    for i in range(60):
        text = words(rng.randint(1, 150))
        if i % 6 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = passage
        lines = [text[k : k + 7] for k in range(0, len(text), 7)]
        rows.append((i, "\n".join(" ".join(line) for line in lines), ["en", "de", None][i % 3], f"s{i % 4}" if i % 9 else None))
    base = words(120)
    for i in range(60, 70):
        near = list(base)
        near[(i * 11) % 120] = "other"
        rows.append((i, " ".join(near), "en", "s1"))
    rows += [
        (100, None, "en", "s0"),
        (101, "", None, "s0"),
        (102, " \t\r\n\x0b\x0c ", "en", None),
        (None, "null id\nwith some words", "en", "s0"),
        (None, None, None, None),
        (103, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "en", "s2"),
        (104, "\n".join(["same line"] * 12), "de", "s2"),
        (105, " ".join(words(40_000)), "en", "s3"),
        (106, "one two three", "de", "s3"),
        (107, "one  two\tthree", "de", "s3"),
        (108, "1234 !! 漢", "de", "s3"),
        (5, rows[5][1], rows[5][2], rows[5][3]),
        (5, rows[5][1], rows[5][2], rows[5][3]),
        (5, "another text of the same number", "en", "s1"),
        (109, rows[7][1], "en", "s0"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), "x", None, "z", "q", None, "1") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter(F.lit(False))
