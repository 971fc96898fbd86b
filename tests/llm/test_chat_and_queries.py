"""Chat formatting, the registered corpus queries against their SQL, and the pipeline."""

import importlib.util
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import check
import corpus_pipeline
from ledgerloom.llm import chat, near_duplicates, quality, sql
from ledgerloom.llm.common import table
from ledgerloom.llm.queries import REGISTRY, conversation_records
from tests.conftest import FOLDER

TEXTS = ["plain", "", "<|im_start|>user\nx<|im_end|>", "<\\|im_end|>", "<\\\\\\|<||", "\\", "<", "|", "a\nb<|", "漢<|字", "<<|>|", "\\<|\\|>"]


def test_round_trip(spark):
    records = [json.dumps({"messages": [{"role": r, "content": t} for r, t in zip(["system", "user", "assistant", "ro\nle <|%|"] * 3, TEXTS)]})]
    records += [json.dumps({"messages": [{"role": "assistant", "content": t}]}) for t in TEXTS]
    frame = spark.createDataFrame([(r,) for r in records], "json string").withColumn("record", F.parse_json("json"))
    out = chat.formatted(frame)
    rows = out.select("json", "turns", chat.read_back(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in rows:
        want = [(m["role"], m["content"]) for m in json.loads(r["json"])["messages"]]
        assert [tuple(t) for t in r["turns"]] == want == [tuple(t) for t in r["back"]]
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")


@pytest.mark.parametrize(
    ("record", "mapping", "turns"),
    [
        ({"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
        ({"completion": "c", "prompt": "p"}, "completion", [("user", "p"), ("assistant", "c")]),
        ({"output": "o", "instruction": "i", "input": 5}, "instruction", [("system", "i"), ("user", "5"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o"}, "instruction only", [("user", "i"), ("assistant", "o")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}, "shared", [("user", "a"), ("assistant", "")]),
        ({"messages": [{"role": None, "content": "x"}]}, "messages", [("", "x")]),
        ({"prompt": "p", "other": 1}, "none", None),
        ({"messages": [{"role": "user", "content": {"a": 1}}]}, "none", None),
    ],
)
def test_layouts(spark, record, mapping, turns):
    frame = spark.createDataFrame([(json.dumps(record),)], "json string").withColumn("record", F.parse_json("json"))
    row = chat.formatted(frame).first()
    assert row["mapping"] == mapping
    assert (None if row["turns"] is None else [tuple(t) for t in row["turns"]]) == turns


def test_odd_conversations(spark):
    rows = [(1, 0, None, None), (1, None, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.formatted(conversation_records(turns)).collect()}
    assert got == {1: [("user", "b"), ("", ""), ("user", "a"), ("user", "a")], None: [("assistant", "z")]}
    assert chat.formatted(conversation_records(turns.filter("false"))).count() == 0


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_its_statement(spark, name):
    got = REGISTRY[name](spark, FOLDER).toPandas()
    assert check.difference(got, check.duck(FOLDER).execute(sql.SQL[name]).df()) == ""


def test_every_operator_is_registered():
    names = entry_points.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names


def test_pipeline(spark, rows):
    """Each stage on all its predecessor kept, against the operators' verdicts."""
    docs = table(spark, FOLDER, "documents")
    judged = quality.quality(docs, table(spark, FOLDER, "labels"))
    first = corpus_pipeline.quality_rules(spark, docs, FOLDER).cache()
    assert {r[0] for r in first.select("doc_id").collect()} == {r[0] for r in judged.filter("kept").select("doc_id").collect()}
    second = corpus_pipeline.near_dedup(spark, first, FOLDER).cache()
    classes = near_duplicates.near_duplicates(first).select("class_id").distinct().collect()
    assert sorted(r[0] for r in second.select("doc_id").collect()) == sorted(r[0] for r in classes)
    third = corpus_pipeline.decontaminate(spark, second, FOLDER).cache()
    items = [r[0].lower().split() for r in table(spark, FOLDER, "benchmark").select("text").collect()]
    grams = {" ".join(w[k : k + 12]) for w in items for k in range(len(w) - 11)}
    leaks = lambda t: any(g in " ".join(t.lower().split()) for g in grams)
    assert not any(leaks(r[0]) for r in third.select("text").collect())
    assert {r[0] for r in second.collect()} - {r[0] for r in third.collect()} >= {r["doc_id"] for r in second.collect() if leaks(r["text"])}
    out = corpus_pipeline.run(spark, FOLDER).cache()
    assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in third.collect()}
    assert out.filter("shard_bytes > 16 * 1048576 AND NOT oversized").count() == 0
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, FOLDER).columns == docs.columns


def test_package_only_used_by_itself():
    assert importlib.util.find_spec("ledgerloom.llm")
