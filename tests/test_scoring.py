from pyspark.sql import functions as F

from ledgerloom import queries
from ledgerloom.operators import encoding
from ledgerloom.plans import models


def test_encodings_of_requests_read_a_staged_copy_of_the_labelled_rows(spark, tables, monkeypatch):
    """The labels are joined to the transactions once, not for every mean and table of the encodings."""
    seen = []
    known = encoding.encoding_table
    monkeypatch.setattr(encoding, "encoding_table", lambda train, *rest: seen.append(train) or known(train, *rest))
    model = models.fit_focal(queries._training_rows(tables), rounds=1, depth=2)
    monkeypatch.setitem(queries._fitted, (spark.sparkContext.applicationId, tables.folder), (model, None))
    scored = queries.REGISTRY["score_requests"](spark, tables.folder)
    assert len(seen) == 2 and not any("events.parquet" in f for train in seen for f in train.inputFiles())
    want = tables.labelled.groupBy("mcc").agg(F.sum("is_fraud").alias("s"), F.count("*").alias("n")).collect()
    got = seen[0].groupBy("mcc").agg(F.sum("label").alias("s"), F.count("*").alias("n")).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}
    assert scored.filter("NOT score_valid OR NOT flag_agrees").isEmpty()
