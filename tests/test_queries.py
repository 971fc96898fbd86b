"""Every query has a callable; a spread of them is compared with its SQL statement."""

import re

import pytest

import __spark_entry__ as entry_points
import check
from tests.conftest import FOLDER

COMPARED = (
    "mart_fraud_features mart_client_monthly_expenses forecast_features int_client_transactions q4_top_visa_client "
    "cash_flow_weekly report_narrative_facts eda_error_rate dq_deduplicate target_encode_oof threshold_sweep pr_curve_cut "
    "stream_landing replay_chunk incremental_mart load_features_by_id prediction_output prediction_summary "
    "replay_stored_cursor mart_fallback ledger_buckets saved_artifacts"
).split()


@pytest.fixture(scope="module")
def con():
    return check.duck(FOLDER)


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_statement(spark, con, name):
    got = entry_points.queries()[name](spark, FOLDER).toPandas()
    assert check.difference(got, con.execute(entry_points.oracle_sql()[name]).df()) == ""


def test_statements_belong_to_queries():
    queries, statements = entry_points.queries(), entry_points.oracle_sql()
    assert set(statements) <= set(queries)
    own = {name for name in queries if not re.match(r"op\d+_|pipeline$", name)}
    assert own == set(statements) - (set(queries) - own)


def test_entry(spark):
    assert len(entry_points.entry(spark).columns) == 80
