import re

import pytest

import __spark_entry__ as entry
from tabscope.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
# Queries that fit models or write files while the plan is built.
ACTIVE = {
    "model_search", "final_fit", "model_round_trip", "describe_model", "score_batch", "preprocess_features",
    "selection_evidence", "write_idempotent", "verify_handoff", "write_splits", "read_csv_table", "final_evaluation",
    "file_inventory",
}


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(not re.match(r"op\d", name) for name in QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ACTIVE))
def test_plans_stay_on_the_jvm(spark, name):
    text = plan(spark, name)
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(spark, "category_rates")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all(len(s.split(",")) <= 3 for s in schemas)


def test_running_totals_share_one_scan_exchange(spark):
    QUERIES["probability_metrics"](spark, FOLDER).collect()
    df = QUERIES["probability_metrics"](spark, FOLDER)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final
