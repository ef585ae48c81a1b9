import pytest

import __spark_entry__ as entry
from claimloom.plans import more, queries
from tests.oracle import compare


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["tokens", "sentences", "numbers", "windows_top3", "verify", "core_metrics", "threshold_best", "calibration", "breakdown", "cosine_argmax", "graph_edges", "eight_rules", "retention", "gate_by_source"])
def test_query_equals_sql(spark, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], "/root/testdata/sf0.001") == ""


@pytest.mark.parametrize("name", ["web_tokens", "web_entities", "web_gate", "prediction_analysis", "prediction_sweep", "cost_summary", "per_dataset", "breakdown_table", "dataset_hash", "message_sums", "last_turn", "token_chunks", "url_kinds", "run_rows", "ablation"])
def test_more_queries_equal_sql(spark, name):
    assert compare(spark, name, more.QUERIES[name], more.ORACLE[name], "/root/testdata/sf0.001") == ""
