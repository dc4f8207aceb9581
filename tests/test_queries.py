"""A sample of the bundled queries against DuckDB, and what their plans must not contain."""

import pytest

from quillspark.plans.registry import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.oracle_check import compare

SAMPLE = [
    "quality_by_grade", "overall_grades", "metrics_summarize", "trend_drops", "ab_welch", "pool_merge_dedup",
    "duplicate_audit", "post_merge_checks", "sequential_split", "gate_filler", "gate_report", "threshold_advice",
    "ifeval_calibration", "example_validation", "prompt_warnings", "classified_prompts", "knn_bigram", "knn_words",
    "bucket_report", "latency_percentiles", "pairwise_variability", "mode_delta", "session_turns", "failure_streaks",
    "cache_compaction", "json_recovery", "framework_detections", "stream_windows", "stream_wizard",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    ok, note = compare(spark, duck, name, QUERIES[name], ORACLES[name], SMALL)
    assert ok, note


@pytest.mark.parametrize("name", ["gate_report", "overall_grades", "pool_merge_dedup", "session_turns", "duplicate_members"])
def test_plan_has_no_product_of_tables(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_scan_reads_only_what_is_needed(spark):
    plan = QUERIES["keep_newest"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "value" not in plan.split("ReadSchema")[1]


def test_written_tables_go_with_their_scope(spark):
    import os

    from quillspark.session import scratch, shared_folder

    root = f"{shared_folder(spark)}/quillspark"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with scratch(spark):
        assert QUERIES["trend_summary"](spark, SMALL).count() == 4
        assert set(os.listdir(root)) > before
    assert set(os.listdir(root)) == before
