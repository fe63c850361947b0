"""Plan tests: the physical plans are the ones we want at scale."""

import pytest

from tests.conftest import SF_SMALL

from __spark_entry__ import queries

from skein.plans.catalog import REGISTRY  # noqa: E402

QUERIES = {k: v for k, v in queries().items() if k in REGISTRY}
# Python crosses only where the survey allows it: the long-text motif counter, the batched numpy scorer
# (predict_batch_udf), the stateful running count and the optional pandas
# embedder.  Format checks and answer scoring (J07/J08) never cross.
PYTHON_ALLOWED = {"soft_label_prompts", "motif_repetition_text",
                  "stream_running_count", "pair_scores", "design_total", "ledger_last",
                  "ledger_running_count", "motif_repetition_documents", "composition_embeddings_pandas",
                  "pair_scores_stored_weights", "design_total_cached", "design_report", "design_trace"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")
                                        and not n.startswith("train_pair_")))
def test_no_cartesian_no_row_udf(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan          # no row-at-a-time Python UDF
    if name not in PYTHON_ALLOWED:
        assert "ArrowEvalPython" not in plan and "MapInPandas" not in plan
    # every window has a partition key: "Window [exprs], [partition], [order]"
    for line in plan.splitlines():
        stripped = line.lstrip(" :+-*()0123456789")
        if stripped.startswith("Window ["):
            parts = stripped.split("], [")
            assert len(parts) >= 3 and parts[1].strip(), line


def test_scoring_reads_only_needed_columns(spark):
    df = QUERIES["answer_total"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in scan
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)]" in scan


def test_format_checks_are_one_projection_over_the_scan(spark):
    df = QUERIES["format_checks"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan                  # no shuffle at all
    assert "WholeStageCodegen" in plan or "*(1)" in plan


def test_mean_pool_and_ledger_have_no_hot_key_window(spark):
    plan = plan_of(QUERIES["mean_pool"](spark, SF_SMALL))
    assert "Window" not in plan
    assert "HashAggregate" in plan or "ObjectHashAggregate" in plan
    plan = plan_of(QUERIES["ledger_last"](spark, SF_SMALL))
    assert "Window" not in plan


@pytest.mark.parametrize("name", ["answer_total", "scored_from_prompts", "group_advantage"])
def test_blocks_are_extracted_once_a_scan(spark, name):
    from skein.functions.text import ANSWER_BLOCK_CI, THINK_BLOCK_CI
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    scans = plan.count("Relation [")
    for pattern in (THINK_BLOCK_CI, ANSWER_BLOCK_CI):
        assert 1 <= plan.count(f", {pattern}, ") <= scans, pattern


def test_confidence_text_stays_in_the_jvm(spark):
    assert "Arrow" not in plan_of(QUERIES["soft_label_given"](spark, SF_SMALL))
    # what is left in Python is the pair scorer
    plan = plan_of(QUERIES["soft_label_prompts"](spark, SF_SMALL))
    assert {n for n in ("predict", "confidence_text") if n in plan} == {"predict"}
