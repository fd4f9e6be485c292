"""Plan-shape checks: what the physical plans must (not) contain for the job to scale."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from postkit.operators.current import current_postings
from postkit.operators.warehouse import load_new, read_table
from postkit.plans import fixtures as X
from postkit.session import scratch_path

SF = "/root/testdata/sf0.001"
PYTHON_OK = {"nav_cards_parsed", "html_text", "score_postings", "incremental_score", "jobs_cz_cards",
             "linkedin_cards", "jobstack_links", "jobstack_links_all", "jobs_cz_cards_all", "cards_by_spec_cap", "nav_cards_all"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# the training-data queries run jobs while they are built; tests/llm covers them
LAZY = sorted(n for n in queries() if not re.match(r"op\d+_|pipeline$", n))


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_no_row_udf(spark, name):
    plan = _plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan              # no row-at-a-time Python UDFs
    if name not in PYTHON_OK:
        assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["board_topk", "sort_options"])
def test_group_limit_before_shuffle(spark, name):
    df = queries()[name](spark, SF)
    df.collect()
    plan = _plan(df)
    assert plan.count("WindowGroupLimit") >= 2          # partial (map side) + final


def test_warehouse_pushdown_and_partition_pruning(spark):
    path = scratch_path(spark, "wh-plan")
    load_new(spark, X.postings_b(spark, SF).drop("loaded_at"), path, X.LOADED_AT)
    t = read_table(spark, path)
    q = current_postings(t, X.overrides_l(spark, SF), since="2024-01-20", ordered=False).where(F.col("score") >= 50)
    txt = q._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(scraped_date" in txt and "2024-01-20" in txt
    assert "GreaterThanOrEqual(score,50)" in txt
    scan = [ln for ln in txt.splitlines() if ln.startswith("ReadSchema") and "job_id" in ln][0]
    assert "loaded_at" not in scan                       # column pruning reaches the scan
    want = {r.job_id for r in current_postings(X.postings_b(spark, SF), X.overrides_l(spark, SF), ordered=False)
            .where((F.col("date_scraped") >= F.lit("2024-01-20").cast("date")) & (F.col("score") >= 50)).collect()}
    assert {r.job_id for r in q.collect()} == want


def test_store_keys_narrowed_before_anti_join(spark):
    """The growing store is semi-joined with the batch keys before the anti join, so a load
    never shuffles the whole store's key column."""
    from postkit.operators.warehouse import new_rows, normalise_rows
    path = scratch_path(spark, "wh-anti")
    b = X.postings_b(spark, SF).drop("loaded_at")
    load_new(spark, b.where(F.col("score") < 40), path, X.LOADED_AT)
    good, _ = normalise_rows(b, X.LOADED_AT)
    def anti_right_sides(node):
        if node.nodeName() == "Join" and node.joinType().toString() == "LeftAnti":
            yield node.right().toString()
        kids = node.children()
        for i in range(kids.size()):
            yield from anti_right_sides(kids.apply(i))

    rights = list(anti_right_sides(new_rows(spark, good, path)._jdf.queryExecution().optimizedPlan()))
    assert rights and all("LeftSemi" in r for r in rights)   # the store side is narrowed first


@pytest.mark.parametrize("name,most", [("dedup_first", 1), ("ingest_counters", 1), ("insert_new", 4), ("score_bands", 2)])
def test_scans(spark, name, most):
    """First-wins and counters read their table once, bands the view once (postings and log); an
    insert reads batch and store twice each: their rows and their keys."""
    assert _plan(queries()[name](spark, SF)).count("FileScan parquet") <= most


def test_ingest_parses_each_payload_once(spark):
    from postkit.operators.ingest import extract_all, merge_into_store
    extracted = extract_all(spark, X.landed_all(spark, SF), X.specs_all(spark, SF), scraped_at=F.lit("2024-01-01"))
    new, counters = merge_into_store(extracted.select("job_id").limit(0), extracted)
    for df in (new, counters):
        plan = _plan(df)
        assert "MapInPandas" not in plan and "MapInArrow" not in plan
