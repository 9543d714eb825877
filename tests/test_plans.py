"""The apply path must stay free of pair joins and of whole-table ordering."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandmill.operators import sequence_rows as R
from strandmill.operators.ranking import global_rank
from strandmill.plans import base

QUERIES = entry.queries()
ROW_LOCAL = ["q3_dense_seq_stats", "q4_time_buckets", "q9_time_categories", "q15_conversion_counts", "q16_conversion_state",
             "q17_temporal_velocity", "j2_target_in_history", "p15_random_mask", "q26_category_overlap"]


def plan_of(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.split(r"InMemoryRelation", text)[0]


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_row_local_queries_do_not_shuffle(spark, tiny, name):
    text = plan_of(QUERIES[name](spark, tiny))
    assert "Exchange" not in text and "Join" not in text and "Python" not in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_joins(spark, tiny, name):
    if name.startswith(("t", "e19", "e33", "u")):
        pytest.skip("runs jobs of its own")
    text = plan_of(QUERIES[name](spark, tiny))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_ranked_scan_is_pruned(spark, tiny):
    columns = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    df = spark.read.parquet(f"{tiny}/lineitem.parquet")
    out = global_rank(df, [F.col(c) for c in columns], "rank").select(*columns, "rank")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.search(r"ReadSchema: struct<([^>]*)>", text).group(1).split(",")) == 3


def test_dealt_rows_hold_only_what_is_asked(spark, tiny):
    # The scan lies behind the written rows: five columns, what is summed, the slice.
    text = QUERIES["g0_global_rank"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert len(re.search(r"Scan ExistingRDD\[([^\]]*)\]", text).group(1).split(",")) == 7


def test_session_rows_share_one_exchange(spark, tiny):
    df = base.samples(spark, tiny).repartition(4, "sample_id")
    rows = R.explode_events(df, "seq_a").withColumn("time_bucket", F.lit(3))
    text = plan_of(R.session_state(rows, category="category"))
    assert text.count("Exchange hashpartitioning") == 1
