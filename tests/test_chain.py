"""The configured chain: nothing is shuffled, sought or made twice, and its shortcuts change no value."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandmill.operators import sequence_rows as R
from strandmill.operators import sequences as Q
from strandmill.operators.history import attach_histories
from strandmill.plans import catalog
from strandmill.plans.adapters import DOMAINS
from strandmill.plans.base import samples
from strandmill.plans.blocks import FeatureChain
from strandmill.plans.running import CHAIN

EVENTS = "array<struct<ts:bigint,action:bigint,item:bigint,category:bigint>>"


def optimized(df):
    """The plan above the sample table, with all its fields."""
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    return re.split("InMemoryRelation", df._jdf.queryExecution().optimizedPlan().toString())[0]


@pytest.fixture(scope="module")
def sequences(spark):
    draw, rows = random.Random(5), []
    for i in range(240):
        times = [draw.choice([None] * (i % 7 == 0) + list(range(1, draw.choice([4, 11, 900])))) for _ in range(draw.choice([0, 1, 3, 8, 9, 12, 40]))]
        rows.append((i, [(t, draw.randint(1, 3), draw.choice([None, 1, 2, 3, 4]), draw.choice([None, 1, 2, 3])) for t in times], f"x{i}"))
    return spark.createDataFrame(rows, f"sample_id long, q {EVENTS}, other string").cache()


@pytest.mark.parametrize(("group", "cap", "keep"), [(["category"], 8, 0), (["category", "action"], 8, 3), (["item"], 5, 5), (["action"], 1, 0)])
def test_budget_inside_the_row_equals_the_row_operator(sequences, group, cap, keep):
    by_rows = R.rewrite_domain(sequences, "q", lambda rows, key: R.budget_compress(rows, group, "item", cap, keep, key=key))
    inside = Q.compress_budget(sequences, "q", group, "item", cap, keep)
    want, got = ({r.sample_id: r for r in df.select("sample_id", "q", "other").collect()} for df in (by_rows, inside))
    assert got == want and len(got) == 240
    assert "Exchange" not in inside._jdf.queryExecution().executedPlan().toString()


def test_chain_keeps_samples_where_they_lie(spark, tiny):
    df = samples(spark, tiny).drop(*[f"{d}_raw_len" for d in DOMAINS])
    chain = FeatureChain({"time_bucket": {"domains": DOMAINS}, "seq_compress": CHAIN["seq_compress"], "seq_truncate": CHAIN["seq_truncate"]})
    text = chain.transform(df, {})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in re.split("InMemoryRelation", text)[0]


def test_time_fields_are_the_same_wherever_they_are_added(spark, tiny):
    df = samples(spark, tiny).drop(*[f"{d}_raw_len" for d in DOMAINS]).limit(40)
    config = {k: CHAIN[k] for k in ("time_bucket", "seq_hour", "seq_weekday", "dense_seq_stats", "seq_compress", "seq_truncate", "seq_session_state")}
    chain = FeatureChain(config)
    one_by_one = df
    for b in chain.blocks:
        one_by_one = b.transform(one_by_one, {})
    together = chain.transform(df, {})
    assert together.schema == one_by_one.schema
    assert together.orderBy("sample_id").collect() == one_by_one.orderBy("sample_id").collect()


def test_chain_events_make_their_own_column_only_and_once(spark, tiny):
    text = optimized(catalog.QUERIES["u2_chain_events"](spark, tiny))
    assert not re.search("seq_[abd]#", text) and "conv_state" not in text
    assert text.count("sort_array") == 1  # the truncation; a filter for empty arrays would repeat it


def test_feature_chain_seeks_matches_once_and_makes_no_unread_field(spark, tiny):
    text = optimized(catalog.QUERIES["u2_feature_chain"](spark, tiny))
    assert text.count(".campaign = ") == 1
    assert "sort_array" not in text and "Aggregate" not in text


def test_history_over_many_impressions_between_events(spark):
    ev = spark.createDataFrame([(i, 1, "xy"[i % 2], 10 * i) for i in range(40)], "event_id long, user_id long, domain string, ts long")
    im = spark.createDataFrame([(100 + t, 1, t) for t in range(0, 420, 3)], "sample_id long, user_id long, ts long")
    out = attach_histories(im, ev, ["user_id"], ["x", "y"], ["event_id"], 7, F.col("event_id"))
    for r in out.collect():
        for j, d in enumerate("xy"):
            seen = [i for i in range(j, 40, 2) if 10 * i < r.ts]
            assert ([e.event_id for e in r[d]], r[f"{d}_raw_len"]) == (seen[-7:], len(seen))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan  # the window already holds the events in order
