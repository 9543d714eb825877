"""Histories and as-of counts against brute force, with one user holding most of the log."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import sequence_rows as R
from strandmill.operators.history import attach_histories, counts_as_of
from strandmill.plans import catalog
from strandmill.plans.evaluation import with_lengths

DOMAINS = ["x", "y"]


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(11)
    events, imps = [], []
    for i in range(700):
        user = 1 if i % 3 else rng.randrange(2, 12)
        events.append((i, user, rng.choice(DOMAINS), rng.randrange(0, 120), rng.randrange(9)))
    for i in range(300):
        user = 1 if i % 3 else rng.randrange(2, 14)
        imps.append((1000 + i, user, rng.randrange(0, 130)))
    ev = spark.createDataFrame(events, "event_id long, user_id long, domain string, ts long, item long")
    im = spark.createDataFrame(imps, "sample_id long, user_id long, ts long")
    return events, imps, ev, im


def before(events, user, domain, ts):
    rows = [e for e in events if e[1] == user and e[2] == domain and e[3] < ts]
    return sorted(rows, key=lambda e: (e[3], e[0]))


@pytest.mark.parametrize("task_rows", [10**6, 60])
@pytest.mark.parametrize("ceiling", [1, 4, 50])
def test_histories(log, ceiling, task_rows):
    events, imps, ev, im = log
    out = attach_histories(im, ev, ["user_id"], DOMAINS, ["ts", "item", "event_id"], ceiling, F.col("event_id"), task_rows=task_rows)
    got = {r["sample_id"]: r for r in out.collect()}
    assert len(got) == len(imps)
    for sid, user, ts in imps:
        for d in DOMAINS:
            want = before(events, user, d, ts)
            assert got[sid][f"{d}_raw_len"] == len(want)
            assert [e["event_id"] for e in got[sid][d]] == [e[0] for e in want[-ceiling:]]


@pytest.mark.parametrize("task_rows", [10**6, 60])
def test_counts_as_of(log, task_rows):
    events, imps, ev, im = log
    out = counts_as_of(im, ev, ["user_id"], {"now": F.col("ts"), "old": F.col("ts") - 30}, DOMAINS, task_rows)
    for r in out.collect():
        sid, user, ts = next(i for i in imps if i[0] == r["sample_id"])
        for d in DOMAINS:
            rows = before(events, user, d, ts)
            assert r[f"now_{d}"] == len(rows)
            assert r[f"now_{d}"] - r[f"old_{d}"] == sum(e[3] >= ts - 30 for e in rows)


def test_no_pair_join(log):
    _, _, ev, im = log
    out = attach_histories(im, ev, ["user_id"], DOMAINS, ["ts", "item"], 4, F.col("event_id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange ")


def test_histories_are_made_where_the_log_lies(log):
    _, _, ev, im = log
    two = attach_histories(im, ev, ["user_id"], DOMAINS, ["ts", "item"], 4, F.col("event_id"), {"day": F.col("ts") + 9})
    assert exchanges(two) == 1
    one = attach_histories(im, ev, ["user_id"], ["x"], ["ts", "item"], 4, F.col("event_id"), sizes=(1000, 1000))
    key = ("user_id", "sample_id")
    cut = R.budget_compress(R.explode_events(one, "x", key), ["item"], "item", 3, 1, key=key)
    pooled = R.recency_pool(one, "x", ["item"], 2, 2, key=key)
    assert [exchanges(df) for df in (one, cut, pooled)] == [1, 1, 1]
    assert max(len(r.x) for r in one.collect()) == 4


@pytest.mark.parametrize("task_rows", [10**6, 60])
def test_null_keys_and_times_meet_nothing(spark, task_rows):
    ev = spark.createDataFrame([(1, None, "x", 5), (2, 7, "x", None), (3, 7, "x", 4)], "event_id long, user_id long, domain string, ts long")
    im = spark.createDataFrame([(10, None, 9), (11, 7, 9), (12, 8, 9)], "sample_id long, user_id long, ts long")
    out = attach_histories(im, ev, ["user_id"], ["x"], ["event_id"], 4, F.col("event_id"), task_rows=task_rows)
    assert {r.sample_id: (r.x_raw_len, [e.event_id for e in r.x]) for r in out.collect()} == {10: (0, []), 11: (1, [3]), 12: (0, [])}


def test_report_lengths_count_the_whole_log(spark, tmp_path):
    rows = [(i, 1, "click", i) for i in range(150)] + [(200, 1, "error", 7), (300, 1, "view", 200), (301, 2, "view", 5), (302, 1, "view", 80)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, second long").selectExpr(
        "event_id", "user_id", "event_type", "cast(10.0 as double) as value", "'{\"k\": 3}' as props",
        "cast(timestamp_seconds(1704067200 + second) as timestamp_ntz) as ts").write.parquet(str(tmp_path / "events.parquet"))
    cols = ["seq_a_len", "seq_a_raw_len", "seq_d_len", "seq_d_raw_len"]
    got = {r.sample_id: tuple(r[c] for c in cols) for r in with_lengths(spark, str(tmp_path)).collect()}
    assert got == {300: (5, 150, 1, 1), 301: (0, 0, 0, 0), 302: (5, 80, 1, 1)}
    report = {r.domain: r.asDict() for r in catalog.QUERIES["e22_sequence_lengths"](spark, str(tmp_path)).collect()}
    assert 150 in report["seq_a"].values()
