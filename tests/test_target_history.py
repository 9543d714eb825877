"""Target features, windowed distinct counts, first-seen maps and early stopping over whole logs, against brute force.

One user holds most of the log (far over 500 events), and small tasks force the sliced way.
"""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators.health import early_stop
from strandmill.operators.ranking import running_totals
from strandmill.operators.target_history import distinct_in_window, first_seen_from_log, target_history
from strandmill.plans import catalog

DOMAINS = ["x", "y"]


@pytest.fixture(scope="module")
def log(spark):
    r = random.Random(3)
    events = [(i, 1 if i % 3 else r.choice([2, 3, None]), r.choice(DOMAINS), r.randrange(400) if i % 50 else None, r.randrange(-1, 12), r.randrange(5), r.randrange(0, 3)) for i in range(1200)]
    imps = [(5000 + i, 1 if i % 3 else r.choice([2, 3, 4, None]), r.randrange(420), r.randrange(-1, 13), r.randrange(6)) for i in range(250)]
    ev = spark.createDataFrame(events, "event_id long, user_id long, domain string, ts long, item long, brand long, action long")
    im = spark.createDataFrame(imps, "sample_id long, user_id long, ts long, item_id long, brand_id long")
    return events, imps, ev, im


@pytest.mark.parametrize("task_rows", [10**6, 70])
def test_target_history(log, task_rows):
    events, imps, ev, im = log
    got = {(r.sample_id, r.kind): r for r in target_history(
        im, ev, ["user_id"], {"item": ("item", "item_id"), "brand": ("brand", "brand_id")}, {"now": F.col("ts"), "old": F.col("ts") - 40},
        DOMAINS, "event_id", ["action"], task_rows).collect()}
    assert set(got) == {(s, k) for s, u, _, i, b in imps if u is not None for k, v in (("item", i), ("brand", b)) if v > 0}
    for s, user, ts, item, brand in imps:
        for kind, at, target in (("item", 4, item), ("brand", 5, brand)):
            if user is None or target <= 0:
                continue
            for d in DOMAINS:
                past = sorted((e[3], e[0], e[6]) for e in events if e[1] == user and e[2] == d and e[3] is not None and e[3] < ts and e[at] == target)
                row = got[s, kind]
                assert row[f"now_{d}"] == len(past) and row[f"now_{d}"] - row[f"old_{d}"] == sum(t >= ts - 40 for t, *_ in past)
                assert row[f"first_{d}"] == (past[0][0] if past else None)
                assert (row[f"last_{d}"] and (row[f"last_{d}"].ts, row[f"last_{d}"].tie, row[f"last_{d}"].action)) == (past[-1] if past else None)


@pytest.mark.parametrize("task_rows", [10**6, 70])
@pytest.mark.parametrize("window", [0, 7, 60, 1000])
def test_distinct_in_window(log, window, task_rows):
    events, imps, ev, im = log
    got = {r.sample_id: r.n_distinct for r in distinct_in_window(im, ev, ["user_id"], "item", window, task_rows).collect()}
    assert got == {s: len({e[4] for e in events if e[1] == user and e[3] is not None and ts - window <= e[3] < ts}) for s, user, ts, *_ in imps if user is not None}


@pytest.mark.parametrize("task_rows", [10**6, 70])
def test_first_seen_from_log(log, task_rows):
    events, imps, ev, im = log
    got = {r.item: (r.brand, r.action) for r in first_seen_from_log(im, ev, ["user_id"], "item", ["brand", "action"], "sample_id", "event_id", task_rows).collect()}
    want = {}
    for s, user, ts, *_ in sorted(imps):
        for e in sorted((e for e in events if user is not None and e[1] == user and e[3] is not None and e[3] < ts and e[4] > 0), key=lambda e: (e[3], e[0])):
            was = want.setdefault(e[4], [None, None])
            for k, v in ((0, e[5]), (1, e[6])):
                if was[k] is None and v > 0:
                    was[k] = v
    assert got == {k: tuple(v) for k, v in want.items() if any(v)}


def test_empty_logs(log):
    _, _, ev, im = log
    assert distinct_in_window(im, ev.limit(0), ["user_id"], "item", 5).where("n_distinct != 0").count() == 0
    assert target_history(im.limit(0), ev, ["user_id"], {"item": ("item", "item_id")}, {"now": F.col("ts")}, DOMAINS, "event_id").count() == 0


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_peaks(spark, inclusive):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", None]), i, r.choice([None, r.randrange(50)])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for task_rows in (10**6, 40):
        out = running_totals(df, ["k"], [F.col("i")], {"s": F.col("v")}, task_rows, peaks={"m": F.col("v")}, inclusive=inclusive).collect()
        for x in out:
            known = [v for k, i, v in rows if k == x.k and v is not None and (i <= x.i if inclusive else i < x.i)]
            assert (x.m, x.s) == ((max(known), sum(known)) if known else (None, None))


def fold(values, patience, delta):
    best, n, stop = None, 0, False
    for v in values:
        if v is not None and not math.isnan(v) and (best is None or v > best + delta):
            best, n = v, 0
        elif best is not None:
            n += 1
            stop = stop or n >= patience
    return best, n, stop


@pytest.mark.parametrize("task_rows", [10**6, 50])
@pytest.mark.parametrize("delta", [0.0, 0.5, 3.0])
def test_early_stop_equals_a_fold(spark, delta, task_rows):
    r = random.Random(4)
    series = {"up": [i / 4 for i in range(300)], "down": [-float(i) for i in range(30)], "one": [2.0], "none": [None, None], "nan": [float("nan"), 1.0, 5.0, None, 5.5],
              None: [r.random() * i for i in range(40)], "walk": [r.gauss(0, 1) + i / 50 for i in range(700)]}
    rows = [(k, i, v) for k, values in series.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, step int, auc double").repartition(3)
    got = {x.k: (x.best, x.plateau, x.stopped) for x in early_stop(df, ["k"], "step", "auc", 6, delta, task_rows).collect()}
    assert got == {k: fold(v, 6, delta) for k, v in series.items()}
    assert early_stop(df.limit(0), ["k"], "step", "auc", 6, delta).count() == 0


def test_first_seen_of_orders_moves_slim_lines(spark, tiny):
    plan = catalog.QUERIES["a4_first_seen_mapping"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and plan.count("Exchange hashpartitioning") <= 6
