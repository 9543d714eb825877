"""Sliced plans must equal plain ones, also when one key holds most rows or values tie."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import evaluate as E
from strandmill.operators import splits as P
from strandmill.operators.ranking import exact_quantiles, global_rank, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = 0 if i % 3 else rng.randrange(40)
        rows.append((i, key, rng.randrange(60), rng.randrange(5)))
    return spark.createDataFrame(rows, "id long, key long, v long, w long").cache()


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_running_totals_sliced_equals_plain(skewed, keys):
    order = [F.col("v"), F.col("id")]
    plain = running_totals(skewed, keys, order, {"s": F.col("w"), "n": F.lit(1)})
    sliced = running_totals(skewed, keys, order, {"s": F.col("w"), "n": F.lit(1)}, task_rows=100)
    assert sorted(map(tuple, plain.select("id", "s", "n").collect())) == sorted(
        map(tuple, sliced.select("id", "s", "n").collect()))


def test_sliced_plan_orders_no_whole_group(skewed):
    out = running_totals(skewed, ["key"], [F.col("v"), F.col("id")], {"n": F.lit(1)}, task_rows=100)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in text and "CartesianProduct" not in text


def test_rank_descending_slices(skewed):
    order = [F.desc("v"), F.asc("id")]
    a = global_rank(skewed, order, "r")
    b = global_rank(skewed, order, "r", task_rows=50)
    assert sorted(map(tuple, a.select("id", "r").collect())) == sorted(map(tuple, b.select("id", "r").collect()))


@pytest.fixture(scope="module")
def awkward(spark):
    """Null keys, null, NaN and infinite values, and one value that half of all rows hold."""
    rows = []
    for i in range(1000):
        v = [None, float("nan"), float("inf"), 1.0, 1.0, 1.0, float(i % 7), -0.0, 0.0, 1.0][i % 10]
        rows.append((i, None if i % 4 == 0 else i % 3, v, None if i % 5 == 0 else i % 2))
    return spark.createDataFrame(rows, "id long, key long, v double, w long").cache()


@pytest.mark.parametrize("keys", [[], ["key"], ["v"]])
@pytest.mark.parametrize("falling", [False, True])
def test_both_plans_agree_on_nulls_nan_and_hot_values(awkward, keys, falling):
    order = [F.desc("v") if falling else F.col("v"), F.col("id")]
    totals = {"s": F.col("w"), "r": F.lit(1)}
    plain, sliced = (
        sorted(map(tuple, running_totals(awkward, keys, order, totals, task_rows=t).select("id", "s", "r").collect()))
        for t in (10**6, 50))
    assert len(plain) == 1000 and plain == sliced


def test_no_task_orders_a_hot_value(awkward):
    from strandmill.operators.ranking import _sliced

    sizes = _sliced(awkward, [], [F.col("v"), F.col("id")], 20).groupBy("_slice").count().agg(F.max("count")).first()
    assert sizes[0] <= 150


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_quantiles_agree_on_nulls_nan_and_hot_values(awkward, keys):
    probs = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 0.83, "e": 1.0}
    plain, sliced = (sorted(map(str, exact_quantiles(awkward, keys, "v", probs, t).collect())) for t in (10**6, 3))
    assert plain == sliced and len(plain) == (4 if keys else 1)


def test_reports_agree_on_nulls_and_nan(awkward):
    df = awkward.select(F.col("id").alias("sample_id"), "key", F.col("v").alias("logit"), (F.col("id") % 2).alias("label"))
    both = [(E.group_auc(df, "key", task_rows=t).first(), P.top_fraction_flags(df, "logit", "sample_id", {"tenth": 10}, t).where(
        "tenth").agg(F.count("*"), F.sum("sample_id")).first(), P.class_capped(df, "key", {1: 20}, 3, ["sample_id"], t).count())
        for t in (10**6, 50)]
    assert both[0][0]["gauc"] == pytest.approx(both[1][0]["gauc"]) and both[0][0]["coverage"] == both[1][0]["coverage"]
    assert both[0][1:] == both[1][1:]


@pytest.mark.parametrize("task_rows", [10**6, 64])
def test_exact_quantiles_match_numpy(skewed, task_rows):
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["key"]: r for r in exact_quantiles(skewed, ["key"], "v", probs, task_rows).collect()}
    rows = skewed.select("key", "v").toPandas()
    for key, part in rows.groupby("key"):
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(part["v"], p))
    whole = exact_quantiles(skewed, [], "v", probs, task_rows).first()
    assert whole["d"] == pytest.approx(np.quantile(rows["v"], 0.9))


@pytest.mark.parametrize("task_rows", [10**6, 40])
def test_auc_counts_ties_by_half(spark, skewed, task_rows):
    df = skewed.select(F.col("id").alias("sample_id"), "key", F.col("v").cast("double").alias("prob"),
                       ((F.col("v") * 7 + F.col("id")) % 3 == 0).cast("long").alias("label"))
    pdf = df.toPandas()

    def brute(p):
        pos, neg = p[p.label == 1].prob.to_numpy(), p[p.label == 0].prob.to_numpy()
        if not len(pos) or not len(neg):
            return None
        d = pos[:, None] - neg[None, :]
        return float(((d > 0) + 0.5 * (d == 0)).mean())

    assert E.roc_auc(df, task_rows=task_rows).first()["auc"] == pytest.approx(brute(pdf))
    got = {r["key"]: r["auc"] for r in E.auc_by(df, ["key"], task_rows=task_rows).collect()}
    for key, part in pdf.groupby("key"):
        want = brute(part)
        assert (got[key] is None) if want is None else got[key] == pytest.approx(want)
    stretched = df.withColumn("prob", F.exp(F.col("prob") / 10))
    assert E.roc_auc(stretched).first()["auc"] == pytest.approx(brute(pdf))


def test_one_class_auc_is_half(spark):
    df = spark.createDataFrame([(0.1, 1), (0.4, 1)], "prob double, label long")
    assert E.roc_auc(df).first()["auc"] == 0.5


def test_exact_samples(skewed):
    a = P.exact_sample(skewed, 500, 7, ["id"])
    b = P.exact_sample(skewed.repartition(7), 500, 7, ["id"], task_rows=100)
    ids = {r["id"] for r in a.collect()}
    assert len(ids) == 500 and ids == {r["id"] for r in b.collect()}
    assert P.ratio_sample(skewed, 0.0, 1, ["id"]).count() == 0
    assert P.ratio_sample(skewed, 0.0001, 1, ["id"]).count() == 1
    res = {r["id"] for r in P.reservoir(skewed, 100, 7, ["id"]).collect()}
    assert len(res) == 100 and res <= ids


def test_split_is_a_partition(skewed):
    df = P.time_split(skewed, "v", 0.25)
    vals = np.array([r["v"] for r in skewed.select("v").collect()])
    assert df.where("is_valid").count() == int((vals >= int(np.quantile(vals, 0.75))).sum())
    both = P.set_overlap(df.where("is_valid"), df.where("not is_valid"), "id").first()
    assert both["n_both"] == 0 and both["n_union"] == 3000


def test_inversions_match_brute_force(skewed):
    df = skewed.select(F.col("id").alias("sample_id"), F.col("v").cast("double").alias("logit"),
                       (F.col("w") == 0).cast("long").alias("label"))
    p = df.toPandas()
    pos, neg = p[p.label == 1].logit.to_numpy(), p[p.label == 0].logit.to_numpy()
    per_neg = (pos[None, :] <= neg[:, None]).sum(axis=1)
    for task_rows in (10**6, 20):
        got = E.rank_inversions(df, task_rows=task_rows).first()
        assert got["inv_total"] == per_neg.sum() and got["pair_n"] == len(pos) * len(neg)
        top = per_neg[np.argsort(-neg, kind="stable")][: max(1, round(len(neg) * 0.05))].sum()
        assert got["inv_top5neg_frac"] == pytest.approx(top / per_neg.sum())
    inv = E.inversions(df, task_rows=20).agg(F.sum("inv")).first()[0]
    assert inv == per_neg.sum()
