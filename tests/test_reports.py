"""Losses, vectors and importance against numpy; plan checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import evaluate as E
from strandmill.operators import fit as fits
from strandmill.operators import health as H
from strandmill.operators import losses as LS
from strandmill.operators import vectors as V
from strandmill.operators.importance import RunningMean, coalition_values, exact_importance, group_importance
from strandmill.plans.evaluation import second_view


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(4)
    z = np.round(rng.normal(size=400), 1)
    y = (rng.random(400) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(z, y))], "sample_id long, logit double, label long")
    df = df.withColumns({"prob": 1 / (1 + F.exp(-F.col("logit"))), "loss": LS.bce(F.col("logit"), F.col("label"))})
    return z, y, df.cache()


def bce(z, y):
    return np.logaddexp(0, z) - z * y


@pytest.mark.parametrize("task_rows", [10**6, 30])
def test_hard_example_loss_keeps_ties(preds, task_rows):
    z, y, df = preds
    loss = bce(z, y)
    neg = np.sort(loss[y == 0])[::-1]
    cut = neg[max(1, int(len(neg) * 0.7)) - 1]
    keep = (y == 1) | (loss >= cut - 1e-12)
    got = LS.hard_example_loss(df, task_rows=task_rows).first()
    assert got["n_kept"] == keep.sum() and got["ohem"] == pytest.approx(loss[keep].mean())


def test_harmonised_loss(preds):
    z, y, df = preds
    p = 1 / (1 + np.exp(-z))
    bins = np.minimum((np.abs(p - y) * 10).astype(int), 9)
    counts = np.bincount(bins, minlength=10)
    want = (len(z) / counts[bins] * bce(z, y)).sum() / len(z)
    assert LS.harmonised_loss(df).first()["ghm"] == pytest.approx(want)


def test_frontier_loss(preds):
    z, y, df = preds
    pos, neg = z[y == 1], np.sort(z[y == 0])[::-1]
    top = neg[: min(16, max(1, round(0.2 * len(neg))))]
    m = pos[:, None] - top[None, :]
    w = 1 / (1 + np.exp(m / 0.5))
    pair = ((w / (w.sum(1, keepdims=True) + 1e-8)) * np.logaddexp(0, -m)).sum(1).mean()
    got = LS.frontier_loss(df, top_k=16).first()
    assert got["pairwise"] == pytest.approx(pair)
    with pytest.raises(ValueError, match="top_k"):
        LS.frontier_loss(df, top_k=0)


def test_one_class_frontier(spark):
    df = spark.createDataFrame([(0.3, 1), (0.2, 1)], "logit double, label long")
    assert LS.frontier_loss(df).first()["pairwise"] == 0


def test_gini_with_unhit_ids(spark):
    counts = {1: 5, 2: 1, 4: 9, 7: 1}
    rows = [("f", i) for i, c in counts.items() for _ in range(c)]
    df = spark.createDataFrame(rows, "feature string, value long")
    full = np.sort([counts.get(i, 0) for i in range(1, 10)])
    n = len(full)
    want = 2 * (np.arange(1, n + 1) * full).sum() / (n * full.sum()) - (n + 1) / n
    for task_rows in (10**6, 1):
        got = H.id_utilisation(df, {"f": 10}, task_rows=task_rows).first()
        assert got["gini"] == pytest.approx(want) and got["hit"] == 4 and got["max"] == 9


def test_id_utilisation_counts_the_vocabulary_alone(spark):
    df = spark.createDataFrame([("f", v) for v in [0, 1, 1, 3, 10, 11, 11, 11]], "feature string, value long")
    for task_rows in (10**6, 1):
        got = {r["feature"]: r for r in H.id_utilisation(df, {"f": 10, "none": 4}, task_rows=task_rows).collect()}
        assert (got["f"]["total"], got["f"]["hit"], got["f"]["max"], got["f"]["p95"]) == (9, 2, 2, 1)
        assert (got["none"]["total"], got["none"]["hit"], got["none"]["max"], got["none"]["p25"]) == (3, 0, 0, None)


def test_losses_are_rounded_as_sql_rounds_them(spark):
    rows = spark.range(4000).select(
        (F.col("id") / 1000.0 - 2.0).alias("logit"), (F.col("id") % 2).alias("label"), (F.col("id") % 9).alias("item_id"))
    got = second_view(rows).collect()
    assert [r["loss_b"] for r in got] == [
        max(r["logit_b"], 0.0) + math.log(1.0 + math.exp(-abs(r["logit_b"]))) - r["logit_b"] * r["label"] for r in got]


def test_robust_scaler_fallbacks(spark):
    rows = [([float(i), 3.0, 1.0 if i == 0 else 0.0],) for i in range(20)]
    df = spark.createDataFrame(rows, "v array<double>")
    for task_rows in (10**6, 4):
        got = {r["dim"]: r for r in fits.robust_scaler_fit(df, "v", 3, task_rows=task_rows).collect()}
        assert got[0]["scale"] == pytest.approx(9.5) and got[0]["median"] == pytest.approx(9.5)
        assert got[1]["scale"] == 1.0          # constant
        assert got[2]["scale"] == 0.5          # no spread between the quartiles: half the range
    approx = {r["dim"]: r for r in fits.robust_scaler_fit(df, "v", 3, approx=True).collect()}
    assert approx[1]["scale"] == 1.0 and abs(approx[0]["median"] - 9.5) <= 1


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) + 2.0
    df = spark.createDataFrame([(i, [float(v) for v in r], int(i % 2)) for i, r in enumerate(x)], "id long, v array<double>, y int")
    return x, df.cache()


def test_pca_matches_svd(vectors):
    x, df = vectors
    state = V.pca_fit(df, "v", 3)
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for mine, ref in zip(state["components"], vt[:3]):
        assert abs(abs(np.dot(mine, ref)) - 1) < 1e-6
    got = np.array([r["p"] for r in df.orderBy("id").select(V.pca_project(F.col("v"), state, 3).alias("p")).collect()])
    assert np.allclose(got, (x - x.mean(0)) @ np.array(state["components"]).T)
    assert df.select(V.pca_project(F.col("v"), None, 3).alias("p")).first()["p"] == [0.0, 0.0, 0.0]


def test_spectral_rank_matches_svd(vectors):
    x, df = vectors
    s = np.linalg.svd(x, compute_uv=False)
    p = s / s.sum()
    got = V.spectral_rank(df, "v")
    assert got["effective_rank"] == pytest.approx(math.exp(-(p * np.log(p)).sum()), rel=1e-6)
    assert got["information_abundance"] == pytest.approx(s.sum() / s.max(), rel=1e-6)


def test_mutual_information_limits():
    mi, ami = V.mutual_information(np.array([[50, 0], [0, 50]]))
    assert mi == pytest.approx(math.log(2)) and ami == pytest.approx(1.0)
    mi, ami = V.mutual_information(np.array([[25, 25], [25, 25]]))
    assert mi == pytest.approx(0.0, abs=1e-12) and abs(ami) < 0.02


def test_expected_information_against_factorials():
    lg = math.lgamma
    for a, b in (([3, 7, 10], [5, 15]), ([1, 1, 98], [50, 50]), ([40, 60], [1, 99]), ([200, 300, 500], [10, 990])):
        n, want = sum(a), 0.0
        for x in a:
            for y in b:
                for k in range(max(1, x + y - n), min(x, y) + 1):
                    p = math.exp(lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1)
                                 - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1))
                    want += k / n * math.log(n * k / (x * y)) * p
        assert V.expected_information(np.array(a), np.array(b)) == pytest.approx(want, rel=1e-9)


def test_expected_information_of_large_counts():
    # Independent tables: (rows - 1) (columns - 1) / 2n in the limit.
    a, b = np.array([4 * 10**9, 6 * 10**9]), np.array([2 * 10**9, 3 * 10**9, 5 * 10**9])
    assert V.expected_information(a, b) == pytest.approx(2 / (2 * 10**10), rel=1e-3)


def test_importance_of_masked_groups(preds):
    _, _, df = preds
    rows = df.select("sample_id", "label", F.col("logit").alias("x"), (F.col("sample_id") % 2).alias("y"), (F.col("sample_id") % 7).alias("w"))
    rows = rows.unionByName(rows.limit(1).withColumn("label", F.lit(None).cast(rows.schema["label"].dataType)))
    groups = {"signal": ["x"], "noise": ["y"], "more": ["w"]}

    def scorer(d):
        return d.withColumn("logit", F.col("x") + 0.01 * F.col("y") * F.col("w"))

    exact = {r["group"]: r for r in exact_importance(rows, groups, scorer).collect()}
    got = {r["group"]: r for r in group_importance(rows, groups, scorer, permutations=200, threshold=0.0).collect()}
    ends = {r["coalition"]: r for r in coalition_values(rows, groups, scorer, [0, 7], task_rows=8).collect()}
    assert ends[0]["n"] == rows.where("label is not null").count() and ends[0]["auc"] == 0.5
    for name, kind, sign in (("loss", "loss_value", -1), ("auc", "auc_value", 1)):
        assert sum(r[kind] for r in exact.values()) == pytest.approx(sign * (ends[7][name] - ends[0][name]), abs=1e-9)
        for g in groups:
            assert got[g][kind] == pytest.approx(exact[g][kind], abs=5 * got[g][kind.replace("value", "se")] + 1e-9)
    assert exact["signal"]["auc_value"] > 0.1 > abs(exact["noise"]["auc_value"])
    assert {r["n_permutations"] for r in got.values()} == {200}
    assert group_importance(rows.where("false"), groups, scorer, permutations=10).collect() == []


def test_running_means_merge():
    xs = [0.5, 2.0, -1.0, 4.0, 4.0, 0.25]
    whole, left, right = (RunningMean() for _ in range(3))
    for i, x in enumerate(xs):
        whole.add(x)
        (left if i < 2 else right).add(x)
    left.merge(right)
    assert (left.n, left.mean, left.error) == pytest.approx((6, np.mean(xs), np.std(xs, ddof=1) / math.sqrt(6)))
    assert (whole.mean, whole.error) == pytest.approx((left.mean, left.error))


def test_hub_churn_over_steps(spark):
    rows = [(s, i, 0, float((i * (3 + 2 * s)) % 11) + i / 100) for s in (1, 4, 6) for i in range(40)] + [(s, 100 + s, 1, 5.0) for s in (1, 4, 6)]
    df = spark.createDataFrame(rows, "step long, sample_id long, label long, logit double")
    tops = {s: {i for _, i in sorted(((-z, i) for t, i, y, z in rows if t == s and y == 0))[:4]} for s in (1, 4, 6)}
    for task_rows in (10**6, 16):
        hubs = E.hub_negatives(df, ["step"], share=0.1, task_rows=task_rows)
        got = {r["step"]: (r["hub_jaccard"], r["hub_entry_rate"]) for r in E.successive_churn(hubs, "step", "hub").collect()}
        assert got == {b: (len(tops[a] & tops[b]) / len(tops[a] | tops[b]), len(tops[b] - tops[a]) / 4) for a, b in ((1, 4), (4, 6))}
    assert E.hub_negatives(df.where("step = 1"), share=0.001).count() == 1


def test_early_stop_counts_from_the_best(spark):
    rows = [("a", i, v) for i, v in enumerate([0.5, 0.52, 0.53, 0.60, 0.61])]
    df = spark.createDataFrame(rows, "k string, step int, auc double")
    got = H.early_stop(df, ["k"], "step", "auc", 2, 0.05).first()
    assert got["best"] == pytest.approx(0.60) and got["plateau"] == 1 and got["stopped"]


def test_calibration_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0, 0), (0.5, 1), (1.0, 1), (1.2, 1)], "prob double, label long")
    got = {r["bin"]: r["n"] for r in E.binned_calibration(df, [0.0, 0.5, 1.0]).collect()}
    assert got == {0: 1, 1: 2}
