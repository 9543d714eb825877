"""Rates, weights and the cut of the toxicity operator against brute force."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandmill.llm import toxicity as X
from strandmill.llm.texts import utf8

WORDS = "amber birch cedar delta ember fjord grove hazel inlet jetty kelp larch".split()


def texts_of(n: int, copies: int) -> list[str | None]:
    draw = np.random.default_rng(5)
    out: list[str | None] = [" ".join(draw.choice(WORDS, 30)) for _ in range(n)]
    return out + ["one page that was copied very often indeed " * 3] * copies + [None, "", "!!", "é" * 5000]


def grams_of(text: str | None) -> dict[int, int]:
    data, offsets = utf8(pa.array([text], pa.string()))
    seen: dict[int, int] = {}
    for found in X.Grams().each(data, offsets):
        for g in found[found >= 0].tolist():
            seen[g] = seen.get(g, 0) + 1
    return seen


def test_rates_count_every_document_and_copies_once(spark, monkeypatch):
    monkeypatch.setattr(X, "CROWD", 20)  # groups beyond a twentieth are crowds
    rows = texts_of(120, 60)
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    crowds = X.Crowds.find(df)
    assert [s.tolist() for s in crowds.sizes] == [[60]] * 3
    counts = [grams_of(t) for t in rows]
    every = sorted({g for c in counts for g in c})
    features = np.array([g * X.LEVELS + level for g in every[::7] for level in range(X.LEVELS)], dtype=np.int64)
    got = {n: {r["f"]: r["u"] for r in df.repartition(n).mapInArrow(X._rates(features, crowds), "f long, u long").groupBy("f").agg(F.sum("u").alias("u")).collect()} for n in (1, 7)}
    assert got[1] == got[7]
    weight = [X.UNIT // 60 if t and t.startswith("one page") else X.UNIT for t in rows]
    want = {int(f): sum(w for c, w in zip(counts, weight, strict=True) if c.get(f // X.LEVELS, 0) > f % X.LEVELS) for f in features}
    assert got[1] == {f: u for f, u in want.items() if u} | {-1: sum(weight)}
    assert any(f % X.LEVELS == X.LEVELS - 1 for f in got[1])


def test_no_crowds_means_whole_weights(spark):
    """Texts that differ weigh in full; in a table of few rows two without words are a crowd already."""
    df = spark.createDataFrame([(t,) for t in texts_of(50, 1)], "text string")
    empty = X.Crowds.find(df)
    assert [x.tolist() for x in empty.least] == [[0]] * 3 and [x.tolist() for x in empty.sizes] == [[2]] * 3
    crowds = X.Crowds.find(df.where("length(text) > 0"))
    assert all(len(x) == 0 for x in crowds.least)
    data, offsets = utf8(pa.array(["a b c", None, ""]))
    assert crowds.weights(X.Minima(), data, offsets).tolist() == [X.UNIT] * 3
    none = X.Crowds.find(df.limit(0))
    assert all(len(x) == 0 for x in none.least)


def test_clearest_follows_the_likelihood_ratio():
    p, u, n_p, n_u = np.array([50, 50, 6, 90, 40]), np.array([10.0, 900.0, 0.0, 20.0, 0.0]), 100, 1000.0

    def log_likelihood(hit: float, of: float, rate: float) -> float:
        return sum(n * np.log(r) for n, r in ((hit, rate), (of - hit, 1 - rate)) if n)

    ratio = [log_likelihood(a, n_p, a / n_p) + log_likelihood(b, n_u, b / n_u) - log_likelihood(a, n_p, (a + b) / (n_p + n_u)) - log_likelihood(b, n_u, (a + b) / (n_p + n_u))
             for a, b in zip(p.tolist(), u.tolist(), strict=True)]
    good = [i for i in range(5) if p[i] / n_p > u[i] / n_u and 0.1 * (p[i] / n_p) / (u[i] / n_u + 2 / n_u) >= 0.5 and ratio[i] >= X.LEAST_CLEAR]
    assert X._clearest(np.arange(5) * 3, p, n_p, u, n_u, 0.1).tolist() == [i * 3 for i in good] and good == [0, 3, 4]
    assert X._clearest(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 3, np.zeros(0), 9.0, 0.1).tolist() == []


def test_cut_has_the_least_corrected_risk():
    draw = np.random.default_rng(3)
    for _ in range(20):
        positive, steps = draw.integers(-200, 300, 40), draw.permutation(np.arange(-300, 300))[:90]
        weights, prior = draw.integers(1, 1000, 90), float(draw.uniform(0.05, 0.4))

        def risk(cut: float, positive=positive, steps=steps, weights=weights, prior=prior) -> float:
            found, flagged = (positive >= cut).mean(), weights[steps >= cut].sum() / weights.sum()
            return prior * (1 - found) + max(flagged - prior * found, 0)

        at = X._middle(positive, steps, weights, prior) * X.CUTS
        assert risk(at) <= min(risk(c + 0.5) for c in range(-301, 301)) + 1e-8


def test_gradient_lowers_the_risk():
    rows = [np.array([1, 2]), np.array([1]), np.array([2, 3]), np.array([3]), np.array([], dtype=int), np.array([3])]
    positive = np.array([True, True, False, False, False, False])

    def risk(w: np.ndarray, bias: float) -> float:
        f = np.array([w[r].sum() + bias for r in rows])
        up, down = np.log1p(np.exp(-f)), np.log1p(np.exp(f))
        return 0.3 * up[positive].mean() + max(0.0, down[~positive].mean() - 0.3 * down[positive].mean())

    start = risk(np.zeros(5), -2.0)
    risks = [risk(*X.fit_non_negative(rows, positive, 3, 0.3, steps=n)) for n in (5, 50, 300)]
    assert start > risks[0] > risks[1] >= risks[2] - 1e-3
    w, bias = X.fit_non_negative(rows, positive, 3, 0.3)
    assert w[1] > 0 > w[3] and w[1] + bias > w[3] + bias


def test_held_out_texts_lend_nothing(spark):
    """The model is the same whatever stands in held-out documents."""
    rows = [(i, t + (" vileword vileword" if i % 4 == 0 else "")) for i, t in enumerate(x for x in texts_of(300, 0) if x)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    swapped = [(i, "vileword " * 40 if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in rows]
    one, two = (X.fit(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, swapped))
    assert len(one.features) and (one.features == two.features).all() and (one.weights == two.weights).all() and one.bias == two.bias
