"""Fitted linear algebra on vector columns: PCA, effective rank, clusters against labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import arrays as A
from strandmill.operators.splits import reservoir


def as_vectors(df: DataFrame, column: str, name: str = "_vec") -> DataFrame:
    clean = F.transform(F.col(column).cast("array<double>"), lambda v: F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))
    return df.withColumn(name, array_to_vector(clean))


def pca_fit(df: DataFrame, column: str, k: int) -> dict[str, list]:
    """Mean and top-k components; each component's largest entry is positive.

    The covariance is summed on the executors; only d x d numbers reach the driver.
    """
    vec = as_vectors(df.select(column), column)
    mean = vec.agg(Summarizer.mean(F.col("_vec")).alias("m")).first()["m"].toArray()
    model = PCA(k=k, inputCol="_vec", outputCol="_pc").fit(vec)
    comps = model.pc.toArray().T
    signs = [np.sign(c[np.argmax(np.abs(c))]) or 1.0 for c in comps]
    return {"mean": mean.tolist(), "components": [(c * s).tolist() for c, s in zip(comps, signs, strict=True)],
            "explained": model.explainedVariance.toArray().tolist()}


def pca_project(values: Column, state: dict[str, list] | None, k: int) -> Column:
    """(x - mean) . components; zeros when unfitted.  The state is d x k numbers, fixed by the schema."""
    if not state:
        return F.array(*[F.lit(0.0)] * k)
    axes = F.array(*[A.double_array(c) for c in state["components"][:k]])
    centred = F.zip_with(values.cast("array<double>"), A.double_array(state["mean"]), lambda x, m: x - m)
    return A.let(centred, lambda x: F.transform(axes, lambda c: A.dot(x, c)))


def gram(df: DataFrame, column: str) -> np.ndarray:
    """X^T X from the JVM-side covariance eigenvectors: (n - 1) V diag(var) V^T + n mean mean^T."""
    vec = as_vectors(df.select(column), column)
    row = vec.agg(
        Summarizer.mean(F.col("_vec")).alias("m"), Summarizer.variance(F.col("_vec")).alias("v"),
        F.count(F.lit(1)).alias("n")).first()
    mean, n = row["m"].toArray(), row["n"]
    model = PCA(k=mean.size, inputCol="_vec", outputCol="_pc").fit(vec)
    axes = model.pc.toArray()
    spread = model.explainedVariance.toArray() * row["v"].toArray().sum()
    return (n - 1) * (axes * spread) @ axes.T + n * np.outer(mean, mean)


def spectral_rank(df: DataFrame, column: str) -> dict[str, float]:
    """Effective rank exp(H(sigma / sum)) and information abundance sum(sigma) / max(sigma)."""
    sigma = np.sqrt(np.clip(np.linalg.eigvalsh(gram(df, column)), 0.0, None))
    sigma = sigma[sigma > 1e-7]
    if sigma.size == 0:
        return {"effective_rank": 1.0, "information_abundance": 1.0}
    p = sigma / sigma.sum()
    return {"effective_rank": float(np.exp(-(p * np.log(p)).sum())),
            "information_abundance": float(sigma.sum() / sigma.max())}


def standardise(df: DataFrame, column: str, name: str = "_std") -> DataFrame:
    """Zero mean, unit deviation per position (population form; constant positions only centred)."""
    vec = as_vectors(df, column)
    n = vec.count()
    model = StandardScaler(inputCol="_vec", outputCol="_s", withMean=True, withStd=True).fit(vec)
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    out = model.transform(vec)
    scaled = F.transform(vector_to_array("_s"), lambda v: v * factor)
    return out.withColumn(name, scaled).drop("_vec", "_s")


def project_2d(df: DataFrame, column: str, key: str, max_points: int = 5000, seed: int = 42) -> DataFrame:
    """Standardise and project a fixed-size uniform sample on its two main axes."""
    points = reservoir(df, max_points, seed, [key])
    std = standardise(points, column)
    state = pca_fit(std, "_std", 2)
    xy = pca_project(F.col("_std"), state, 2)
    return std.withColumn("_xy", xy).select(key, F.get("_xy", F.lit(0)).alias("x"), F.get("_xy", F.lit(1)).alias("y"))


def expected_information(rows: np.ndarray, columns: np.ndarray) -> float:
    """Expected MI of a table with these margins when rows and columns are independent.

    Each cell is hypergeometric.  Its weights follow from the most likely count by the ratio of neighbours, over the
    counts within nine deviations (and sixty) of it; what lies beyond has less weight than rounding.  The work grows with the
    deviation, not with the counts, and no factorial is formed, so large counts keep their digits.
    """
    n = float(rows.sum())
    (a, times_a), (b, times_b) = (np.unique(v[v > 0].astype(float), return_counts=True) for v in (rows, columns))
    out = 0.0
    for x, tx in zip(a, times_a, strict=True):
        for y, ty in zip(b, times_b, strict=True):
            low, high = max(0.0, x + y - n), min(x, y)
            mode = min(max(math.floor((x + 1) / (n + 2) * (y + 1)), low), high)
            reach = 9 * math.sqrt(x / n * y * (1 - x / n) * (1 - y / n)) + 60
            k = np.arange(max(low, mode - math.ceil(reach)), min(high, mode + math.ceil(reach)) + 1)
            steps = np.log((x - k[:-1]) * (y - k[:-1])) - np.log((k[:-1] + 1) * (n - x - y + k[:-1] + 1))
            logs = np.concatenate([[0.0], np.cumsum(steps)])
            w = np.exp(logs - logs.max())
            w /= w.sum()
            some = k > 0
            out += tx * ty * float((k[some] / n * np.log(k[some] / x * (n / y)) * w[some]).sum())
    return out


def mutual_information(table: np.ndarray) -> tuple[float, float]:
    """(MI, adjusted MI) of a small contingency table, natural log, arithmetic-mean adjustment."""
    n = table.sum()
    a, b = table.sum(axis=1), table.sum(axis=0)
    nz = table > 0
    mi = float((table[nz] / n * np.log(table[nz] * n / np.outer(a, b)[nz])).sum())
    ha, hb = (float(-(v[v > 0] / n * np.log(v[v > 0] / n)).sum()) for v in (a, b))
    if (a > 0).sum() <= 1 and (b > 0).sum() <= 1:
        return mi, 1.0
    expected = expected_information(a, b)
    top = 0.5 * (ha + hb) - expected
    return mi, float((mi - expected) / top) if abs(top) > 1e-15 else 0.0


def cluster_label_information(
    df: DataFrame, column: str, label: str, ks: Sequence[int] = (4, 16, 48, 96), seeds: Sequence[int] = (0, 1, 2),
) -> DataFrame:
    """k-means clusters against labels: mean and deviation of MI and adjusted MI over seeds.

    Clustering and the contingency counts are Spark jobs; the k x labels table is finished here.
    """
    std = standardise(df.select(column, label), column).select(
        array_to_vector("_std").alias("features"), F.col(label).cast("int").alias("_y")).persist()
    try:
        n = std.count()
        rows = []
        for k in ks:
            if n < k:  # no clustering: the row says so
                rows.append((int(k), n, None, None, None, None))
                continue
            mis, amis = [], []
            for seed in seeds:
                model = KMeans(k=k, seed=seed, maxIter=20).fit(std)
                counts = model.transform(std).groupBy("_y", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()
                ys = sorted({r["_y"] for r in counts})
                table = np.zeros((len(ys), k))
                for r in counts:
                    table[ys.index(r["_y"]), r["prediction"]] = r["n"]
                mi, ami = mutual_information(table)
                mis.append(mi)
                amis.append(ami)
            rows.append((int(k), n, *(float(f(v)) for v in (mis, amis) for f in (np.mean, np.std))))
    finally:
        std.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "k int, n long, mi_mean double, mi_std double, ami_mean double, ami_std double")
