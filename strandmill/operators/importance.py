"""Shapley importance of feature groups: a model is scored with the other groups masked.

What a coalition of groups is worth (mean loss, AUC) depends on the set alone, so every set that the walks meet is scored
once, over all rows; walks and exact values are then differences of these few numbers.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import scalars as S
from strandmill.operators.normalize import mask_columns
from strandmill.operators.ranking import TASK_ROWS, running_totals
from strandmill.session import cut

Scorer = Callable[[DataFrame], DataFrame]
VALUES = "group string, loss_value double, loss_se double, auc_value double, auc_se double, n_permutations long"


def walks(groups: Sequence[str], permutations: int, seed: int, first: int = 0) -> list[list[int]]:
    """Group numbers in the order in which each walk reveals them."""
    out = []
    for p in range(first, first + permutations):
        order = list(range(len(groups)))
        random.Random(f"{seed}|{p}").shuffle(order)
        out.append(order)
    return out


def coalition_values(
    df: DataFrame, groups: Mapping[str, Sequence[str]], scorer: Scorer, coalitions: Iterable[int], task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``coalition`` (bit i: the i-th group is shown), ``n``, ``loss``, ``auc`` (one half if a class is missing).

    All rows with a label count.  Columns of hidden groups are zeroed, arrays keep their length; ``scorer`` adds ``logit``.
    Rows meet their coalitions as a literal array and are counted per distinct score at once, so nothing joins.
    """
    rows = df.where(F.col("label").isNotNull()).select(
        "*", F.explode(F.array(*[F.lit(c).cast("long") for c in sorted(coalitions)])).alias("_coalition"))
    for i, columns in enumerate(groups.values()):
        rows = mask_columns(rows, columns, F.col("_coalition").bitwiseAND(F.lit(1 << i).cast("long")) == 0)
    pos = F.col("label") > 0.5
    hist = cut(scorer(rows).groupBy(F.col("_coalition").alias("coalition"), (F.col("logit") + F.lit(0.0)).alias("_z")).agg(
        F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_q")))
    ranked = running_totals(hist, ["coalition"], [F.col("_z")], {"_qu": F.col("_q")}, task_rows=task_rows)
    z, p, q = F.col("_z"), F.col("_p").cast("double"), F.col("_q").cast("double")
    loss = p * S.bce_with_logits(z, F.lit(1.0)) + q * S.bce_with_logits(z, F.lit(0.0))
    won = F.sum(p * (F.col("_qu") - q / 2.0))
    n = F.sum(F.col("_p") + F.col("_q"))
    return ranked.groupBy("coalition").agg(
        n.alias("n"), (F.sum(loss) / n).alias("loss"),
        F.coalesce(F.try_divide(won, F.sum(p) * F.sum(q)), F.lit(0.5)).alias("auc"))


def exact_importance(
    df: DataFrame, groups: Mapping[str, Sequence[str]], scorer: Scorer, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Shapley values over all 2^k coalitions of k groups (at most twelve); standard errors are zero."""
    k = len(groups)
    if k > 12:
        raise ValueError("exact values take at most twelve groups; walk instead")
    worth = {r["coalition"]: r for r in coalition_values(df, groups, scorer, range(1 << k), task_rows).collect()}
    out = []
    for i, name in enumerate(groups if worth else ()):
        loss = auc = 0.0
        for c in range(1 << k):
            if not c >> i & 1:
                size = c.bit_count()
                share = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                loss += share * (worth[c]["loss"] - worth[c | 1 << i]["loss"])
                auc += share * (worth[c | 1 << i]["auc"] - worth[c]["auc"])
        out.append((name, loss, 0.0, auc, 0.0, math.factorial(k)))
    return df.sparkSession.createDataFrame(out, VALUES)


class RunningMean:
    """Mean and standard error of a stream of numbers; two of them merge."""

    def __init__(self) -> None:
        self.n, self.mean, self.spread = 0, 0.0, 0.0

    def add(self, x: float) -> None:
        other = RunningMean()
        other.n, other.mean = 1, x
        self.merge(other)

    def merge(self, other: RunningMean) -> None:
        n = self.n + other.n
        if n:
            apart = other.mean - self.mean
            self.spread += other.spread + apart * apart * self.n * other.n / n
            self.mean += apart * other.n / n
            self.n = n

    @property
    def error(self) -> float:
        return math.sqrt(self.spread / (self.n * (self.n - 1))) if self.n > 1 else 0.0


def group_importance(
    df: DataFrame, groups: Mapping[str, Sequence[str]], scorer: Scorer, permutations: int = 100, batch: int = 10,
    threshold: float = 0.025, seed: int = 42, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Random walks over all rows, in batches, until the largest standard error is small against the spread of the values.

    A batch scores only coalitions that no earlier one met; the driver holds one loss and one AUC for each.  A table
    without labelled rows gives no rows.
    """
    names = list(groups)
    worth: dict[int, tuple[float, float]] = {}
    loss, auc = ([RunningMean() for _ in names] for _ in range(2))
    for first in range(0, permutations, batch):
        orders = walks(names, min(batch, permutations - first), seed, first)
        paths = [[sum(1 << g for g in order[:s]) for s in range(len(order) + 1)] for order in orders]
        fresh = {c for path in paths for c in path} - worth.keys()
        if fresh:
            got = coalition_values(df, groups, scorer, fresh, task_rows).collect()
            if not got:
                return df.sparkSession.createDataFrame([], VALUES)
            worth |= {r["coalition"]: (r["loss"], r["auc"]) for r in got}
        for order, path in zip(orders, paths, strict=True):
            for g, before, after in zip(order, path[:-1], path[1:], strict=True):
                loss[g].add(worth[before][0] - worth[after][0])
                auc[g].add(worth[after][1] - worth[before][1])
        worst = max(m.error for m in (*loss, *auc))
        spread = [max(max(m.mean for m in ms) - min(m.mean for m in ms), 1e-12) for ms in (loss, auc)]
        if max(worst / s for s in spread) < threshold:
            break
    return df.sparkSession.createDataFrame(
        [(n, a.mean, a.error, b.mean, b.error, a.n) for n, a, b in zip(names, loss, auc, strict=True)], VALUES)
