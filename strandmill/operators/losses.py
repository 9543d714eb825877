"""Loss reports over a prediction table (scores in, one row out)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import scalars as S
from strandmill.operators.ranking import TASK_ROWS, keep_first, quantile_values


def bce(logit: Column, label: Column, pos_weight: float | None = None, smoothing: float = 0.0) -> Column:
    return S.bce_with_logits(logit, S.smooth_label(label, smoothing), pos_weight)


def focal(logit: Column, label: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p, y = S.sigmoid(logit), label.cast("double")
    pt = p * y + (1.0 - p) * (1.0 - y)
    weight = alpha * y + (1.0 - alpha) * (1.0 - y)
    return weight * F.pow(1.0 - pt, F.lit(gamma)) * S.bce_with_logits(logit, y)


def asymmetric(logit: Column, label: Column, gamma_neg: float = 1.0, gamma_pos: float = 0.0, smoothing: float = 0.0) -> Column:
    p, y = S.sigmoid(logit), S.smooth_label(label, smoothing)
    pt = p * y + (1.0 - p) * (1.0 - y)
    return F.pow(1.0 - pt, gamma_pos * y + gamma_neg * (1.0 - y)) * S.bce_with_logits(logit, y)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1e-8))


def pointwise_losses(df: DataFrame, weight: Column | None = None, pos_weight: float = 2.0, smoothing: float = 0.1) -> DataFrame:
    """BCE, smoothed and weighted BCE, focal and asymmetric loss in one pass."""
    z, y = F.col("logit"), F.col("label")
    w = weight if weight is not None else F.lit(1.0)
    return df.agg(
        F.avg(bce(z, y)).alias("bce"),
        F.avg(bce(z, y, pos_weight, smoothing)).alias("bce_pos_weight_smooth"),
        weighted_mean(bce(z, y, smoothing=smoothing), w).alias("bce_weighted"),
        F.avg(focal(z, y)).alias("focal"),
        F.avg(asymmetric(z, y)).alias("asymmetric"))


def harmonised_loss(df: DataFrame, bins: int = 10) -> DataFrame:
    """BCE weighted by the inverse count of its gradient-size bin: needs only per-bin sums."""
    y = F.col("label").cast("double")
    g = F.abs(S.sigmoid(F.col("logit")) - y)
    edges = [i / bins for i in range(1, bins)]
    per_bin = df.groupBy(S.edges_passed(g, edges, "right").alias("bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(S.bce_with_logits(F.col("logit"), y)).alias("_l"))
    n = F.sum("_n")
    return per_bin.agg((F.sum(n_over_count(F.col("_l"), F.col("_n")))).alias("ghm"), n.alias("n"))


def n_over_count(loss_sum: Column, count: Column) -> Column:
    """Per-bin share of mean(n / count * loss): the n cancels."""
    return loss_sum / count


def hard_example_loss(df: DataFrame, keep_ratio: float = 0.7, task_rows: int = TASK_ROWS) -> DataFrame:
    """Mean BCE over all positives and the hardest negatives; ties at the threshold are all kept."""
    rows = df.select((F.col("label") > 0.5).alias("_pos"), S.bce_with_logits(F.col("logit"), F.col("label")).alias("_l"))
    negatives = rows.where(~F.col("_pos"))
    n_neg = negatives.count()
    if n_neg == 0:
        return rows.agg(F.avg("_l").alias("ohem"), F.count(F.lit(1)).alias("n_kept"))
    n_keep = max(1, int(n_neg * keep_ratio))
    # The n_keep-th largest loss is an order statistic: quantile at its exact 0-based rank.
    rank = n_neg - n_keep
    cut = quantile_values(negatives, "_l", [rank / (n_neg - 1) if n_neg > 1 else 0.0], task_rows)[0]
    slack = 1e-12 * max(1.0, abs(cut))
    kept = rows.where(F.col("_pos") | (F.col("_l") >= cut - slack))
    return kept.agg(F.avg("_l").alias("ohem"), F.count(F.lit(1)).alias("n_kept"))


def frontier_loss(
    df: DataFrame, lambda_max: float = 0.12, budget_ratio: float = 0.35, top_frac: float = 0.2, top_k: int = 128,
    margin_center: float = 0.0, margin_temp: float = 0.5, guard_weight: float = 0.05, guard_quantile: float = 0.95,
    guard_margin: float = 0.0, gamma_neg: float = 1.0, pos_weight: float = 1.0, smoothing: float = 0.0,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Anchor BCE + bounded pairwise term against the top negatives + tail guard.

    ``top_k`` is part of the loss; those scores become one literal array that each positive scans.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    z, y = F.col("logit"), F.col("label")
    positive = y > 0.5
    weight = F.when(positive, F.lit(pos_weight)).otherwise(F.pow(S.sigmoid(z), F.lit(gamma_neg)))
    base = df.agg(
        F.avg(weight * bce(z, y, smoothing=smoothing)).alias("anchor"),
        F.count_if(~positive).alias("neg"), F.count_if(positive).alias("pos")).first()
    if not base["neg"] or not base["pos"]:
        return df.agg(F.lit(float(base["anchor"] or 0.0)).alias("anchor"), F.lit(0.0).alias("pairwise"),
                      F.lit(0.0).alias("fp_guard"), F.lit(lambda_max).alias("lambda_dynamic"),
                      F.lit(float(base["anchor"] or 0.0)).alias("total"))
    negatives = df.where(~positive).select("logit")
    n_top = min(max(1, round(top_frac * base["neg"])), top_k, base["neg"])
    tops = [float(r[0]) for r in negatives.orderBy(F.desc("logit")).limit(n_top).collect()]
    top_array = F.array(*[F.lit(t) for t in tops])
    margins = F.transform(top_array, lambda t: z - t)
    frontier = F.transform(margins, lambda m: F.struct(
        S.sigmoid((margin_center - m) / margin_temp).alias("w"), S.softplus(-m).alias("l")))
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("l"))
    sums = F.aggregate(frontier, zero, lambda a, x: F.struct(
        (a["w"] + x["w"]).alias("w"), (a["l"] + x["w"] * x["l"]).alias("l")))
    cut = quantile_values(negatives, "logit", [guard_quantile], task_rows)[0]
    cut -= 1e-12 * max(1.0, abs(cut))
    pair = df.withColumn("_s", F.when(positive, sums)).agg(
        F.lit(float(base["anchor"])).alias("anchor"),
        F.avg(F.col("_s.l") / (F.col("_s.w") + 1e-8)).alias("pairwise"),
        F.coalesce(F.avg(F.when(~positive & (z >= cut), S.softplus(z - guard_margin))), F.lit(0.0)).alias("fp_guard"))
    lam = F.least(budget_ratio * F.col("anchor") / (F.col("pairwise") + 1e-8), F.lit(lambda_max))
    return pair.withColumn("lambda_dynamic", lam).withColumn(
        "total", F.col("anchor") + F.col("lambda_dynamic") * F.col("pairwise") + guard_weight * F.col("fp_guard"))


def pairwise_losses(pairs: DataFrame, pointwise: DataFrame, mix: float = 0.15) -> DataFrame:
    """Pairwise logistic loss over sampled pairs, alone and mixed with BCE and asymmetric loss."""
    mix = min(max(mix, 0.0), 1.0)
    pair = pairs.agg(F.avg(S.softplus(-(F.col("pos_logit") - F.col("neg_logit")))).alias("pairwise"))
    row = pointwise.select(F.struct("bce", "asymmetric").alias("p")).scalar()
    return pair.withColumn("_p", row).select(
        "pairwise", ((1.0 - mix) * F.col("_p.bce") + mix * F.col("pairwise")).alias("ranking"),
        ((1.0 - mix) * F.col("_p.asymmetric") + mix * F.col("pairwise")).alias("asymmetric_ranking"))


def disagreement_loss(
    df: DataFrame, view_a: str = "logit_a", view_b: str = "logit_b", temperature: float = 0.75, floor: float = 0.1,
    target_mix: float = 0.15, gamma_neg: float = 1.0, smoothing: float = 0.0,
) -> DataFrame:
    """BCE over two score columns; positives on which the views disagree weigh less."""
    a, b = F.col(view_a), F.col(view_b)
    positive = F.col("label") > 0.5
    mean_prob = S.sigmoid(0.5 * (a + b))
    y = F.col("label").cast("double")
    target = F.when(positive, (1.0 - target_mix) + target_mix * mean_prob).otherwise(y) if target_mix > 0 else y
    target = S.smooth_label(target, smoothing)
    reliability = S.clip(F.exp(-F.abs(a - b) / temperature), floor, 1.0)
    weight = F.when(positive, reliability).otherwise(F.pow(mean_prob, F.lit(gamma_neg)))
    loss = 0.5 * (S.bce_with_logits(a, target) + S.bce_with_logits(b, target))
    return df.agg(
        F.coalesce(F.avg(F.when(positive, reliability)), F.lit(1.0)).alias("mean_pos_reliability"),
        F.avg(weight).alias("mean_weight"), F.avg(weight * loss).alias("mean_loss"))
