"""Splits, exact-size samples and row-set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import scalars as S
from strandmill.operators.ranking import TASK_ROWS, global_rank, quantile_values, running_totals


def positional_split(df: DataFrame, flat_idx: str, valid_ratio: float, rows: int | None = None) -> DataFrame:
    """The last ``int(n * valid_ratio)`` rows in flat order are validation (``is_valid``)."""
    n = df.count() if rows is None else rows
    return df.withColumn("is_valid", F.col(flat_idx) >= n - int(n * valid_ratio))


def time_cutoff(df: DataFrame, ts: str, valid_ratio: float, task_rows: int = TASK_ROWS) -> int:
    return int(quantile_values(df, ts, [1 - valid_ratio], task_rows)[0])


def time_split(df: DataFrame, ts: str, valid_ratio: float, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows at or after the floored time quantile are validation."""
    return df.withColumn("is_valid", F.col(ts) >= time_cutoff(df, ts, valid_ratio, task_rows))


def exact_sample(
    df: DataFrame, n: int | Column, seed: int, keys: Sequence[str], task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Exactly ``n`` rows chosen by a per-row draw: order-free, mergeable, retry-safe."""
    drawn = df.withColumn("_u", S.draw(seed, *[F.col(k) for k in keys]))
    order = [F.col("_u"), *[F.col(k) for k in keys]]
    ranked = global_rank(drawn, order, "_rank", task_rows=task_rows)
    return ranked.where(F.col("_rank") <= n).drop("_rank", "_u")


def ratio_sample(df: DataFrame, ratio: float, seed: int, keys: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """``max(1, int(n * ratio))`` rows; none for ``ratio <= 0``, all for ``ratio >= 1``."""
    if ratio <= 0:
        return df.where(F.lit(False))
    if ratio >= 1:
        return df
    return exact_sample(df, max(1, int(df.count() * ratio)), seed, keys, task_rows)


def epoch_order(df: DataFrame, seed: int, epoch: int, keys: Sequence[str]) -> DataFrame:
    """A reproducible shuffle per epoch: range-partitioned sort by the epoch's draw."""
    return df.withColumn("shuffle_key", S.draw(seed + epoch, *[F.col(k) for k in keys])).orderBy(
        "shuffle_key", *keys)


def reservoir(df: DataFrame, size: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """A uniform sample of fixed size: the ``size`` smallest draws (top-k per task, then merged)."""
    return df.withColumn("_u", S.draw(seed, *[F.col(k) for k in keys])).orderBy("_u", *keys).limit(size).drop("_u")


def class_capped(
    df: DataFrame, label: str, caps: dict[int, int], seed: int, keys: Sequence[str], task_rows: int = TASK_ROWS,
) -> DataFrame:
    """At most ``caps[label]`` rows of each class, uniformly; the cap is the sample size asked for."""
    drawn = df.withColumn("_u", S.draw(seed, *[F.col(k) for k in keys]))
    ranked = running_totals(
        drawn, [label], [F.col("_u"), *[F.col(k) for k in keys]], {"_rank": F.lit(1).cast("long")},
        task_rows=task_rows)
    keep = F.lit(False)
    for value, cap in caps.items():
        keep = keep | ((F.col(label) == value) & (F.col("_rank") <= cap if cap > 0 else F.lit(True)))
    return ranked.where(keep).drop("_rank", "_u")


def top_fraction_flags(
    df: DataFrame, value: str, tie: str, fractions: dict[str, int], task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Boolean per fraction: among the ``max(1, n // divisor)`` largest values (ties by ``tie``)."""
    n = df.count()
    ranked = global_rank(df, [F.col(value).desc(), F.col(tie)], "_rank", task_rows=task_rows, sizes=(n, n))
    return ranked.withColumns(
        {name: F.col("_rank") <= max(1, n // div) for name, div in fractions.items()}).drop("_rank")


def set_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of intersection, union and differences of two row-id sets, in one full join."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer")
    ina, inb = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(
        F.count_if(ina & inb).alias("n_both"), F.count(F.lit(1)).alias("n_union"),
        F.count_if(ina & ~inb).alias("n_left_only"), F.count_if(inb & ~ina).alias("n_right_only"),
        S.ratio(F.count_if(ina & inb), F.count(F.lit(1))).alias("jaccard"),
        S.ratio(F.count_if(inb & ~ina), F.count_if(inb)).alias("entry_rate"))


def validation_only_rows(df: DataFrame, chunk: Column, is_valid: str = "is_valid") -> DataFrame:
    """Validation rows of chunks that hold no training row."""
    rows = df.withColumn("_chunk", chunk)
    trained = rows.where(~F.col(is_valid)).select("_chunk").distinct()
    return rows.where(F.col(is_valid)).join(trained, "_chunk", "left_anti").drop("_chunk")
