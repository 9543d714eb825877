"""Data-health reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions import scalars as S
from strandmill.operators.evaluate import percentile_names
from strandmill.operators.ranking import TASK_ROWS, exact_quantiles, running_totals, same_keys
from strandmill.session import cut


def dense_column_stats(df: DataFrame, column: str) -> DataFrame:
    """min, max, mean, std and zero share per vector position (partial aggregates, no sort)."""
    rows = df.select(F.posexplode(column).alias("dim", "_x")).withColumn("_x", F.col("_x").cast("double"))
    return rows.groupBy("dim").agg(
        F.min("_x").alias("min"), F.max("_x").alias("max"), F.avg("_x").alias("mean"),
        F.stddev_pop("_x").alias("std"), F.avg((F.col("_x") == 0).cast("double")).alias("zero_share"))


def dense_summary(stats: DataFrame) -> DataFrame:
    constant = F.count_if(F.col("std") < 1e-6)
    return stats.agg(
        F.count(F.lit(1)).alias("cols"), constant.alias("constant"),
        (F.count_if(F.col("zero_share") > 0.9) - constant).alias("high_sparse"))


def sequence_length_report(
    df: DataFrame, domains: Mapping[str, tuple[str, str]], task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Length and truncation report; ``domains`` maps name -> (length, raw length) columns."""
    rows = df.select(F.inline(F.array(*[
        F.struct(F.lit(d).alias("domain"), F.col(n).cast("long").alias("n"), F.col(r).cast("long").alias("raw"))
        for d, (n, r) in domains.items()])))
    base = rows.groupBy("domain").agg(
        F.max("n").alias("max"), F.avg((F.col("n") == 0).cast("double")).alias("empty"),
        S.ratio(F.count_if((F.col("raw") > 0) & (F.col("raw") > F.col("n"))), F.count_if(F.col("raw") > 0)).alias("trunc_rate"),
        F.max("raw").alias("raw_max"))
    points = [25, 50, 75, 95]
    q = exact_quantiles(rows, ["domain"], "n", percentile_names(points), task_rows)
    raw = exact_quantiles(rows.where(F.col("raw") > 0), ["domain"], "raw", percentile_names(points, "raw_p"), task_rows)
    return base.join(q, "domain").join(raw, "domain", "left")


def label_rate_report(df: DataFrame, batch: Column) -> DataFrame:
    """Mean and variance of the per-batch label rate, overall rate, per-class loss."""
    y = F.col("label").cast("double")
    per = df.groupBy(batch.alias("_b")).agg(
        F.avg(y).alias("_rate"), F.sum(y).alias("_s"), F.count(F.lit(1)).alias("_n"),
        F.avg(F.when(F.col("label") > 0.5, F.col("loss"))).alias("_lp"),
        F.avg(F.when(F.col("label") <= 0.5, F.col("loss"))).alias("_ln"))
    return per.agg(
        F.avg("_rate").alias("mean"), F.var_pop("_rate").alias("var"), (F.sum("_s") / F.sum("_n")).alias("running_label_rate"),
        F.avg("_lp").alias("loss_pos"), F.avg("_ln").alias("loss_neg"))


def out_of_bounds(df: DataFrame, columns: Mapping[str, int]) -> DataFrame:
    """Per feature: rows whose id is missing, not positive, or beyond the vocabulary."""
    counted = df.agg(*[
        F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("n_null"),
                 F.count_if(F.col(c) <= 0).alias("n_low"), F.count_if(F.col(c) >= v).alias("n_high")).alias(c)
        for c, v in columns.items()])
    return counted.select(F.inline(F.array(*[F.col(c) for c in columns])))


def id_utilisation(
    values: DataFrame, vocab: Mapping[str, int], points: Sequence[int] = (25, 50, 75, 95), task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Hits per (feature, 0 < id < vocabulary): coverage, hit percentiles and Gini with unhit ids as zeros.

    Ids beyond the vocabulary are no part of it; a feature without any hit has a row too.  The sorted zero block has a
    closed form, so only hit ids are ranked.
    """
    sizes = F.create_map(*[x for f, v in vocab.items() for x in (F.lit(f), F.lit(v - 1).cast("long"))])
    inside = (F.col("value") > 0) & (F.col("value") <= sizes[F.col("feature")])
    hits = values.where(inside).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    hist = hits.groupBy("feature", "c").agg(F.count(F.lit(1)).alias("m"))
    run = running_totals(hist, ["feature"], [F.col("c")], {"_upto": F.col("m")}, task_rows=task_rows)
    # Sum of ranks of the m ids sharing one count, before shifting by the zero block.
    ranks = F.col("m") * (F.col("_upto") - F.col("m")) + F.col("m") * (F.col("m") + 1) / 2
    per = run.groupBy("feature").agg(
        F.sum("m").alias("hit"), F.sum(F.col("c") * F.col("m")).alias("_t"), F.max("c").alias("max"),
        F.sum(F.col("c") * ranks).alias("_w"))
    known = values.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in vocab])).alias("feature"))
    per = known.join(per, "feature", "left").fillna(0, ["hit", "_t", "max", "_w"]).withColumn("total", sizes[F.col("feature")])
    zeros = F.col("total") - F.col("hit")
    gini = F.when(F.col("_t") == 0, F.lit(float("nan"))).otherwise(
        2.0 * (F.col("_w") + zeros * F.col("_t")) / (F.col("total") * F.col("_t").cast("double")) - (F.col("total") + 1) / F.col("total"))
    q = exact_quantiles(hits, ["feature"], "c", percentile_names(points), task_rows)
    return per.join(q, "feature", "left").select(
        "feature", "total", "hit", (F.col("hit") / F.col("total")).alias("hit_rate"), "max", gini.alias("gini"),
        *[F.floor(n).cast("long").alias(n) for n in percentile_names(points)])


def best_so_far(series: DataFrame, keys: Sequence[str], step: str, score: str, patience: int) -> DataFrame:
    """Running best, change, plateau length and stop flag of a metric series (improvement: strictly better).

    One series is as long as its evaluations, so its window is small.
    """
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = part.orderBy(step)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = series.withColumns({
        "best": F.max(score).over(upto), "delta": F.col(score) - F.lag(score).over(w),
        "_i": F.row_number().over(w),
        "_up": F.max(score).over(before).isNull() | (F.col(score) > F.max(score).over(before))})
    plateau = F.col("_i") - F.max(F.when(F.col("_up"), F.col("_i"))).over(upto)
    out = marked.withColumn("plateau", plateau)
    return out.withColumn(
        "stopped", (F.max("plateau").over(upto) >= patience)).drop("_i", "_up")


def early_stop(
    series: DataFrame, keys: Sequence[str], step: str, score: str, patience: int, delta: float, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Early stopping with a minimum improvement: best, plateau and stopped of every series.

    A step improves if it beats the last improvement by more than ``delta``; the first known score improves.  Only
    records (scores above all before) can improve, so the records of a series are found by running maxima; each points
    to the first record above its score + delta, an as-of pass in the order of scores; and what the first record
    reaches is found by doubling the pointers.  No series is held in one row or one task.  Null and NaN scores
    are steps that improve nothing; without a known score best is null, plateau 0.  Null keys are a series.
    """
    value = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    rows = series.select(*keys, F.col(step).alias("_step"), value.alias("_v"))
    counted = running_totals(rows, keys, [F.col("_step")], {"_i": F.lit(1).cast("long")}, task_rows)
    record = running_totals(counted, keys, [F.col("_i")], {}, task_rows, peaks={"_top": F.col("_v")}, inclusive=False)
    record = cut(record.where(F.col("_v").isNotNull() & (F.col("_top").isNull() | (F.col("_v") > F.col("_top")))).select(*keys, "_i", "_v", F.col("_top").isNull().alias("_first")))
    length = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))

    # Read from the highest score down: the last record passed before a probe is the least one above it.
    probes = record.select(*keys, (F.col("_v") + delta).alias("_level"), F.lit(1).alias("_probe"), "_i", F.lit(None).cast("long").alias("_next"))
    marks = record.select(*keys, F.col("_v").alias("_level"), F.lit(2).alias("_probe"), "_i", F.col("_i").alias("_next"))
    line = running_totals(marks.unionByName(probes), keys, [-F.col("_level"), F.col("_probe"), F.col("_i")], {}, task_rows, peaks={"_to": -F.col("_next")})
    jump = cut(line.where("_probe = 1").select(*keys, "_i", (-F.col("_to")).alias("_next")))
    known = [f"_k{i}" for i in range(len(keys))]

    def renamed(df: DataFrame, *names: str) -> DataFrame:
        return df.toDF(*known, *names)

    path = cut(record.where("_first").select(*keys, "_i"))
    leap, before = jump.where("_next is not null"), 0
    while True:  # as many rounds as the longest path has binary digits
        beyond = path.join(renamed(leap, "_from", "_to"), same_keys(keys, known) & (F.col("_i") == F.col("_from"))).select(*keys, F.col("_to").alias("_i"))
        path = cut(path.unionByName(beyond).distinct())
        now = path.count()
        if now == before:
            break
        before = now
        leap = cut(leap.join(renamed(leap, "_from", "_to"), same_keys(keys, known) & (F.col("_next") == F.col("_from"))).select(*keys, "_i", F.col("_to").alias("_next")))

    on_path = path.join(renamed(jump, "_from", "_to"), same_keys(keys, known) & (F.col("_i") == F.col("_from"))).select(*keys, "_i", F.col("_to").alias("_next"))
    on_path = on_path.join(renamed(record.select(*keys, "_i", "_v"), "_from", "_v"), same_keys(keys, known) & (F.col("_i") == F.col("_from"))).select(*keys, "_i", "_next", "_v")
    wait = F.max(F.col("_next") - F.col("_i") - 1)
    ends = on_path.groupBy(*keys).agg(F.max("_v").alias("_best"), F.max("_i").alias("_last"), wait.alias("_wait"))
    out = length.join(renamed(ends, "_best", "_last", "_wait"), same_keys(keys, known), "left")
    plateau = F.coalesce(F.col("_n") - F.col("_last"), F.lit(0))
    return out.select(*keys, F.col("_best").alias("best"), plateau.cast("int").alias("plateau"),
                      (F.greatest(plateau, F.coalesce("_wait", F.lit(0))) >= patience).alias("stopped"))


def incremental_auc(series: DataFrame, keys: Sequence[str], step: str, auc: str) -> DataFrame:
    """n*C(n) - (n-1)*C(n-1): the AUC of the latest interval behind a cumulative one."""
    w = Window.partitionBy(*keys).orderBy(step)
    n = F.row_number().over(w)
    return series.withColumns({"_n": n, "_prev": F.lag(auc).over(w)}).withColumn(
        "auc_adjusted", F.col("_n") * F.col(auc) - (F.col("_n") - 1) * F.col("_prev")).drop("_n", "_prev")
