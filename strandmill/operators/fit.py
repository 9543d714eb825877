"""Statistics fitted on the training rows and their application."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import arrays as A
from strandmill.functions import scalars as S
from strandmill.operators.ranking import TASK_ROWS, exact_quantiles

# A lookup side is broadcast only when a count shows at most this many rows.
BROADCAST_ROWS = 500_000
PRE_TRANSFORMS = (None, "log1p", "asinh")


def bounded_join(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join that broadcasts ``small`` only after counting it; otherwise both sides shuffle.

    In the shuffled form AQE splits skewed keys of the large side, whose other side has one row
    per key.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return df.join(small, list(on), how)


def pre_transform(x: Column, kind: str | None) -> Column:
    if kind not in PRE_TRANSFORMS:
        raise ValueError(f"pre_transform must be one of {PRE_TRANSFORMS}")
    if kind == "log1p":
        return F.log1p(F.greatest(x, F.lit(0.0)))
    return F.asinh(x) if kind == "asinh" else x


# --- robust scaling -----------------------------------------------------------------------------

def robust_scaler_fit(
    df: DataFrame, column: str, dim: int, kind: str | None = None, approx: bool = False,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """One row per vector position: ``dim``, ``median``, ``scale``.

    Exact quantiles by default; ``approx`` sketches all positions in one pass without exploding.
    """
    vec = A.fit_vector(F.col(column), dim)
    if approx:
        named = df.select(vec.alias("v")).agg(*[
            F.struct(
                F.percentile_approx(pre_transform(F.get("v", F.lit(i)), kind), [0.25, 0.5, 0.75], 100_000).alias("q"),
                F.min(pre_transform(F.get("v", F.lit(i)), kind)).alias("lo"),
                F.max(pre_transform(F.get("v", F.lit(i)), kind)).alias("hi"),
            ).alias(f"d{i}") for i in range(dim)])
        stats = named.select(F.posexplode(F.array(*[f"d{i}" for i in range(dim)])).alias("dim", "s")).select(
            "dim", F.get("s.q", F.lit(0)).alias("q25"), F.get("s.q", F.lit(1)).alias("q50"),
            F.get("s.q", F.lit(2)).alias("q75"), "s.lo", "s.hi")
    else:
        long = df.select(F.posexplode(vec).alias("dim", "x")).withColumn("x", pre_transform(F.col("x"), kind))
        q = exact_quantiles(long, ["dim"], "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, task_rows)
        stats = q.join(long.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi")), "dim")
    return scale_of(stats)


def scale_of(stats: DataFrame) -> DataFrame:
    """``dim``, ``median``, ``scale`` from quartiles and range: the interquartile range, else half the range, else one."""
    eps = 1e-6
    iqr, half = F.col("q75") - F.col("q25"), 0.5 * (F.col("hi") - F.col("lo"))
    return stats.select(
        "dim", F.col("q50").alias("median"),
        F.when(iqr > eps, iqr).when(half > eps, half).otherwise(1.0).alias("scale"))


def state_vector(state: DataFrame, value: str, dim: int) -> list[float]:
    """A fitted per-position statistic as numbers (``dim`` rows, fixed by the schema)."""
    got = {r["dim"]: r[value] for r in state.select("dim", value).collect()}
    return [float(got[i]) for i in range(dim)]


def robust_scale(
    values: Column, median: Sequence[float], scale: Sequence[float], kind: str | None = None, clip: float = 3.0,
) -> Column:
    """z / sqrt(1 + (z / clip)^2) with z = (x - median) / scale."""
    stats = F.arrays_zip(A.double_array(median).alias("m"), A.double_array(scale).alias("s"))
    stats = F.zip_with(A.double_array(median), A.double_array(scale), lambda m, s: F.struct(m.alias("m"), s.alias("s")))

    def one(x: Column, st: Column) -> Column:
        z = (pre_transform(x.cast("double"), kind) - st["m"]) / st["s"]
        return z / F.sqrt(1.0 + (z / clip) * (z / clip))

    return F.zip_with(values, stats, one)


# --- category frequencies -----------------------------------------------------------------------

def category_values(df: DataFrame, scalars: Mapping[str, int], lists: Mapping[str, int]) -> DataFrame:
    """(feature, value) occurrences: scalar values as they are, list values once per row."""
    parts = []
    for name, vocab in scalars.items():
        v = F.col(name).cast("long")
        parts.append(F.when((v >= 0) & (v < vocab), F.array(F.struct(F.lit(name).alias("feature"), v.alias("value")))))
    for name, vocab in lists.items():
        inside = F.filter(F.array_distinct(F.col(name).cast("array<bigint>")), lambda x: (x >= 0) & (x < vocab))
        parts.append(F.transform(inside, lambda x: F.struct(F.lit(name).alias("feature"), x.alias("value"))))
    empty = F.array().cast("array<struct<feature:string,value:bigint>>")
    return df.select(F.inline(F.concat(*[F.coalesce(p, empty) for p in parts])))


def category_counts(df: DataFrame, scalars: Mapping[str, int], lists: Mapping[str, int]) -> DataFrame:
    return category_values(df, scalars, lists).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def frequent_values(counts: DataFrame, min_count: int = 5) -> DataFrame:
    """The values an apply keeps; everything unseen or rarer is zeroed, and 0 is never rare."""
    return counts.where((F.col("n") >= min_count) & (F.col("value") > 0)).select("feature", "value")


def zero_rare_scalars(df: DataFrame, frequent: DataFrame, columns: Mapping[str, int]) -> DataFrame:
    """Zero rare ids in ``(0, vocab)`` of scalar columns (ids outside are left alone)."""
    for name, vocab in columns.items():
        side = frequent.where(F.col("feature") == name).select(F.col("value").alias(name), F.lit(True).alias("_ok"))
        joined = bounded_join(df.withColumn(name, F.col(name).cast("long")), side, [name])
        v = F.col(name)
        rare = (v > 0) & (v < vocab) & F.col("_ok").isNull()
        df = joined.withColumn(name, F.when(rare, F.lit(0).cast("long")).otherwise(v)).drop("_ok")
    return df


def zero_rare_list(df: DataFrame, frequent: DataFrame, name: str, vocab: int, key: str) -> DataFrame:
    """Zero rare ids of a list column: one lookup of the exploded ids, one regrouping by row key.

    A header row per sample carries the other columns (and keeps empty lists); its lookup value is a
    negative number that differs by row, so headers neither match nor pile up on one task.
    """
    others = [c for c in df.columns if c not in (key, name)]
    rest = F.struct(*others)
    blank = F.lit(None).cast(df.select(rest.alias("r")).schema["r"].dataType)
    nobody = -1 - F.pmod(F.xxhash64(key), F.lit(1 << 40))
    header = F.struct(F.lit(-1).alias("_p"), nobody.alias("_v"), rest.alias("_rest"))
    ids = F.transform(F.col(name).cast("array<bigint>"), lambda v, i: F.struct(
        i.alias("_p"), v.alias("_v"), blank.alias("_rest")))
    rows = df.select(key, F.inline(F.concat(F.array(header), ids)))
    side = frequent.where(F.col("feature") == name).select(F.col("value").alias("_v"), F.lit(True).alias("_ok"))
    met = bounded_join(rows, side, ["_v"])
    v = F.col("_v")
    rare = (v > 0) & (v < vocab) & F.col("_ok").isNull()
    kept = met.withColumn("_v", F.when(rare, F.lit(0).cast("long")).otherwise(v))
    grouped = kept.groupBy(key).agg(
        F.any_value("_rest", ignoreNulls=F.lit(True)).alias("_rest"),
        F.sort_array(F.collect_list(F.when(F.col("_p") >= 0, F.struct("_p", "_v")))).alias("_l"))
    return grouped.select(
        key, *[F.col(f"_rest.{c}").alias(c) for c in others], F.transform("_l", lambda s: s["_v"]).alias(name))


# --- first-seen mappings ------------------------------------------------------------------------

def first_seen(df: DataFrame, domain: str, source: str, targets: Sequence[str], order: str) -> DataFrame:
    """item -> first positive partner in (row order, position); one aggregate, combined map-side."""
    rows = df.select(F.col(order).alias("_o"), F.posexplode(domain).alias("_p", "_e")).where(F.col(f"_e.{source}") > 0)
    at = F.struct("_o", "_p")
    return rows.groupBy(F.col(f"_e.{source}").alias(source)).agg(*[
        F.min_by(F.when(F.col(f"_e.{t}") > 0, F.col(f"_e.{t}")),
                 F.when(F.col(f"_e.{t}") > 0, at)).alias(t) for t in targets])


def attach_mapping(df: DataFrame, mapping: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Left lookup with default 0; ``columns`` maps mapping column -> output name."""
    side = mapping.select(key, *[F.col(c).alias(o) for c, o in columns.items()])
    out = bounded_join(df, side, [key])
    return out.withColumns({o: F.coalesce(F.col(o), F.lit(0).cast("long")) for o in columns.values()})


# --- recency weights ----------------------------------------------------------------------------

def recency_weight_fit(
    df: DataFrame, ts: str = "ts", halflife_days: float = 3.0, bin_seconds: int = 3600, normalize: bool = True,
) -> DataFrame:
    """One row: ``ref_ts`` (centre of the newest bin) and ``norm`` (1 / mean weight)."""
    bins = df.groupBy(F.floor(F.col(ts) / bin_seconds).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return recency_weight_of_bins(bins, halflife_days, bin_seconds, normalize)


def recency_weight_of_bins(bins: DataFrame, halflife_days: float = 3.0, bin_seconds: int = 3600, normalize: bool = True) -> DataFrame:
    """``recency_weight_fit`` from the rows ``n`` of each ``bin``."""
    centred = bins.withColumn("c", (F.col("bin") + 0.5) * float(bin_seconds))
    ref = centred.agg(F.max("c")).scalar()
    weighted = centred.withColumns({"_ref": ref, "_w": F.pow(
        F.lit(0.5), F.greatest(ref - F.col("c"), F.lit(0.0)) / (halflife_days * S.DAY))})
    mean = F.sum(F.col("_w") * F.col("n")) / F.sum("n")
    return weighted.agg(
        F.max("_ref").alias("ref_ts"),
        (F.when(mean > 0, 1.0 / mean).otherwise(1.0) if normalize else F.lit(1.0)).alias("norm"))


def recency_weight(ts: Column, ref_ts: float, norm: float, halflife_days: float = 3.0, top: float = 4.0) -> Column:
    age = F.greatest(F.lit(float(ref_ts)) - ts.cast("double"), F.lit(0.0))
    return S.clip(F.pow(F.lit(0.5), age / (halflife_days * S.DAY)) * float(norm), 0.0, top)


# --- state tables -------------------------------------------------------------------------------

def save_state(state: Mapping[str, DataFrame], path: str) -> None:
    """Each fitted table as Parquet under ``path``."""
    for name, df in state.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_state(spark, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
