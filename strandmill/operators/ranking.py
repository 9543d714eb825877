"""Ordered aggregates that stay distributed: running totals, ranks, exact quantiles.

Every function first checks how large its largest ordering group is.  Groups that fit one task use
a plain window.  Beyond ``task_rows`` the rows are range-partitioned by key and whole order tuple,
numbered inside those slices in parallel, and shifted by the totals of the slices before.  Both ways
give the same answer, nulls, NaN and ties included: a null key is a group, nulls order first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.session import cut

TASK_ROWS = 1_000_000
#: Rows of the offsets (one per slice at most) that may be broadcast.
BROADCAST_SLICES = 100_000


def _keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows, rows of the largest group); one aggregate job with map-side combine."""
    if not keys:
        n = df.count()
        return n, n
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    row = counts.agg(F.sum("_n").alias("n"), F.max("_n").alias("m")).first()
    return int(row["n"] or 0), int(row["m"] or 0)


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: int) -> DataFrame:
    """``df`` with ``_slice``, which never decreases along (keys, order).

    Range bounds come from samples and differ from run to run, so the dealt rows are written down
    before their slice is used twice.
    """
    dealt = df.repartitionByRange(slices, *_keys(keys), *order)
    return cut(dealt.withColumn("_slice", F.spark_partition_id()))


def same_keys(keys: Sequence[str], others: Sequence[str]) -> Column:
    """Null-safe equality of two lists of columns; true for empty lists."""
    out = F.lit(True)
    for k, o in zip(keys, others, strict=True):
        out = out & F.col(k).eqNullSafe(F.col(o))
    return out


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    task_rows: int = TASK_ROWS,
    sizes: tuple[int, int] | None = None,
    peaks: Mapping[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums (``totals``) and running maxima (``peaks``, nulls left out) per key in the given total order.

    The row itself counts, unless ``inclusive`` is false.  ``sizes`` are known upper bounds of (rows, rows of the
    largest group), which save the counting job.  The slices cut hot values too, as long as the order tuple tells
    their rows apart.
    """
    n, largest = sizes if sizes is not None else group_sizes(df, keys)
    part = Window.partitionBy(*_keys(keys))
    last = Window.currentRow if inclusive else -1
    made = {name: (F.sum, col) for name, col in totals.items()} | {name: (F.max, col) for name, col in (peaks or {}).items()}
    if largest <= task_rows:
        w = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumns({name: agg(col).over(w) for name, (agg, col) in made.items()})

    slices = 2 * (n // max(task_rows, 1) + 1)
    work = _sliced(df.withColumns({f"_v_{name}": col for name, (_, col) in made.items()}), keys, order, slices)
    per_slice = work.groupBy(*keys, "_slice").agg(*[agg(f"_v_{name}").alias(f"_s_{name}") for name, (agg, _) in made.items()])
    before = part.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # A slice begins inside one group at most, so only that group of it has an offset.
    known = [f"_k{i}" for i in range(len(keys))]
    offsets = per_slice.select(
        *[F.col(k).alias(o) for k, o in zip(keys, known, strict=True)], F.col("_slice").alias("_at"),
        F.count(F.lit(1)).over(before).alias("_earlier"),
        *[agg(f"_s_{name}").over(before).alias(f"_o_{name}") for name, (agg, _) in made.items()],
    ).where("_earlier > 0").drop("_earlier")
    if slices <= BROADCAST_SLICES:
        offsets = F.broadcast(offsets)
    joined = work.join(offsets, (F.col("_slice") == F.col("_at")) & same_keys(keys, known), "left")
    inside = Window.partitionBy(*_keys(keys), F.col("_slice")).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    values = {}
    for name, (agg, _) in made.items():
        own, earlier = agg(f"_v_{name}").over(inside), F.col(f"_o_{name}")
        values[name] = F.coalesce(own + earlier, own, earlier) if agg is F.sum else F.greatest(own, earlier)
    out = joined.withColumns(values)
    return out.drop("_slice", "_at", *known, *[f"_{x}_{name}" for x in "vo" for name in made])


def global_rank(
    df: DataFrame, order: Sequence[Column], name: str = "rank", keys: Sequence[str] = (),
    task_rows: int = TASK_ROWS, sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """1-based rank over the whole table (or per key) in a total order."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")}, task_rows, sizes)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles per key, one column per named probability.

    Null values do not count; NaN is the largest value.
    Small groups use the built-in ``percentile``; larger ones find the two bracketing values of each
    quantile by rank over the distinct values, so no task ever holds a whole group.
    """
    # Adding zero makes one value of both zeros, as grouping does.
    clean = df.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_x")).where(F.col("_x").isNotNull())
    n, largest = group_sizes(clean, keys)
    names = list(probs)
    if largest <= task_rows:
        grid = F.percentile("_x", F.array(*[F.lit(float(probs[k])) for k in names]))
        out = clean.groupBy(*keys).agg(grid.alias("_q"))
        return out.select(*keys, *[F.get("_q", F.lit(i)).alias(k) for i, k in enumerate(names)])

    hist = cut(clean.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")))
    return counted_quantiles(hist, keys, "_x", "_c", probs, task_rows)


def counted_quantiles(
    hist: DataFrame, keys: Sequence[str], value: str, count: str, probs: Mapping[str, float],
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``exact_quantiles`` of values that are counted already: one row per key and distinct value (not null)."""
    hist, names = hist.select(*keys, F.col(value).alias("_x"), F.col(count).alias("_c")), list(probs)
    known = [f"_k{i}" for i in range(len(keys))]
    ranked = running_totals(hist, keys, [F.col("_x")], {"_upto": F.col("_c")}, task_rows=task_rows)
    if keys:
        sizes = hist.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, known, strict=True)]).agg(F.sum("_c").alias("_n"))
        ranked = ranked.join(sizes, same_keys(keys, known)).drop(*known)
    else:
        ranked = ranked.withColumn("_n", F.lit(hist.agg(F.sum("_c")).first()[0]).cast("long"))
    first = F.col("_upto") - F.col("_c")

    def at(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index < F.col("_upto")), F.col("_x")))

    aggs = []
    for k in names:
        pos = F.lit(float(probs[k])) * (F.col("_n") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo_{k}"), at(F.ceil(pos)).alias(f"_hi_{k}"),
                 F.max(pos - F.floor(pos)).alias(f"_f_{k}")]
    out = ranked.groupBy(*keys).agg(*aggs)
    lo, hi, part = ({k: F.col(f"_{x}_{k}") for k in names} for x in ("lo", "hi", "f"))
    return out.select(*keys, *[
        F.when(lo[k] == hi[k], lo[k]).otherwise((1.0 - part[k]) * lo[k] + part[k] * hi[k]).alias(k) for k in names])


def quantile_values(df: DataFrame, value: str, probs: Sequence[float], task_rows: int = TASK_ROWS) -> list[float]:
    """Exact quantiles of a whole column as driver numbers (one row, bounded by ``len(probs)``)."""
    named = {f"q{i}": p for i, p in enumerate(probs)}
    row = exact_quantiles(df, [], value, named, task_rows).first()
    return [] if row is None or row[0] is None else [float(row[k]) for k in named]


def keep_first(
    df: DataFrame, order: Sequence[Column], n: Column | int, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """The first ``n`` rows in a total order, without ordering the table in one task."""
    ranked = global_rank(df, order, "_rank", (), task_rows)
    return ranked.where(F.col("_rank") <= n).drop("_rank")
