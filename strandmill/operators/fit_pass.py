"""Fitted statistics of many blocks from one scan of the training rows.

A statistic is an array of tagged entries per row.  All entries go through one aggregate, combined map-side, whose table
is written to the shared folder; every state is then derived from its slice of that table and never from the rows again.
An entry has a value (category, item, bin or vector position), a number (quantiles only) and a place (first-seen only);
the aggregate keeps how often each occurs and the first place.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import arrays as A
from strandmill.operators import fit as fits
from strandmill.operators.ranking import TASK_ROWS, counted_quantiles
from strandmill.session import shared_dir

ENTRY = "struct<stat:string,value:bigint,x:double,place:struct<o:bigint,p:int,target:bigint>>"


def _entry(name: str, value: Column, x: Column | None = None, place: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("stat"), value.cast("long").alias("value"), (F.lit(None) if x is None else x).alias("x"),
        (F.lit(None) if place is None else place).alias("place")).cast(ENTRY)


def value_entries(name: str, column: str, vocab: int, is_list: bool = False) -> Column:
    """Ids in [0, vocab); those of a list once per row."""
    ids = F.array_distinct(F.col(column).cast("array<bigint>")) if is_list else F.array(F.col(column).cast("long"))
    return F.transform(F.filter(ids, lambda v: (v >= 0) & (v < vocab)), lambda v: _entry(name, v))


def number_entries(name: str, column: str, dim: int, kind: str | None = None) -> Column:
    """One number per vector position, zeros where the vector is null or short."""
    # Adding zero makes one value of both zeros, as grouping does.
    return F.transform(A.fit_vector(F.col(column), dim), lambda v, i: _entry(name, i, fits.pre_transform(v, kind) + F.lit(0.0)))


def bin_entries(name: str, column: str, width: int) -> Column:
    return F.filter(F.array(_entry(name, F.floor(F.col(column) / width))), lambda e: e["value"].isNotNull())


def first_entries(name: str, domain: str, source: str, target: str, order: str) -> Column:
    """(item, target) of the events where both are positive, at their place in (row order, position)."""
    made = F.transform(domain, lambda e, i: _entry(name, e[source], place=F.struct(
        F.col(order).cast("long").alias("o"), i.alias("p"), e[target].cast("long").alias("target"))))
    return F.filter(made, lambda e: e["value"] > 0)


def gather(train: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
    """The written table of all statistics: (stat, value, x, n, place); sorted by statistic, so a reader skips the rest.

    ``place`` is the first one with a positive target, null if no place has one.
    """
    nothing = F.array().cast(f"array<{ENTRY}>")
    # An inner inline would have all entries made again in a filter for empty arrays.
    rows = train.select(F.inline_outer(F.concat(nothing, *[F.coalesce(p, nothing) for p in parts.values()]))).where(F.col("stat").isNotNull())
    found = rows.groupBy("stat", "value", "x").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("place.target") > 0, F.col("place"))).alias("place"))
    path = f"{shared_dir(train.sparkSession).rstrip('/')}/fit-{uuid.uuid4().hex}"
    found.sortWithinPartitions("stat").write.parquet(path)
    return train.sparkSession.read.schema(found.schema).parquet(path)


def value_counts(part: DataFrame, feature: str) -> DataFrame:
    return part.select(F.lit(feature).alias("feature"), "value", "n")


def scaler(part: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``dim``, ``median``, ``scale`` as ``robust_scaler_fit`` gives them."""
    numbers = part.where(F.col("x").isNotNull()).select(F.col("value").cast("int").alias("dim"), "x", "n")
    q = counted_quantiles(numbers, ["dim"], "x", "n", {"q25": 0.25, "q50": 0.5, "q75": 0.75, "lo": 0.0, "hi": 1.0}, task_rows)
    return fits.scale_of(q)


def first_targets(parts: Mapping[str, DataFrame], source: str) -> DataFrame:
    """One row per item with the first positive target of each part."""
    tagged = None
    for target, part in parts.items():
        rows = part.select(F.col("value").alias(source), F.lit(target).alias("_k"), F.col("place.target").alias("_t"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.groupBy(source).agg(*[F.max(F.when(F.col("_k") == t, F.col("_t"))).alias(t) for t in parts])


def slices(table: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: table.where(F.col("stat") == n).drop("stat") for n in names}
