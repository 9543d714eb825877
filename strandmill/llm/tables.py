"""Reading the given tables, cutting lineage in the shared folder, and numbering rows in even slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows a task orders at most, on average; the slice count follows from the row count.
SLICE_ROWS = 20_000
#: Rows of (at most three) numbers that may be broadcast: some tens of megabytes.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is set (tests on one machine) one is made."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="strandmill-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and go on from there."""
    _shared(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables written in the shared folder, to be dropped as soon as the tables made from them are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.held = spark, f"{_shared(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.held)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.held[id(df)][1])
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.held[id(df)] = (df, "")


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow side for broadcast if its counted rows are within the bound; else it shuffles."""
    return F.broadcast(df) if rows <= most else df


def slice_of(order: Column, slices: int) -> Column:
    """Slice of an md5 hex string: its leading digits cut evenly, so slices follow the order."""
    lead = F.conv(F.substring(order, 1, 8), 16, 10).cast("long")
    return F.floor(lead * F.lit(slices) / F.lit(1 << 32)).cast("long")


def spread_repeats(df: DataFrame, order: str, rows: int) -> DataFrame:
    """``df`` with new md5 strings in ``order`` for the rows of any value that repeats more often than a slice is long.

    Such rows would stand in one slice and one task; they are alike, so any order of them will do.  One aggregate of slice
    sizes shows whether there can be such a value at all; if so, the dealt rows are written down before use.
    """
    slices = rows // SLICE_ROWS + 1
    at = slice_of(F.col(order), slices)
    full = df.groupBy(at.alias("_k_slice")).agg(F.count(F.lit(1)).alias("_k_n")).where(F.col("_k_n") > 2 * SLICE_ROWS).drop("_k_n")
    full = cut(full)
    if full.isEmpty():
        return df
    hot = df.select(order, at.alias("_k_slice")).join(small(full, slices), "_k_slice").groupBy(F.col(order).alias("_k_hot")).agg(
        F.count(F.lit(1)).alias("_k_n")).where(F.col("_k_n") > SLICE_ROWS).drop("_k_n")
    met = df.join(small(cut(hot), slices), F.col(order) == F.col("_k_hot"), "left")
    fresh = F.md5(F.concat_ws("|", order, F.monotonically_increasing_id()))
    return cut(met.withColumn(order, F.when(F.col("_k_hot").isNotNull(), fresh).otherwise(F.col(order))).drop("_k_hot"))


def running(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[Column], totals: dict[str, str], rows: int, groups: int = 1) -> DataFrame:
    """Totals of the rows before each row, per key, in the order of an md5 column.

    Slices of the hash are ordered apart and shifted by the totals of the slices before them, so a
    key with a third of all rows is spread over tasks.  ``totals`` maps new columns to summed ones,
    ``groups`` bounds the number of keys: with the slices it tells whether the shifts may be broadcast.
    """
    slices = rows // SLICE_ROWS + 1
    work = df.withColumn("_slice", slice_of(F.col(order), slices))
    own = work.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    upto = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = own.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_k_slice"), *[
        F.coalesce(F.sum(f"_t_{n}").over(upto), F.lit(0)).alias(f"_o_{n}") for n in totals])
    same = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = work.join(small(shift, slices * groups), same, "left").withColumns({
        n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{n}") for n, c in totals.items()})
    return out.drop("_slice", "_k_slice", *[f"_k_{k}" for k in keys], *[f"_o_{n}" for n in totals])
