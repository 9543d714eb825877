"""Sinks: predictions, snapshots named by the content they come from, and the metrics table."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_prediction(df: DataFrame, order: str, user: str = "user_id", prob: str = "prob") -> DataFrame:
    """One probability per user: the last in scan order (a map-side combined aggregate)."""
    return df.groupBy(user).agg(F.max_by(prob, order).alias(prob))


def write_predictions(df: DataFrame, path: str, order: str, fmt: str = "json") -> None:
    last_prediction(df, order).write.mode("overwrite").format(fmt).save(path)


# --- snapshots ----------------------------------------------------------------------------------

def row_set_digest(df: DataFrame, key: str) -> DataFrame:
    """Order-free identity of a row set: count, sum of keys (modulo 2^63), xor of keys and of key hashes."""
    total = F.coalesce(F.sum(F.col(key).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), (total % F.lit(str(2**63)).cast("decimal(20,0)")).cast("long").alias("key_sum"),
        F.coalesce(F.bit_xor(key), F.lit(0)).alias("key_xor"),
        F.coalesce(F.bit_xor(F.xxhash64(key)), F.lit(0)).alias("hash_xor"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of the parquet files of a folder; their content is not read."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.parquet")
    return files.load(path).select("path", "length", "modificationTime")


def content_identity(tables: Mapping[str, DataFrame], settings: Mapping | None = None) -> DataFrame:
    """(part, rows, digest) per named table, from all values of all its rows in any order.

    ``settings`` adds a part of its own and must be plain JSON.  Fitted state goes in as its tables,
    so a refit that changes one number is another identity.
    """
    spark = next(iter(tables.values())).sparkSession
    text = json.dumps(dict(settings or {}), sort_keys=True)
    out = spark.range(1).select(F.lit("settings").alias("part"), F.lit(1).cast("long").alias("rows"), F.sha2(F.lit(text), 256).alias("digest"))
    for name, df in tables.items():
        two = df.select(*[F.xxhash64(*extra, *[F.col(f"`{c}`") for c in sorted(df.columns)]).alias(h) for h, extra in (
            ("h", []), ("g", [F.lit(name)]))])
        sums = [F.coalesce(F.sum(F.col(h).cast("decimal(20,0)")), F.lit(0)).cast("string") for h in "hg"]
        out = out.unionByName(two.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", *sums).alias("digest")).select(
            F.lit(f"table {name}").alias("part"), "rows", "digest"))
    return out


def identity_key(identity: DataFrame) -> str:
    """One name for all parts (their number is that of the tables given)."""
    part = F.concat_ws("=", "part", F.col("rows").cast("string"), "digest")
    return identity.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(part))), 256)).first()[0][:32]


class SnapshotStore:
    """Rows written once per identity: ``data/<key>``, and one line per snapshot in ``manifest``.

    A snapshot counts when Spark has marked its write as whole.  Beside the one just written the
    ``keep_last`` newest stay.
    """

    def __init__(self, spark: SparkSession, root: str, keep_last: int = 3) -> None:
        self.spark, self.root, self.keep_last = spark, root.rstrip("/"), max(1, keep_last)

    def _folder(self, key: str) -> str:
        return f"{self.root}/data/{key}"

    def _at(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def find(self, key: str) -> str | None:
        files, mark = self._at(f"{self._folder(key)}/_SUCCESS")
        return self._folder(key) if files.exists(mark) else None

    def load_or_write(self, identity: DataFrame, rows: DataFrame) -> DataFrame:
        key = identity_key(identity)
        if not self.find(key):
            rows.write.mode("overwrite").parquet(self._folder(key))
            line = identity.agg(F.collect_list(F.struct("part", "rows", "digest")).alias("parts"))
            line.select(F.lit(key).alias("key"), F.lit(time.time()).alias("written_at"), "parts").write.mode("append").parquet(
                f"{self.root}/manifest")
            for old in self.expired():
                files, folder = self._at(self._folder(old))
                files.delete(folder, True)
        return self.spark.read.parquet(self._folder(key))

    def expired(self) -> list[str]:
        """Keys behind the newest and the ``keep_last`` before it."""
        lines = self.spark.read.parquet(f"{self.root}/manifest").groupBy("key").agg(F.max("written_at").alias("written_at"))
        return [r["key"] for r in lines.orderBy(F.desc("written_at"), "key").offset(self.keep_last + 1).collect()]


# --- metrics ------------------------------------------------------------------------------------

def append_metrics(spark: SparkSession, path: str, metrics: Mapping, step: int, at: float | None = None) -> None:
    """One row per number of a nested mapping, under its names joined by ``/``; anything else is left out."""
    flat = next(iter(pd.json_normalize(dict(metrics), sep="/").to_dict("records")), {})
    at = time.time() if at is None else at
    rows = [(k, step, float(v), at) for k, v in flat.items() if isinstance(v, (bool, int, float))]
    spark.createDataFrame(rows, "key string, step long, value double, ts double").write.mode("append").parquet(path)


def latest_metrics(df: DataFrame, keys: tuple[str, ...] = ("key", "step"), at: str = "ts", value: str = "value") -> DataFrame:
    """Upsert view: the last value written per key and step, as one combinable aggregate."""
    return df.groupBy(*keys).agg(F.max_by(value, at).alias(value))
