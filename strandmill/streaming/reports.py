"""Running reports on an event stream.

Each builder maps a streaming (or batch) DataFrame to the report's DataFrame, so the batch plan is
the test of the stream.  Late rows beyond the watermark are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.session import shared_dir


def label_rates(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Label rate and per-class loss per event-time window (columns event_time, label, loss)."""
    y = F.col("label").cast("double")
    out = stream.withWatermark("event_time", delay).groupBy(F.window("event_time", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"), F.avg(y).alias("label_rate"),
        F.avg(F.when(F.col("label") > 0.5, F.col("loss"))).alias("loss_pos"),
        F.avg(F.when(F.col("label") <= 0.5, F.col("loss"))).alias("loss_neg"))
    return out.select(F.unix_seconds("w.start").alias("window_start"), "n", "pos", "label_rate", "loss_pos", "loss_neg")


def score_histogram(stream: DataFrame, bins: int = 1000, window: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Class counts and prediction sums per window and probability bin: all AUC and calibration need."""
    bin_ = F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1))
    out = stream.withWatermark("event_time", delay).groupBy(
        F.window("event_time", window).alias("w"), bin_.alias("bin")).agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"), F.sum("prob").alias("prob_sum"))
    return out.select(F.unix_seconds("w.start").alias("window_start"), "bin", "pos", "neg", "prob_sum")


def auc_from_histogram(hist: DataFrame) -> DataFrame:
    """Per window: AUC with ties inside a bin, and calibration sums.  At most ``bins`` rows a window."""
    from pyspark.sql import Window

    below = Window.partitionBy("window_start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rows = hist.withColumn("_b", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    out = rows.groupBy("window_start").agg(
        F.sum(F.col("pos").cast("double") * (F.col("_b") + F.col("neg") / 2.0)).alias("_won"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("prob_sum").alias("_p"))
    n = F.col("pos") + F.col("neg")
    return out.select(
        "window_start", "pos", "neg",
        F.coalesce(F.try_divide(F.col("_won"), F.col("pos").cast("double") * F.col("neg")), F.lit(0.5)).alias("auc"),
        (F.col("_p") / n).alias("mean_pred"), (F.col("pos") / n).alias("actual_rate"))


def user_sessions(stream: DataFrame, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Event counts per user session (columns event_time, user_id)."""
    out = stream.withWatermark("event_time", delay).groupBy(
        "user_id", F.session_window("event_time", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.unix_micros("s.start").alias("session_start"), F.unix_micros("s.end").alias("session_end"), "n")


def counts_per_second(stream: DataFrame, keep: str = "7 days") -> DataFrame:
    """Per-user event counts per second: the state behind live recency counters.

    Whole seconds are the grain of all thresholds, so the counters are exact.  The built-in windowed aggregate combines
    rows before the shuffle and spreads a user's seconds over all tasks; state older than the longest window expires.
    """
    out = stream.withWatermark("event_time", keep).groupBy(
        "user_id", F.window("event_time", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.unix_seconds("w.start").alias("second"), "n")


def recency_counters(seconds: DataFrame, windows: Sequence[int] = (3600, 86400, 604800)) -> DataFrame:
    """Events at most each window's seconds older than the user's newest event, that event included."""
    top = seconds.groupBy("user_id").agg(F.max("second").alias("newest"))
    age = F.col("newest") - F.col("second")
    return seconds.join(top, seconds["user_id"].eqNullSafe(top["user_id"])).drop(top["user_id"]).groupBy("user_id", "newest").agg(
        F.sum("n").alias("n_events"),
        *[F.coalesce(F.sum(F.when(age <= w, F.col("n"))), F.lit(0)).alias(f"n_t{i}") for i, w in enumerate(windows)])


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream; its schema comes from the files already there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if path.endswith(".parquet"):
        folder, name = path.rsplit("/", 1)
        reader, path = reader.option("pathGlobFilter", name), folder
    return reader.parquet(path)


def run_available(
    spark: SparkSession, report: DataFrame, mode: str = "append", keys: Sequence[str] = (),
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run a report over everything available and return its table.

    Batches are written to the shared folder with their number.  In update mode the view keeps the
    newest row per key; a batch that is retried replaces its own folder, so results stay exact.
    """
    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(
            f"{root}/rows/b={number}")

    query = report.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(
        availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    rows = spark.read.parquet(f"{root}/rows").drop("b")
    if mode == "update" and keys:
        values = [c for c in rows.columns if c not in (*keys, "_batch")]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")
    else:
        rows = rows.drop("_batch")
    return transform(rows) if transform else rows
