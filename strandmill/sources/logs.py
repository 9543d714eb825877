"""Text-log ingestion: diagnostic lines, tuning trials and timing reports as table jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators.ranking import TASK_ROWS, running_totals


ORDER = ("block", "line_no")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, block, line_no, line) of text files, splittable.

    ``block`` is the byte offset of the input split and ``line_no`` rises inside it, so the two
    together give the order of lines in a file without reading it in one task.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def context_value(context: Column, name: str) -> Column:
    """Whole number behind the last ``name=`` of a comma-separated context."""
    return F.regexp_extract(context, rf"^(?:.*,)?{name}=([^,]*)", 1).try_cast("long")


def after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``."""
    return F.substring(text, F.instr(text, mark) + len(mark), F.length(text))


def diagnostic_events(lines: DataFrame, order: Sequence[str] = ORDER, file: str = "file_path") -> DataFrame:
    """Split ``DIAG|EVENT|context;;CODE:payload;;...`` lines into one row per code segment.

    Text before ``DIAG|`` (a logging prefix) is ignored; lines without a context are skipped.
    """
    tail = after(F.col("line"), "DIAG|")
    found = lines.where((F.instr("line", "DIAG|") > 0) & (F.instr(tail, "|") > 0))
    return found.select(file, *order, F.substring_index(tail, "|", 1).alias("event"), after(tail, "|").alias("_rest"))


def diagnostic_metrics(
    lines: DataFrame, order: Sequence[str] = ORDER, file: str = "file_path", task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(file, experiment, event, epoch, step, code, key, text, value) rows.

    A PREAMBLE after a CONFIG opens the next experiment of its file; the experiment number is a
    running count, so long logs are cut into slices like any other large group.
    """
    events = diagnostic_events(lines, order, file)
    run = running_totals(events, [file], [F.col(c) for c in order], {
        "_configs": (F.col("event") == "CONFIG").cast("long"),
        "_preambles": (F.col("event") == "PREAMBLE").cast("long")}, task_rows=task_rows)
    # Configs seen so far tell which experiment a PREAMBLE belongs to; the lines after follow it.
    starts = run.where(F.col("event") == "PREAMBLE").select(file, "_preambles", F.col("_configs").alias("_at"))
    numbered = run.where(F.col("event") != "CONFIG").join(starts, [file, "_preambles"], "left")
    split = numbered.where(F.instr("_rest", ";;") > 0).select(
        file, *order, F.coalesce("_at", F.lit(0)).alias("experiment"), "event",
        F.substring_index("_rest", ";;", 1).alias("_context"), F.explode(F.split(after(F.col("_rest"), ";;"), ";;")).alias("_seg"))
    coded = split.where(F.instr("_seg", ":") > 0).select(
        file, *order, "experiment", "event", F.substring_index("_seg", ":", 1).alias("code"),
        context_value(F.col("_context"), "epoch").alias("epoch"), context_value(F.col("_context"), "step").alias("step"),
        F.explode(F.split(after(F.col("_seg"), ":"), ",")).alias("_kv"))
    rows = coded.where(F.instr("_kv", "=") > 0)
    text = after(F.col("_kv"), "=")
    return rows.select(
        file, *order, "experiment", "event", "code", "epoch", "step", F.substring_index("_kv", "=", 1).alias("key"),
        text.alias("text"), text.try_cast("double").alias("value"))


TRIAL = r"TUNE\|TRIAL_END\|trial=(\d+),auc=([\d.]+),best_so_far=[\d.]+;;PARAMS:(\{.*\})"
STUDY = r"TUNE\|START\|study=([^,\s]+)"


def tuning_trials(lines: DataFrame, file: str = "file_path", order: Sequence[str] = ORDER) -> DataFrame:
    """(study, number, value, params JSON) per finished trial; the study is the file's first START."""
    studies = lines.withColumn("_s", F.regexp_extract("line", STUDY, 1)).where(F.col("_s") != "").groupBy(file).agg(
        F.min_by("_s", F.struct(*order)).alias("study"))
    hits = lines.where(F.col("line").rlike(TRIAL)).select(
        file, F.regexp_extract("line", TRIAL, 1).cast("long").alias("number"),
        F.regexp_extract("line", TRIAL, 2).cast("double").alias("value"),
        F.regexp_extract("line", TRIAL, 3).alias("params"))
    return hits.join(studies, file, "left").select(
        file, F.coalesce("study", F.lit("tune")).alias("study"), "number", "value", "params")


def throughput_report(metrics: DataFrame, keys: tuple[str, ...] = ("experiment",)) -> DataFrame:
    """Averaged step timings of PERF rows (samples, data_s, fwd_s, bwd_s, total_s)."""
    wide = metrics.groupBy(*keys).agg(*[
        F.avg(F.when(F.col("key") == k, F.col("value"))).alias(f"_{k}")
        for k in ("samples", "data_s", "fwd_s", "bwd_s", "total_s")])
    t = F.col("_total_s")
    return wide.select(
        *keys, F.when(t > 0, F.col("_samples") / t).otherwise(0.0).alias("sps"),
        F.when(t > 0, 1.0 / t).otherwise(0.0).alias("st_ps"),
        F.col("_data_s").alias("data_s"), F.col("_fwd_s").alias("fwd_s"), F.col("_bwd_s").alias("bwd_s"),
        F.greatest(F.lit(0.0), t - F.col("_data_s") - F.col("_fwd_s") - F.col("_bwd_s")).alias("misc_s"),
        t.alias("total_s"))
