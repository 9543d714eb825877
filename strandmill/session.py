"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "strandmill", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; cluster managers normally supply ``master`` and sizing themselves."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Recording the Python call site of every column costs more than building the column, and the
    # large feature expressions here are generated, so their call sites would say nothing.
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the run-time setting that results depend on (UTC seconds)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else one of our own (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        configured = tempfile.mkdtemp(prefix="strandmill-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
