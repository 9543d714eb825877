"""Sample tables derived from the driver tables (see FIXTURES.md, section 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import scalars as S
from strandmill.operators.history import attach_histories
from strandmill.session import prepare

DOMAINS = ["seq_a", "seq_b", "seq_c", "seq_d"]
# Event type of each sequence domain; the action id is the position.
DOMAIN_EVENTS = {"seq_a": "click", "seq_b": "signup", "seq_c": "purchase", "seq_d": "error"}
PAYLOAD = ["ts", "action", "item", "category", "campaign", "advertiser"]
CEILING = 64
ORDER_CEILING = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Floored unix seconds of a driver timestamp (read as TIMESTAMP_NTZ)."""
    return F.unix_seconds(F.col(column).cast("timestamp"))


def item_side(item):
    return {
        "category": item % 10 + 1,
        "campaign": item % 20 + 1,
        "advertiser": item % 7 + 1,
    }


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with seconds, item and item attributes."""
    item = F.get_json_object("props", "$.k").cast("long") + 1
    base = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", seconds("ts").alias("ts"), item.alias("item"))
    return base.withColumns(item_side(F.col("item")))


def domain_events(log: DataFrame) -> DataFrame:
    domain = F.create_map(*[F.lit(x) for d, e in DOMAIN_EVENTS.items() for x in (e, d)])
    action = F.create_map(*[x for i, e in enumerate(DOMAIN_EVENTS.values(), 1) for x in (F.lit(e), F.lit(i).cast("long"))])
    wanted = F.col("event_type").isin(*DOMAIN_EVENTS.values())
    return log.where(wanted).select(
        "user_id", F.get(F.array(domain[F.col("event_type")]), F.lit(0)).alias("domain"),
        "ts", "event_id", action[F.col("event_type")].alias("action"),
        "item", "category", "campaign", "advertiser")


def impressions(log: DataFrame) -> DataFrame:
    """One row per view event."""
    return log.where(F.col("event_type") == "view").select(
        F.col("event_id").alias("sample_id"), "ts", "user_id", F.col("item").alias("item_id"),
        "category", "campaign", "advertiser", F.col("value").alias("score"))


def samples_from_events(spark: SparkSession, sf_dir: str, ceiling: int = CEILING) -> DataFrame:
    """Wide sample table: impression, label, score and four histories.

    The label is 1 if the same user purchases within a day after the impression.
    """
    log = event_log(spark, sf_dir)
    wide = attach_histories(
        impressions(log), domain_events(log), ["user_id"], DOMAINS, PAYLOAD, ceiling,
        tie=F.col("event_id"),
        extra_probes={"after": F.col("ts") + 1, "day": F.col("ts") + S.DAY + 1},
    )
    label = (F.col("day_seq_c") > F.col("after_seq_c")).cast("long")
    scored = wide.withColumn("label", label).drop(
        *[f"{p}_{d}" for p in ("after", "day") for d in DOMAINS])
    return with_predictions(scored)


def with_predictions(df: DataFrame) -> DataFrame:
    """logit, prob and loss of the driver score column."""
    return df.withColumn("logit", (F.col("score") - 50.0) / 50.0).withColumns({
        "prob": S.sigmoid(F.col("logit")),
        "loss": S.bce_with_logits(F.col("logit"), F.col("label")),
    })


def orders_as_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("user_id"),
        seconds("o_orderdate").alias("ts"))


def lines_as_events(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Line items of the given orders as events with all columns of their order; ``line`` breaks the ties of day-grained times.

    Rows that agree on ``line`` have the same payload, so the other columns cannot matter.
    """
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("advertiser"),
        F.size(F.array_distinct(F.split("p_type", ""))).cast("long").alias("category"))
    lines = table(spark, sf_dir, "lineitem").join(
        orders.withColumnRenamed("sample_id", "l_orderkey"), "l_orderkey").join(part, "l_partkey")
    return lines.select(
        *[c for c in orders.columns if c != "sample_id"], F.lit("seq_a").alias("domain"),
        F.col("l_quantity").cast("long").alias("action"), F.col("l_partkey").alias("item"),
        "category", (F.col("l_suppkey") % 20 + 1).alias("campaign"), "advertiser",
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").alias("line"))


def order_log_sizes(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Upper bounds of (orders + line items, those of the largest customer), from the keys alone."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("_lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left")
    per = orders.groupBy("o_custkey").agg(F.sum(1 + F.coalesce("_lines", F.lit(0))).alias("_n"))
    row = per.agg(F.sum("_n").alias("n"), F.max("_n").alias("m")).first()
    return int(row["n"] or 0), int(row["m"] or 0)


def samples_from_orders(spark: SparkSession, sf_dir: str, ceiling: int = ORDER_CEILING) -> DataFrame:
    """One sample per order; the history is the customer's line items of earlier orders.

    Order dates have day grain, so equal timestamps are common; line items break the ties.
    """
    orders = orders_as_impressions(spark, sf_dir)
    events = lines_as_events(spark, sf_dir, orders)
    return attach_histories(
        orders, events, ["user_id"], ["seq_a"], PAYLOAD, ceiling, tie=F.col("line"), sizes=order_log_sizes(spark, sf_dir))
