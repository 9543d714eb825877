"""Query registration and the SQL views the checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandmill.plans import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_SAMPLES: dict[tuple, DataFrame] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same thing, its SQL."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide sample table, materialised once per session and shared by the feature queries.

    Lost blocks are rebuilt from the events; ``j4_build_samples`` runs the build itself.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "events")
    if key not in _SAMPLES:
        _SAMPLES[key] = adapters.samples_from_events(spark, sf_dir).persist()
    return _SAMPLES[key]


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per order; not kept, as its histories are many times the tables they are read from."""
    return adapters.samples_from_orders(spark, sf_dir)


#: The samples of one customer lie in one task, so row operators keyed by both need no shuffle.
ORDER_KEY = ("user_id", "sample_id")


EV = """ev AS (
  SELECT event_id, user_id, event_type, value, floor(epoch(ts))::BIGINT AS ts,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + 1 AS item FROM events),
dev AS (
  SELECT event_id, user_id, ts, item, item % 10 + 1 AS category, item % 20 + 1 AS campaign, item % 7 + 1 AS advertiser,
    CASE event_type WHEN 'click' THEN 'seq_a' WHEN 'signup' THEN 'seq_b' WHEN 'purchase' THEN 'seq_c' ELSE 'seq_d' END AS dom,
    CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS action
  FROM ev WHERE event_type IN ('click', 'signup', 'purchase', 'error'))"""

IMP = EV + """,
imp0 AS (
  SELECT v.event_id AS sample_id, v.ts, v.user_id, v.item AS item_id, v.item % 10 + 1 AS category,
    v.item % 20 + 1 AS campaign, v.item % 7 + 1 AS advertiser, v.value AS score, (v.value - 50.0) / 50.0 AS logit,
    CAST(EXISTS(SELECT 1 FROM ev p WHERE p.user_id = v.user_id AND p.event_type = 'purchase'
      AND p.ts > v.ts AND p.ts <= v.ts + 86400) AS BIGINT) AS label
  FROM ev v WHERE v.event_type = 'view'),
imp AS (
  SELECT *, 1.0 / (1.0 + exp(-greatest(-40.0, least(40.0, logit)))) AS prob,
    greatest(logit, 0.0) + ln(1.0 + exp(-abs(logit))) - logit * label AS loss FROM imp0)"""

HIST = IMP + """,
hist0 AS (
  SELECT i.sample_id, i.ts AS imp_ts, e.dom, e.ts, e.action, e.item, e.category, e.campaign, e.advertiser,
    row_number() OVER (PARTITION BY i.sample_id, e.dom ORDER BY e.ts DESC, e.event_id DESC) AS rev,
    count(*) OVER (PARTITION BY i.sample_id, e.dom) AS raw_len
  FROM imp i JOIN dev e ON e.user_id = i.user_id AND e.ts < i.ts),
hist AS (
  SELECT sample_id, imp_ts, dom, ts, action, item, category, campaign, advertiser, raw_len,
    least(raw_len, 64) - rev AS pos, greatest(imp_ts - ts, 0) AS gap FROM hist0 WHERE rev <= 64),
doms AS (SELECT unnest(['seq_a', 'seq_b', 'seq_c', 'seq_d']) AS dom)"""

#: The same history with every earlier event.
FULL_HIST = IMP + """,
hist AS (
  SELECT i.sample_id, i.ts AS imp_ts, e.dom, e.ts, e.action, e.item, e.category, e.campaign, e.advertiser, i.ts - e.ts AS gap,
    row_number() OVER (PARTITION BY i.sample_id, e.dom ORDER BY e.ts, e.event_id) - 1 AS pos
  FROM imp i JOIN dev e ON e.user_id = i.user_id AND e.ts < i.ts),
doms AS (SELECT unnest(['seq_a', 'seq_b', 'seq_c', 'seq_d']) AS dom)"""

_LENGTHS = """,
lens AS (
  SELECT i.sample_id,
    count(h.sample_id) FILTER (dom = 'seq_a') AS seq_a_len, count(h.sample_id) FILTER (dom = 'seq_b') AS seq_b_len,
    count(h.sample_id) FILTER (dom = 'seq_c') AS seq_c_len, count(h.sample_id) FILTER (dom = 'seq_d') AS seq_d_len
  FROM imp i LEFT JOIN hist h USING (sample_id) GROUP BY i.sample_id)"""
LENS = HIST + _LENGTHS
FULL_LENS = FULL_HIST + _LENGTHS

ORDERS_HIST = """ohist0 AS (
  SELECT o.o_orderkey AS sample_id, floor(epoch(p.o_orderdate))::BIGINT AS ts,
    CAST(l.l_quantity AS BIGINT) AS action, l.l_partkey AS item,
    CAST(len(list_distinct(string_split(pt.p_type, ''))) AS BIGINT) AS category, l.l_suppkey % 20 + 1 AS campaign,
    CAST(regexp_extract(pt.p_brand, '([0-9]+)', 1) AS BIGINT) AS advertiser,
    row_number() OVER (PARTITION BY o.o_orderkey ORDER BY p.o_orderdate DESC, l_orderkey DESC, l_partkey DESC, l_suppkey DESC,
      l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
      l_linestatus DESC, l_shipdate DESC) AS rev,
    count(*) OVER (PARTITION BY o.o_orderkey) AS raw_len
  FROM orders o JOIN orders p ON p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate
  JOIN lineitem l ON l.l_orderkey = p.o_orderkey JOIN part pt ON pt.p_partkey = l.l_partkey),
ohist AS (
  SELECT sample_id, ts, action, item, category, campaign, advertiser, raw_len, least(raw_len, 64) - rev AS pos
  FROM ohist0 WHERE rev <= 64)"""
FULL_ORDERS_HIST = ORDERS_HIST.replace("least(raw_len, 64) - rev", "raw_len - rev").replace(" WHERE rev <= 64", "")

SPLIT = """,
cut AS (SELECT CAST(floor(quantile_cont(ts, 0.8)) AS BIGINT) AS cutoff FROM imp)"""
