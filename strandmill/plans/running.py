"""Queries: streaming reports and configured feature chains (T, U)."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import scalars as S
from strandmill.operators.importance import group_importance
from strandmill.operators.splits import time_split
from strandmill.plans import features as _features  # noqa: F401  its SQL is part of the chain's
from strandmill.plans import scoring
from strandmill.plans.adapters import DOMAINS
from strandmill.plans.base import EV, FULL_HIST, HIST, IMP, LENS, SPLIT, SQL, query, samples
from strandmill.plans.blocks import FeatureChain
from strandmill.plans.evaluation import predictions
from strandmill.plans.ml import FeatureBlocks
from strandmill.session import shared_dir
from strandmill.sources.sinks import last_prediction
from strandmill.streaming import reports as T


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream: a score per event and 'purchase' as the positive class."""
    z = (F.col("value") - 50.0) / 50.0
    y = (F.col("event_type") == "purchase").cast("long")
    return T.stream_table(spark, f"{sf}/events.parquet").select(
        "user_id", F.col("ts").cast("timestamp").alias("event_time"), y.alias("label"), S.sigmoid(z).alias("prob"),
        S.bce_with_logits(z, y).alias("loss"))


STREAM = EV + """,
st AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, 1.0 / (1.0 + exp(-greatest(-40.0, least(40.0, (value - 50.0) / 50.0)))) AS prob FROM ev),
sl AS (SELECT *, greatest((value - 50.0) / 50.0, 0.0) + ln(1.0 + exp(-abs((value - 50.0) / 50.0))) - (value - 50.0) / 50.0 * label AS loss FROM st)"""


@query("t1_running_label_rate", f"""WITH {STREAM} SELECT ts // 3600 * 3600 AS window_start, count(*) AS n, sum(label)::BIGINT AS pos, avg(label) AS label_rate,
  avg(loss) FILTER (label = 1) AS loss_pos, avg(loss) FILTER (label = 0) AS loss_neg FROM sl GROUP BY 1""")
def t1(spark, sf):
    return T.run_available(spark, T.label_rates(event_stream(spark, sf)), "update", ["window_start"])


@query("t2_streaming_auc", f"""WITH {STREAM}, h AS (SELECT ts // 86400 * 86400 AS window_start, least(floor(prob * 1000), 999) AS bin, sum(label) AS pos, count(*) - sum(label) AS neg,
  sum(prob) AS ps FROM sl GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY window_start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h)
SELECT window_start, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg, coalesce(sum(pos * (below + neg / 2.0)) / nullif(sum(pos)::DOUBLE * sum(neg), 0), 0.5) AS auc,
  sum(ps) / (sum(pos) + sum(neg)) AS mean_pred, sum(pos)::DOUBLE / (sum(pos) + sum(neg)) AS actual_rate FROM b GROUP BY 1""")
def t2(spark, sf):
    return T.run_available(
        spark, T.score_histogram(event_stream(spark, sf)), "update", ["window_start", "bin"], T.auc_from_histogram)


@query("t3_user_sessions", """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
f AS (SELECT *, CASE WHEN t - lag(t) OVER w < 3600000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM f),
g AS (SELECT user_id, min(t) AS session_start, max(t) + 3600000000 AS session_end, count(*) AS n FROM s GROUP BY user_id, sid)
SELECT * FROM g WHERE session_end <= (SELECT max(t) // 1000 * 1000 - 600000000 FROM e)""")
def t3(spark, sf):
    """Sessions the watermark has closed; the last ones stay open as in any running stream."""
    return T.run_available(spark, T.user_sessions(event_stream(spark, sf)))


@query("t4_recency_counters", f"""WITH {EV}, h AS (SELECT user_id, ts, max(ts) OVER (PARTITION BY user_id) AS newest FROM ev)
SELECT user_id, newest, count(*) AS n_events, count(*) FILTER (newest - ts <= 3600) AS n_t0, count(*) FILTER (newest - ts <= 86400) AS n_t1,
  count(*) FILTER (newest - ts <= 604800) AS n_t2 FROM h GROUP BY user_id, newest""")
def t4(spark, sf):
    return T.run_available(
        spark, T.counts_per_second(event_stream(spark, sf)), "update", ["user_id", "second"], T.recency_counters)


CHAIN = {
    "time_bucket": {"domains": DOMAINS},
    "seq_hour": {"domains": DOMAINS},
    "seq_weekday": {"domains": DOMAINS},
    "dense_seq_stats": {"domains": DOMAINS, "add_last_gap_log": True, "add_gap_missing": True, "add_recent_flags": True},
    "conversion_state": {"domains": DOMAINS},
    "c_target": {"emit_target_ids": True},
    "temporal_dynamics": {"domains": DOMAINS},
    "sample_weight": {},
    "time_cats": {},
    "freq_filter": {"scalars": {"item_id": 200}, "min_count": 5},
    "seq_compress": {"run_domains": {"seq_b": ("category", "category")},
                     "budget_domains": {"seq_a": {"group_key": ["category"], "prefer_diverse": "item", "cap": 8}}},
    "seq_truncate": {"max_seq_lens": {d: 5 for d in DOMAINS}},
    "seq_session_state": {"domains": ["seq_c", "seq_d"], "add_daypart": True, "add_weekend": True, "category": {"seq_c": "category"}},
}


def run_chain(spark: SparkSession, sf: str) -> DataFrame:
    df = samples(spark, sf).drop(*[f"{d}_raw_len" for d in DOMAINS])
    split = time_split(df, "ts", 0.2)
    chain = FeatureChain(CHAIN)
    state = chain.fit(split.where(~F.col("is_valid")))
    return chain.transform(split, state)


STATS = ["present", "empty", "len_log", "last_gap_log", "gap_missing", "recent_300", "recent_3600", "recent_86400"]
EVIDENCE = ["flag", "log_count", "last_gap_log", "gap_missing", "recent_1", "recent_2", "recent_3", "last_action"]


def _cut_sql(name: str) -> str:
    """The SQL of a feature query over the histories that the sample table holds."""
    return SQL[name].replace(FULL_HIST, HIST)


@query("u2_feature_chain", f"""WITH s1 AS ({_cut_sql('q16_conversion_state')}), s2 AS ({_cut_sql('q17_temporal_velocity')}), s3 AS ({_cut_sql('q18_temporal_fatigue')}),
s4 AS ({_cut_sql('q19_temporal_context')}), s5 AS ({_cut_sql('q12_sample_weight')}), s6 AS ({_cut_sql('q9_time_categories')}), s7 AS ({_cut_sql('q3_dense_seq_stats')}),
s8 AS ({_cut_sql('q13_target_evidence')}), s9 AS ({_cut_sql('q14_target_ids')}), {LENS}{SPLIT},
often AS (SELECT item_id FROM imp, cut WHERE ts < cutoff AND item_id BETWEEN 1 AND 199 GROUP BY item_id HAVING count(*) >= 5)
SELECT sample_id, ts >= cutoff AS is_valid, CASE WHEN item_id BETWEEN 1 AND 199 AND item_id NOT IN (SELECT item_id FROM often) THEN 0 ELSE item_id END AS item_id,
  least(seq_c_len, 5) AS seq_c_len, least(seq_d_len, 5) AS seq_d_len, weight AS sample_weight, target_item AS c_target_item_id,
  CASE WHEN item_id > 0 THEN target_campaign ELSE 0 END AS c_target_campaign_id,
  {', '.join(f's7.{n} AS stats_{n}' for n in STATS)}, {', '.join(f's8.{n} AS target_{n}' for n in EVIDENCE)},
  s1.* EXCLUDE (sample_id), s2.* EXCLUDE (sample_id), s3.* EXCLUDE (sample_id), s4.* EXCLUDE (sample_id), s6.* EXCLUDE (sample_id)
FROM imp JOIN lens USING (sample_id) JOIN s1 USING (sample_id) JOIN s2 USING (sample_id) JOIN s3 USING (sample_id) JOIN s4 USING (sample_id)
  JOIN s5 USING (sample_id) JOIN s6 USING (sample_id) JOIN s7 USING (sample_id) JOIN s8 USING (sample_id) JOIN s9 USING (sample_id), cut
WHERE s7.dom = 'seq_c' AND s8.kind = 'campaign'""")
def u2(spark, sf):
    """A configured chain of thirteen blocks, fitted in one pass over the training rows and applied to all."""
    df = run_chain(spark, sf)
    made = [c for c in df.columns if c.startswith(("conv_state_", "td_", "time_"))]
    stats = {f"stats_{n}": F.get("dense_seq_stats", F.lit(2 * len(STATS) + i)) for i, n in enumerate(STATS)}
    evidence = {f"target_{n}": F.get("c_target_hist", F.lit(len(EVIDENCE) + i)) for i, n in enumerate(EVIDENCE)}
    return df.select(
        "sample_id", "is_valid", "item_id", "seq_c_len", "seq_d_len", "sample_weight", "c_target_item_id", "c_target_campaign_id",
        *[c.alias(n) for n, c in {**stats, **evidence}.items()], *made)


@query("u2_chain_events")
def u2_events(spark, sf):
    """Per-event fields after the chain, all aligned through compression and truncation."""
    # An inner explode would have the whole chain of its array computed again in a filter for empty ones; the length says it.
    df = run_chain(spark, sf).where("seq_c_len > 0")
    return df.select("sample_id", "c_target_item_id", "sample_weight", F.posexplode_outer("seq_c").alias("pos", "event")).select(
        "sample_id", "c_target_item_id", "sample_weight", "pos", "event.*")


@query("u1_ml_pipeline", f"""WITH s1 AS ({SQL['q12_sample_weight']}), s2 AS ({SQL['q9_time_categories']}), s3 AS ({_cut_sql('q14_target_ids')}), {IMP}{SPLIT},
often AS (SELECT item_id FROM imp, cut WHERE ts < cutoff AND item_id BETWEEN 1 AND 199 GROUP BY item_id HAVING count(*) >= 5)
SELECT sample_id, ts >= cutoff AS is_valid, weight AS sample_weight, s2.* EXCLUDE (sample_id), target_campaign AS campaign_before,
  CASE WHEN item_id BETWEEN 1 AND 199 AND item_id NOT IN (SELECT item_id FROM often) THEN 0 ELSE item_id END AS item_id,
  (item_id > 0 AND item_id BETWEEN 1 AND 199 AND item_id NOT IN (SELECT item_id FROM often)) AS was_rare
FROM imp JOIN s1 USING (sample_id) JOIN s2 USING (sample_id) JOIN s3 USING (sample_id), cut""")
def u1(spark, sf):
    """Blocks as stages of a Pipeline: fitted on the training rows, saved to the shared folder, loaded, applied to all."""
    df = samples(spark, sf).drop(*[f"{d}_raw_len" for d in DOMAINS])
    split = time_split(df, "ts", 0.2).withColumn("given_item", F.col("item_id"))
    stages = [FeatureBlocks({"sample_weight": {}, "time_cats": {}, "c_target": {"emit_target_ids": True}}),
              FeatureBlocks({"freq_filter": {"scalars": {"item_id": 200}, "min_count": 5}})]
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    Pipeline(stages=stages).fit(split.where(~F.col("is_valid"))).write().save(at)
    out = PipelineModel.load(at).transform(split)
    return out.select(
        "sample_id", "is_valid", "sample_weight", *[c for c in out.columns if c.startswith("time_")],
        F.col("c_target_campaign_id").alias("campaign_before"), "item_id", (F.col("item_id") != F.col("given_item")).alias("was_rare"))


@query("u4_score_predicate", f"""WITH {IMP} SELECT count(*) AS n, sum(label)::BIGINT AS pos FROM imp WHERE 1.0 / (1.0 + exp(-(logit * 0.5))) > 0.6""")
def u4(spark, sf):
    """A row predicate on a scorer; one that is a column expression needs no Python rows."""
    def scorer(logit: Column) -> Column:
        return S.sigmoid(logit * 0.5)

    hits = predictions(spark, sf).where(scorer(F.col("logit")) > 0.6)
    return hits.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))


BASELINE_FEATURES = ["dense_len", "clicks_1d", "entropy", "burst", "hour"]


def baseline_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(training rows with recency weights, validation rows) of the baseline's features."""
    from strandmill.operators import fit as fits
    from strandmill.operators import sequences as Q

    base = Q.conversion_counts(samples(spark, sf), DOMAINS)
    state = Q.conversion_state(DOMAINS)
    df = base.select(
        "sample_id", "ts", "user_id", "label", state["conv_state_total_len_log_norm"].alias("dense_len"),
        state["conv_state_seq_a_recent_count_le_1d"].alias("clicks_1d"), state["conv_state_len_entropy_norm"].alias("entropy"),
        state["conv_state_burst_ratio_t1_over_t2"].alias("burst"), S.hour_id(F.col("ts")).cast("double").alias("hour"))
    split = time_split(df, "ts", 0.2)
    train = split.where(~F.col("is_valid"))
    w = fits.recency_weight_fit(train).first()
    return train.withColumn("sample_weight", fits.recency_weight(F.col("ts"), w["ref_ts"], w["norm"])), split.where("is_valid")


@query("u5_baseline_scores")
def u5(spark, sf):
    """Train on the training split with recency weights, score validation, one probability per user."""
    weighted, valid = baseline_rows(spark, sf)
    model = scoring.train_baseline(weighted, BASELINE_FEATURES, weight="sample_weight")
    return last_prediction(scoring.score(valid, model), "sample_id")


@query("e33_group_importance")
def e33(spark, sf):
    """Walks over masked feature groups of the trained baseline, on all validation rows."""
    weighted, valid = baseline_rows(spark, sf)
    model = scoring.train_baseline(weighted, BASELINE_FEATURES, weight="sample_weight")
    groups = {"volume": ["dense_len", "entropy"], "recency": ["clicks_1d", "burst"], "time": ["hour"]}
    return group_importance(valid, groups, lambda rows: scoring.score(rows, model, None), permutations=100)
