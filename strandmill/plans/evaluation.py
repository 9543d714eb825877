"""Queries: splits and samples, evaluation and health reports, losses, set operations (L, E, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import scalars as S
from strandmill.operators import evaluate as E
from strandmill.operators import health as H
from strandmill.operators import losses as LS
from strandmill.operators import splits as P
from strandmill.operators import vectors as V
from strandmill.operators.importance import exact_importance
from strandmill.operators.ranking import exact_quantiles, global_rank
from strandmill.plans.adapters import DOMAINS, event_log, table
from strandmill.plans.base import EV, FULL_LENS, HIST, IMP, LENS, SPLIT, query, samples
from strandmill.sources.samples import scan, with_flat_index

LEN_COLS = [f"{d}_len" for d in DOMAINS]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Narrow rows without histories; their losses are rounded as in SQL, as many queries rank by them."""
    cols = ["sample_id", "ts", "user_id", "item_id", "category", "label", "score", "logit", "prob"]
    return samples(spark, sf).select(*cols, S.bce_as_sql(F.col("logit"), F.col("label")).alias("loss"))


def with_lengths(spark: SparkSession, sf: str, ceiling: int = 5) -> DataFrame:
    """Predictions with lengths before and after a short ceiling; those before count the whole log."""
    cut = {f"{d}_len": F.least(f"{d}_raw_len", F.lit(ceiling)).cast("long") for d in DOMAINS}
    narrow = samples(spark, sf).withColumns(cut).drop(*DOMAINS)
    return narrow.withColumn("loss", S.bce_as_sql(F.col("logit"), F.col("label")))


CUT_LENS = FULL_LENS + f""",
pl AS (SELECT i.*, {', '.join(f'l.{d}_len AS {d}_raw_len, least(l.{d}_len, 5) AS {d}_len' for d in DOMAINS)} FROM imp i JOIN lens l USING (sample_id))"""


def draw_sql(seed: object, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *keys])
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"


# --- splits and samples -------------------------------------------------------------------------

@query("l1_positional_split", """WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS flat_idx, count(*) OVER () AS n FROM events)
SELECT event_id, flat_idx >= n - CAST(floor(n * 0.15) AS BIGINT) AS is_valid FROM e""")
def l1(spark, sf):
    df = with_flat_index(scan(spark, f"{sf}/events.parquet", columns=["event_id"]))
    return P.positional_split(df, "flat_idx", 0.15).select("event_id", "is_valid")


@query("l2_time_split", f"WITH {IMP}{SPLIT} SELECT sample_id, ts >= cutoff AS is_valid FROM imp, cut")
def l2(spark, sf):
    return P.time_split(predictions(spark, sf), "ts", 0.2).select("sample_id", "is_valid")


@query("l3_exact_subsample", f"""WITH {IMP}, d AS (SELECT sample_id, row_number() OVER (ORDER BY {draw_sql(42, 'sample_id')}, sample_id) AS r, count(*) OVER () AS n FROM imp)
SELECT sample_id FROM d WHERE r <= greatest(1, CAST(floor(n * 0.3) AS BIGINT))""")
def l3(spark, sf):
    return P.ratio_sample(predictions(spark, sf).select("sample_id"), 0.3, 42, ["sample_id"])


@query("l4_epoch_shuffle", f"WITH {IMP} SELECT sample_id, row_number() OVER (ORDER BY {draw_sql(45, 'sample_id')}, sample_id) AS place FROM imp")
def l4(spark, sf):
    """Place of each row in epoch 3; writers use ``epoch_order`` and keep the sorted order itself."""
    df = predictions(spark, sf).select("sample_id").withColumn("shuffle_key", S.draw(42 + 3, F.col("sample_id")))
    return global_rank(df, [F.col("shuffle_key"), F.col("sample_id")], "place").select("sample_id", "place")


@query("l5_reservoir", f"WITH {IMP} SELECT sample_id, logit, label FROM imp ORDER BY {draw_sql(9, 'sample_id')}, sample_id LIMIT 200")
def l5(spark, sf):
    return P.reservoir(predictions(spark, sf).select("sample_id", "logit", "label"), 200, 9, ["sample_id"])


@query("l6_class_capped", f"""WITH {IMP}, d AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(3, 'sample_id')}, sample_id) AS r FROM imp)
SELECT sample_id, label FROM d WHERE (label = 1 AND r <= 100) OR (label = 0 AND r <= 300)""")
def l6(spark, sf):
    return P.class_capped(predictions(spark, sf).select("sample_id", "label"), "label", {1: 100, 0: 300}, 3, ["sample_id"])


TOPS = IMP + """,
rk AS (SELECT *, row_number() OVER (ORDER BY loss DESC, sample_id) AS r, count(*) OVER () AS n FROM imp),
fl AS (SELECT *, r <= greatest(1, n // 5) AS top20, r <= greatest(1, n // 10) AS top10, r <= greatest(1, n // 20) AS top5, r <= greatest(1, n // 100) AS top1 FROM rk)"""


@query("l7_top_fractions", f"WITH {TOPS} SELECT sample_id, top20, top10, top5, top1 FROM fl")
def l7(spark, sf):
    df = predictions(spark, sf).select("sample_id", "loss")
    return P.top_fraction_flags(df, "loss", "sample_id", E.HARD_FRACTIONS).drop("loss")


@query("g0_global_rank", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey,
  l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem""")
def g0(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = [F.col(c) for c in ("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    # A small task limit: the query itself takes the sliced plan it would take on a large table.
    return global_rank(df, order, "rank", task_rows=max(1, df.count() // 16))


@query("g0_exact_quantiles", """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50,
  quantile_cont(l_extendedprice, 0.99) AS q99 FROM lineitem GROUP BY l_returnflag""")
def g0_quantiles(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return exact_quantiles(df, ["l_returnflag"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q99": 0.99}, task_rows=max(1, df.count() // 16))


# --- evaluation ---------------------------------------------------------------------------------

def auc_sql(source: str, score: str, keys: str = "") -> str:
    """AUC by average ranks, a second way of counting than the query's."""
    part = f"PARTITION BY {keys}" if keys else ""
    sel = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {sel}count(*) AS n, sum(label)::BIGINT AS pos,
  (sum(CASE WHEN label = 1 THEN rk + (tied - 1) / 2.0 ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) /
    nullif(sum(label)::DOUBLE * (count(*) - sum(label)), 0) AS auc
FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) AS rk, count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}{score}) AS tied FROM {source}) {group}"""


@query("e1_roc_auc", f"WITH {IMP} SELECT auc FROM ({auc_sql('imp', 'prob')})")
def e1(spark, sf):
    return E.roc_auc(predictions(spark, sf))


@query("e2_log_loss", f"""WITH {IMP}, c AS (SELECT label, least(greatest(prob, 1e-7), 1 - 1e-7) AS p FROM imp)
SELECT avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS logloss FROM c""")
def e2(spark, sf):
    return E.log_loss_report(predictions(spark, sf))


@query("e3_sigmoid", f"WITH {IMP} SELECT sample_id, 1.0 / (1.0 + exp(-greatest(-40.0, least(40.0, logit * 30)))) AS prob FROM imp")
def e3(spark, sf):
    return predictions(spark, sf).select("sample_id", S.sigmoid(F.col("logit") * 30).alias("prob"))


@query("e4_group_auc", f"""WITH {IMP}, g AS ({auc_sql('imp', 'logit', 'user_id')})
SELECT sum(auc * n) / sum(CASE WHEN auc IS NOT NULL THEN n END) AS gauc, count(auc)::DOUBLE / count(*) AS coverage FROM g""")
def e4(spark, sf):
    return E.group_auc(predictions(spark, sf), "user_id")


@query("e5_domain_auc", f"""WITH {LENS}, r AS ({' UNION ALL '.join(f"SELECT '{d}' AS domain, prob, label FROM imp JOIN lens USING (sample_id) WHERE {d}_len > 0" for d in DOMAINS)})
SELECT domain, auc FROM ({auc_sql('r', 'prob', 'domain')})""")
def e5(spark, sf):
    return E.domain_auc(samples(spark, sf), {d: F.size(d) > 0 for d in DOMAINS})


@query("e6_mean_calibration", f"WITH {IMP} SELECT avg(prob) AS mean_pred, avg(label) AS actual_rate FROM imp")
def e6(spark, sf):
    return E.mean_calibration(predictions(spark, sf))


BINS = [0.0, 0.3, 0.5, 0.7, 0.9, 1.0]


@query("e7_binned_calibration", f"""WITH {IMP} SELECT CASE WHEN prob < 0.3 THEN 0 WHEN prob < 0.5 THEN 1 WHEN prob < 0.7 THEN 2 WHEN prob < 0.9 THEN 3 ELSE 4 END::BIGINT AS bin,
  count(*) AS n, avg(prob) AS mean_pred, avg(label) AS actual_rate FROM imp GROUP BY 1""")
def e7(spark, sf):
    return E.binned_calibration(predictions(spark, sf), BINS)


def pct_sql(value: str, points, prefix: str = "p") -> str:
    return ", ".join(f"quantile_cont({value}, {p / 100}) AS {prefix}{p}" for p in points)


@query("e8_prediction_confidence", f"""WITH {IMP}, c AS (SELECT prob, least(greatest(prob, 1e-7), 1 - 1e-7) AS p FROM imp)
SELECT {pct_sql('prob', [5, 25, 50, 75, 95])}, avg(-(p * log2(p) + (1 - p) * log2(1 - p))) AS entropy,
  avg(CASE WHEN prob < 0.05 OR prob > 0.95 THEN 1.0 ELSE 0.0 END) AS high_conf FROM c""")
def e8(spark, sf):
    return E.prediction_confidence(predictions(spark, sf))


@query("e9_logit_separation", f"""WITH {IMP}, q AS (SELECT quantile_cont(logit, 0.25) FILTER (label = 0) AS neg_p25, quantile_cont(logit, 0.5) FILTER (label = 0) AS neg_p50,
  quantile_cont(logit, 0.75) FILTER (label = 0) AS neg_p75, quantile_cont(logit, 0.25) FILTER (label = 1) AS pos_p25,
  quantile_cont(logit, 0.5) FILTER (label = 1) AS pos_p50, quantile_cont(logit, 0.75) FILTER (label = 1) AS pos_p75 FROM imp)
SELECT q.*, pos_p50 - neg_p50 AS median_gap, (SELECT avg(CASE WHEN logit > pos_p25 THEN 1.0 ELSE 0.0 END) FROM imp WHERE label = 0) AS overlap FROM q""")
def e9(spark, sf):
    return E.logit_separation(predictions(spark, sf))


@query("e10_loss_summary", f"WITH {IMP} SELECT {pct_sql('loss', [5, 25, 50, 75, 95], 'loss_p')}, stddev_pop(loss) AS loss_std FROM imp")
def e10(spark, sf):
    return E.loss_summary(predictions(spark, sf))


@query("e11_loss_concentration", f"""WITH {TOPS}, s AS (SELECT sum(loss) AS t, sum(loss * loss) AS sq, {', '.join(f'sum(loss) FILTER ({k}) AS {k}' for k in E.HARD_FRACTIONS)} FROM fl)
SELECT top20 / t AS top20_frac, top10 / t AS top10_frac, top5 / t AS top5_frac, top1 / t AS top1_frac, sq / (t * t) AS loss_hhi,
  top1 / top10 AS top1_over_top10, top5 / top20 AS top5_over_top20 FROM s""")
def e11(spark, sf):
    return E.loss_concentration(predictions(spark, sf))


def _profile_sql() -> str:
    cols = []
    for d in DOMAINS:
        cols += [f"avg(CASE WHEN {d}_len > 0 THEN 1.0 ELSE 0.0 END) AS {d}_present",
                 f"avg(1.0 - {d}_len / greatest({d}_raw_len::DOUBLE, 1.0)) AS {d}_trunc", f"quantile_cont({d}_raw_len, 0.5) AS {d}_raw_p50"]
    n = " + ".join(f"CAST({d}_len > 0 AS INTEGER)" for d in DOMAINS)
    return f"""WITH {CUT_LENS}, h AS (SELECT *, row_number() OVER (ORDER BY loss DESC, sample_id) <= greatest(1, count(*) OVER () // 10) AS is_hard FROM pl)
SELECT is_hard, count(*) AS n, avg(prob) AS pred_mean, avg(label) AS pos_rate, avg({n}) AS n_domains, quantile_cont(loss, 0.9) AS loss_p90,
  quantile_cont(loss, 0.99) AS loss_p99, avg(seq_a_len) AS seq_a_recency, {', '.join(cols)} FROM h GROUP BY is_hard"""


@query("e12_hard_easy_profile", _profile_sql())
def e12(spark, sf):
    return E.hard_easy_profile(
        with_lengths(spark, sf), {d: f"{d}_len" for d in DOMAINS}, {d: f"{d}_raw_len" for d in DOMAINS}, {"seq_a": "seq_a_len"})


INV = """,
inv AS (SELECT sample_id, logit, count(*) FILTER (label = 1) OVER (ORDER BY logit RANGE UNBOUNDED PRECEDING) AS inv, label FROM imp),
neg AS (SELECT *, row_number() OVER (ORDER BY logit DESC, sample_id) AS r, count(*) OVER () AS q FROM inv WHERE label = 0)"""


@query("e13_rank_inversions", f"""WITH {IMP}{INV}, t AS (SELECT sum(inv)::BIGINT AS inv_total, max(q) * (SELECT sum(label)::BIGINT FROM imp) AS pair_n,
  {', '.join(f'sum(inv) FILTER (r <= greatest(1, CAST(round_even(q * {s}, 0) AS BIGINT))) AS t{k}' for k, s in (('0_1', 0.001), ('0_5', 0.005), ('1', 0.01), ('5', 0.05), ('10', 0.1)))} FROM neg)
SELECT inv_total, pair_n::BIGINT AS pair_n, inv_total::DOUBLE / pair_n AS inv_rate,
  sqrt((inv_total::DOUBLE / pair_n) * (1 - inv_total::DOUBLE / pair_n) / least(200000, pair_n)) AS inv_rate_se,
  {', '.join(f't{k}::DOUBLE / inv_total AS inv_top{k}neg_frac' for k in ('0_1', '0_5', '1', '5', '10'))} FROM t""")
def e13(spark, sf):
    return E.rank_inversions(predictions(spark, sf))


PAIRS = IMP + f""",
cls AS (SELECT sample_id, label, logit, row_number() OVER (PARTITION BY label ORDER BY sample_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM imp),
pick AS (SELECT range AS pair, floor({draw_sql(5, "'pos'", 'range')} * (SELECT max(n) FROM cls WHERE label = 1)) + 1 AS pr,
  floor({draw_sql(5, "'neg'", 'range')} * (SELECT max(n) FROM cls WHERE label = 0)) + 1 AS nr FROM range(200000)),
pairs AS (SELECT pair, p.logit AS pos_logit, q.logit AS neg_logit, p.logit - q.logit AS m FROM pick JOIN cls p ON p.label = 1 AND p.r = pr
  JOIN cls q ON q.label = 0 AND q.r = nr)"""


@query("e14_margin_distribution", f"""WITH {PAIRS} SELECT {pct_sql('m', [1, 5, 10, 25, 50, 75, 90], 'margin_p')},
  {', '.join(f"avg(CASE WHEN abs(m) < {e} THEN 1.0 ELSE 0.0 END) AS near_zero_e{str(e).replace('.', '_')}" for e in (0.01, 0.03, 0.05, 0.1, 0.2))} FROM pairs""")
def e14(spark, sf):
    return E.margin_distribution(E.sampled_pairs(predictions(spark, sf), 200_000, 5))


def _slices_sql() -> str:
    nd = " + ".join(f"CAST({d}_len > 0 AS BIGINT)" for d in DOMAINS)
    cut = "(" + " + ".join(f"(1.0 - {d}_len / greatest({d}_raw_len::DOUBLE, 1.0))" for d in DOMAINS) + ") / 4.0"
    return f"""WITH {CUT_LENS}{INV},
w AS (SELECT pl.sample_id, pl.label, pl.loss, pl.logit, {nd} AS nd, {cut} AS tr, CASE WHEN pl.label = 0 THEN inv END AS inv FROM pl JOIN inv USING (sample_id)),
ed AS (SELECT list_distinct([{', '.join(f'quantile_cont(logit, {i / 10})' for i in range(1, 10))}]) AS de,
  list_distinct([{', '.join(f'quantile_cont(tr, {i / 10})' for i in (2, 4, 6, 8))}]) AS te FROM w),
tg AS (SELECT label, loss, logit, inv, 'score_decile' AS kind, len(list_filter(de, lambda e: e < logit)) AS bucket FROM w, ed
  UNION ALL SELECT label, loss, logit, inv, 'n_domains', nd FROM w
  UNION ALL SELECT label, loss, logit, inv, 'trunc_quintile', len(list_filter(te, lambda e: e < tr)) FROM w, ed),
au AS ({auc_sql('tg', 'logit', 'kind, bucket')}),
ag AS (SELECT kind, bucket, count(*) AS n, sum(loss) AS l, coalesce(sum(inv), 0) AS i FROM tg GROUP BY kind, bucket),
tt AS (SELECT count(*) AS n, sum(loss) AS l, sum(inv) AS i FROM w)
SELECT ag.kind, ag.bucket, ag.n::DOUBLE / tt.n AS sample_share, ag.l / tt.l AS loss_share, ag.i::DOUBLE / tt.i AS inv_share,
  (ag.i::DOUBLE / tt.i) / (ag.n::DOUBLE / tt.n) AS distortion, au.auc AS slice_auc FROM ag JOIN au USING (kind, bucket), tt"""


@query("e15_distorted_slices", _slices_sql())
def e15(spark, sf):
    return E.distorted_slices(with_lengths(spark, sf), LEN_COLS, {f"{d}_len": f"{d}_raw_len" for d in DOMAINS})


def second_view(df: DataFrame) -> DataFrame:
    """A later evaluation of the same rows: scores shifted by item."""
    logit = F.col("logit") + (F.col("item_id") % 5 - 2) * 0.6
    return df.withColumns({"logit_b": logit, "loss_b": S.bce_as_sql(logit, F.col("label"))})


VIEWS = IMP + """,
vw AS (SELECT *, logit + (item_id % 5 - 2) * 0.6 AS logit_b FROM imp),
vl AS (SELECT *, greatest(logit_b, 0.0) + ln(1.0 + exp(-abs(logit_b))) - logit_b * label AS loss_b FROM vw),
ha AS (SELECT sample_id FROM vl ORDER BY loss DESC, sample_id LIMIT greatest(1, (SELECT count(*) // 10 FROM imp))),
hb AS (SELECT sample_id FROM vl ORDER BY loss_b DESC, sample_id LIMIT greatest(1, (SELECT count(*) // 10 FROM imp)))"""


@query("e16_hard_set_churn", f"""WITH {VIEWS}, o AS (SELECT count(*) FILTER (a.sample_id IS NOT NULL AND b.sample_id IS NOT NULL) AS n_both, count(*) AS n_union,
  count(*) FILTER (a.sample_id IS NULL) AS n_new, count(b.sample_id) AS n_b FROM ha a FULL JOIN hb b ON a.sample_id = b.sample_id)
SELECT n_both::DOUBLE / n_union AS hard_jaccard, n_new::DOUBLE / n_b AS hard_entry_rate FROM o""")
def e16(spark, sf):
    df = second_view(predictions(spark, sf))
    return E.hard_set_churn(E.hard_set(df, "loss"), E.hard_set(df, "loss_b"))


@query("e16_hub_negative_churn", f"""WITH {IMP}, vs AS (SELECT sample_id, label, range AS step, logit + (item_id % 5 - 2) * 0.125 * range AS z FROM imp, range(4)),
inv AS (SELECT step, sample_id, label, z, count(*) FILTER (label = 1) OVER (PARTITION BY step ORDER BY z RANGE UNBOUNDED PRECEDING) AS inv FROM vs),
rk AS (SELECT step, sample_id, row_number() OVER (PARTITION BY step ORDER BY inv DESC, z DESC, sample_id) AS r, count(*) OVER (PARTITION BY step) AS q FROM inv WHERE label = 0),
hub AS (SELECT step, sample_id FROM rk WHERE r <= greatest(1, round_even(q * 0.01, 0))),
o AS (SELECT coalesce(b.step, a.step + 1) AS step, a.sample_id AS old, b.sample_id AS new FROM hub a FULL JOIN hub b ON a.sample_id = b.sample_id AND b.step = a.step + 1)
SELECT step, count(*) FILTER (old IS NOT NULL AND new IS NOT NULL)::DOUBLE / count(*) AS hub_jaccard,
  count(*) FILTER (old IS NULL)::DOUBLE / count(new) AS hub_entry_rate FROM o WHERE step BETWEEN 1 AND 3 GROUP BY step""")
def e16_hubs(spark, sf):
    """Negatives with the most inversions in four evaluations of a drifting model."""
    drift = (F.col("item_id") % 5 - 2) * 0.125
    rows = predictions(spark, sf).select("*", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("step"))
    hubs = E.hub_negatives(rows.withColumn("logit", F.col("logit") + drift * F.col("step")), ["step"])
    return E.successive_churn(hubs, "step", "hub")


BUCKETS = {
    "loss_cuts": {"quantiles": [0.5, 0.9], "labels": ["loss_easy", "loss_mid", "loss_hard"]},
    "score_cuts": {"quantiles": [0.25, 0.75], "labels": ["band_low", "band_mid", "band_high"]},
    "length_edges": {"seq_a_len": [0, 2, 4]},
}


def members(spark: SparkSession, sf: str) -> DataFrame:
    return E.bucket_memberships(with_lengths(spark, sf), LEN_COLS, **BUCKETS)


def _members_sql() -> str:
    keep = "sample_id, label, prob, loss, logit"
    nd = " + ".join(f"CAST({d}_len > 0 AS BIGINT)" for d in DOMAINS)
    best = f"greatest({', '.join(LEN_COLS)})"
    primary = f"CASE WHEN {best} <= 0 THEN 'none' " + " ".join(f"WHEN {d}_len = {best} THEN '{d}'" for d in DOMAINS) + " END"
    return CUT_LENS + f""",
hd AS (SELECT *, CASE WHEN label = 1 THEN -prob ELSE prob END AS hard FROM pl),
qe AS (SELECT quantile_cont(loss, 0.5) AS l1, quantile_cont(loss, 0.9) AS l2, quantile_cont(hard, 0.25) AS h1, quantile_cont(hard, 0.75) AS h2 FROM hd),
mem AS (SELECT {keep}, 'all' AS bucket, 'all' AS source FROM hd
  UNION ALL SELECT {keep}, CASE WHEN loss <= l1 THEN 'loss_easy' WHEN loss <= l2 THEN 'loss_mid' ELSE 'loss_hard' END, 'loss' FROM hd, qe
  UNION ALL SELECT {keep}, CASE WHEN hard <= h1 THEN 'band_low' WHEN hard <= h2 THEN 'band_mid' ELSE 'band_high' END, 'score_band' FROM hd, qe
  UNION ALL SELECT {keep}, CASE WHEN seq_a_len <= 2 THEN 'seq_a_len_0_to_2' WHEN seq_a_len <= 4 THEN 'seq_a_len_2_to_4' ELSE 'seq_a_len_gt_4' END, 'seq_len' FROM hd
  UNION ALL SELECT {keep}, 'active_domains_' || ({nd}), 'active_domain_count' FROM hd
  UNION ALL SELECT {keep}, 'primary_domain_' || ({primary}), 'primary_domain' FROM hd)"""


@query("e17_bucket_outcomes", f"""WITH {_members_sql()}, au AS ({auc_sql('mem', 'prob', 'bucket, source')}),
ag AS (SELECT bucket, source, count(*) AS n, sum(label)::BIGINT AS pos, avg(loss) AS logloss, avg(prob) AS mean_pred FROM mem GROUP BY bucket, source)
SELECT bk.bucket, bk.source, coalesce(ag.n, 0) AS n, coalesce(ag.pos, 0) AS pos, ag.pos::DOUBLE / ag.n AS pos_rate, CASE WHEN ag.n >= 50 AND ag.pos >= 5 THEN 1 ELSE 0 END::BIGINT AS valid,
  CASE WHEN ag.n >= 50 AND ag.pos >= 5 THEN '' WHEN ag.n IS NULL THEN 'empty' WHEN ag.n < 50 THEN 'min_bucket_n' ELSE 'min_bucket_pos' END AS skip, logloss, mean_pred,
  CASE WHEN bk.source IN ('seq_len', 'active_domain_count', 'primary_domain') THEN auc END AS auc
FROM (VALUES {', '.join(f"('{b}', '{s}')" for b, s in E.bucket_names(LEN_COLS, **BUCKETS))}) bk(bucket, source) LEFT JOIN ag USING (bucket, source) LEFT JOIN au USING (bucket, source)""")
def e17(spark, sf):
    return E.bucket_outcomes(members(spark, sf), buckets=E.bucket_names(LEN_COLS, **BUCKETS))


@query("e18_pair_cosine", """WITH v AS (SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, CAST(embedding[1:32] AS DOUBLE[]) AS u, CAST(embedding[33:64] AS DOUBLE[]) AS w,
  vec_id % 3 AS part FROM embeddings),
c AS (SELECT label, part, list_dot_product(u, w) / ((sqrt(list_dot_product(u, u)) + 1e-8) * (sqrt(list_dot_product(w, w)) + 1e-8)) AS cos FROM v),
m AS (SELECT 'all' AS bucket, label, cos FROM c UNION ALL SELECT 'part_' || part, label, cos FROM c)
SELECT bucket, count(*) AS n, sum(label)::BIGINT AS pos, avg(cos) FILTER (label = 1) AS pos_mean, avg(cos) FILTER (label = 0) AS neg_mean,
  avg(cos) FILTER (label = 1) - avg(cos) FILTER (label = 0) AS gap FROM m GROUP BY bucket""")
def e18(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("label"), "embedding")
    tagged = df.select("*", F.explode(F.array(F.lit("all"), F.concat(F.lit("part_"), F.col("vec_id") % 3))).alias("bucket"))
    return E.pair_cosine(tagged, F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))


@query("e19_cluster_label_information")
def e19(spark, sf):
    df = table(spark, sf, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    return V.cluster_label_information(df, "embedding", "y", seeds=(0, 1))


@query("e20_projection_2d")
def e20(spark, sf):
    return V.project_2d(table(spark, sf, "embeddings"), "embedding", "vec_id")


DENSE = """WITH v AS (SELECT generate_subscripts(embedding, 1) - 1 AS dim, CASE WHEN vec_id % 20 <> 0 AND generate_subscripts(embedding, 1) % 8 = 0 THEN 0.0
  WHEN generate_subscripts(embedding, 1) = 3 THEN 1.0 ELSE unnest(embedding)::DOUBLE END AS x FROM embeddings),
st AS (SELECT dim::INTEGER AS dim, min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_pop(x) AS std, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) AS zero_share FROM v GROUP BY dim)"""


def sparse_vectors(spark: SparkSession, sf: str) -> DataFrame:
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: F.when(
        (F.col("vec_id") % 20 != 0) & ((i + 1) % 8 == 0), 0.0).when(i == 2, 1.0).otherwise(v))
    return table(spark, sf, "embeddings").select("vec_id", x.alias("embedding"))


@query("e21_dense_column_stats", DENSE + " SELECT * FROM st")
def e21(spark, sf):
    return H.dense_column_stats(sparse_vectors(spark, sf), "embedding")


@query("e21_dense_summary", DENSE + """ SELECT count(*) AS cols, count(*) FILTER (std < 1e-6) AS constant,
  count(*) FILTER (zero_share > 0.9) - count(*) FILTER (std < 1e-6) AS high_sparse FROM st""")
def e21_summary(spark, sf):
    return H.dense_summary(H.dense_column_stats(sparse_vectors(spark, sf), "embedding"))


def _lengths_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{d}' AS domain, {d}_len AS n, {d}_raw_len AS raw FROM pl" for d in DOMAINS)
    return f"""WITH {CUT_LENS}, r AS ({rows}) SELECT domain, max(n) AS max, avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END) AS empty,
  count(*) FILTER (raw > 0 AND raw > n)::DOUBLE / count(*) FILTER (raw > 0) AS trunc_rate, max(raw) AS raw_max, {pct_sql('n', [25, 50, 75, 95])},
  {', '.join(f'quantile_cont(raw, {p / 100}) FILTER (raw > 0) AS raw_p{p}' for p in (25, 50, 75, 95))} FROM r GROUP BY domain"""


@query("e22_sequence_lengths", _lengths_sql())
def e22(spark, sf):
    return H.sequence_length_report(with_lengths(spark, sf), {d: (f"{d}_len", f"{d}_raw_len") for d in DOMAINS})


@query("e23_label_rates", f"""WITH {IMP}, b AS (SELECT ts // 86400 AS b, avg(label) AS rate, sum(label) AS s, count(*) AS n, avg(loss) FILTER (label = 1) AS lp,
  avg(loss) FILTER (label = 0) AS ln FROM imp GROUP BY 1)
SELECT avg(rate) AS mean, var_pop(rate) AS var, sum(s)::DOUBLE / sum(n) AS running_label_rate, avg(lp) AS loss_pos, avg(ln) AS loss_neg FROM b""")
def e23(spark, sf):
    return H.label_rate_report(predictions(spark, sf), F.floor(F.col("ts") / 86400))


@query("e24_out_of_bounds", f"""WITH {EV} SELECT 'id' AS feature, count(*) FILTER (item % 17 = 0) AS n_null, count(*) FILTER (item % 17 <> 0 AND item <= 20) AS n_low,
  count(*) FILTER (item % 17 <> 0 AND item >= 80) AS n_high FROM ev
UNION ALL SELECT 'user_id', 0, count(*) FILTER (user_id <= 0), count(*) FILTER (user_id >= 100) FROM ev""")
def e24(spark, sf):
    df = event_log(spark, sf).select("user_id", F.when(F.col("item") % 17 != 0, F.col("item") - 20).alias("id"))
    return H.out_of_bounds(df, {"id": 60, "user_id": 100})


VOCABULARIES = {"item": 130, "user": 2000}


@query("e25_id_utilisation", f"""WITH {EV}, v AS (SELECT 'item' AS feature, item AS id FROM ev UNION ALL SELECT 'user', user_id FROM ev WHERE user_id > 0),
c AS (SELECT feature, id, count(*) AS c FROM v GROUP BY feature, id),
g AS (SELECT 'item' AS feature, unnest(range(1, 130)) AS id UNION ALL SELECT 'user', unnest(range(1, 2000))),
al AS (SELECT feature, id, coalesce(c, 0) AS c FROM g LEFT JOIN c USING (feature, id)),
rk AS (SELECT feature, c, row_number() OVER (PARTITION BY feature ORDER BY c, id) AS i, count(*) OVER (PARTITION BY feature) AS n,
  sum(c) OVER (PARTITION BY feature) AS t FROM al)
SELECT feature, max(n) AS total, count(*) FILTER (c > 0) AS hit, count(*) FILTER (c > 0)::DOUBLE / max(n) AS hit_rate, max(c) AS max,
  2.0 * sum(i * c)::DOUBLE / (max(n) * max(t))::DOUBLE - (max(n) + 1.0) / max(n) AS gini,
  {', '.join(f'CAST(floor(quantile_cont(c, {p / 100}) FILTER (c > 0)) AS BIGINT) AS p{p}' for p in (25, 50, 75, 95))} FROM rk GROUP BY feature""")
def e25(spark, sf):
    log = event_log(spark, sf)
    values = log.select(F.inline(F.array(
        F.struct(F.lit("item").alias("feature"), F.col("item").alias("value")),
        F.struct(F.lit("user").alias("feature"), F.col("user_id").alias("value")))))
    return H.id_utilisation(values, VOCABULARIES)


@query("e26_spectral_rank")
def e26(spark, sf):
    r = V.spectral_rank(table(spark, sf, "embeddings"), "embedding")
    return spark.createDataFrame([(r["effective_rank"], r["information_abundance"])], "effective_rank double, information_abundance double")


# --- losses -------------------------------------------------------------------------------------

def bce_sql(z: str, y: str) -> str:
    return f"(greatest({z}, 0.0) + ln(1.0 + exp(-abs({z}))) - ({z}) * ({y}))"


SP = "ln(1.0 + exp(-abs({0}))) + greatest({0}, 0.0)"


def softplus_sql(x: str) -> str:
    return "(" + SP.format(x) + ")"


WEIGHTED = "(0.5 + (sample_id % 10) / 10.0)"


@query("e27_pointwise_losses", f"""WITH {IMP}, y AS (SELECT *, label * 0.9 + 0.05 AS ys, CASE WHEN label = 1 THEN prob ELSE 1 - prob END AS pt FROM imp)
SELECT avg(loss) AS bce, avg(2.0 * ys * {softplus_sql('-logit')} + (1 - ys) * {softplus_sql('logit')}) AS bce_pos_weight_smooth,
  sum({bce_sql('logit', 'ys')} * {WEIGHTED}) / sum({WEIGHTED}) AS bce_weighted,
  avg(CASE WHEN label = 1 THEN 0.25 ELSE 0.75 END * pow(1 - pt, 2.0) * loss) AS focal, avg(CASE WHEN label = 1 THEN 1.0 ELSE 1 - pt END * loss) AS asymmetric FROM y""")
def e27(spark, sf):
    return LS.pointwise_losses(predictions(spark, sf), weight=0.5 + (F.col("sample_id") % 10) / 10.0)


@query("e28_harmonised_loss", f"""WITH {IMP}, g AS (SELECT loss, least(floor(abs(prob - label) * 10), 9) AS b FROM imp),
w AS (SELECT loss, count(*) OVER () / count(*) OVER (PARTITION BY b)::DOUBLE AS w FROM g) SELECT sum(w * loss) / count(*) AS ghm, count(*) AS n FROM w""")
def e28(spark, sf):
    return LS.harmonised_loss(predictions(spark, sf))


@query("e29_hard_example_loss", f"""WITH {IMP}, k AS (SELECT greatest(1, CAST(floor(count(*) * 0.7) AS BIGINT)) AS n_keep FROM imp WHERE label = 0),
t AS (SELECT min(loss) AS cut FROM (SELECT loss, row_number() OVER (ORDER BY loss DESC) AS r FROM imp WHERE label = 0), k WHERE r <= n_keep)
SELECT avg(loss) AS ohem, count(*) AS n_kept FROM imp, t WHERE label = 1 OR loss >= cut""")
def e29(spark, sf):
    return LS.hard_example_loss(predictions(spark, sf))


@query("e30_frontier_loss", f"""WITH {IMP}, a AS (SELECT avg(CASE WHEN label = 1 THEN 1.0 ELSE prob END * loss) AS anchor FROM imp),
tn AS (SELECT logit AS t FROM imp WHERE label = 0 ORDER BY logit DESC LIMIT greatest(1, least(128, (SELECT CAST(round_even(0.2 * count(*), 0) AS BIGINT) FROM imp WHERE label = 0)))),
pr AS (SELECT sample_id, sum(1.0 / (1.0 + exp(-greatest(-40.0, least(40.0, -(logit - t) / 0.5)))) * {softplus_sql('-(logit - t)')}) /
  (sum(1.0 / (1.0 + exp(-greatest(-40.0, least(40.0, -(logit - t) / 0.5))))) + 1e-8) AS l FROM imp, tn WHERE label = 1 GROUP BY sample_id),
p AS (SELECT avg(l) AS pairwise FROM pr),
q AS (SELECT quantile_cont(logit, 0.95) AS c FROM imp WHERE label = 0),
f AS (SELECT avg({softplus_sql('logit')}) AS fp_guard FROM imp, q WHERE label = 0 AND logit >= c - 1e-12 * greatest(1.0, abs(c)))
SELECT anchor, pairwise, fp_guard, least(0.35 * anchor / (pairwise + 1e-8), 0.12) AS lambda_dynamic,
  anchor + least(0.35 * anchor / (pairwise + 1e-8), 0.12) * pairwise + 0.05 * fp_guard AS total FROM a, p, f""")
def e30(spark, sf):
    return LS.frontier_loss(predictions(spark, sf))


@query("e31_pairwise_losses", f"""WITH {PAIRS}, p AS (SELECT avg({softplus_sql('-m')}) AS pairwise FROM pairs),
b AS (SELECT avg(loss) AS bce, avg(CASE WHEN label = 1 THEN 1.0 ELSE prob END * loss) AS asym FROM imp)
SELECT pairwise, 0.85 * bce + 0.15 * pairwise AS ranking, 0.85 * asym + 0.15 * pairwise AS asymmetric_ranking FROM p, b""")
def e31(spark, sf):
    df = predictions(spark, sf)
    return LS.pairwise_losses(E.sampled_pairs(df, 200_000, 5), LS.pointwise_losses(df))


@query("e32_disagreement_loss", f"""WITH {VIEWS}, m AS (SELECT *, 1.0 / (1.0 + exp(-greatest(-40.0, least(40.0, 0.5 * (logit + logit_b))))) AS mp,
  least(1.0, greatest(0.1, exp(-abs(logit - logit_b) / 0.75))) AS rel FROM vl),
t AS (SELECT *, CASE WHEN label = 1 THEN 0.85 + 0.15 * mp ELSE 0.0 END AS tg, CASE WHEN label = 1 THEN rel ELSE mp END AS w FROM m)
SELECT avg(rel) FILTER (label = 1) AS mean_pos_reliability, avg(w) AS mean_weight, avg(w * 0.5 * ({bce_sql('logit', 'tg')} + {bce_sql('logit_b', 'tg')})) AS mean_loss FROM t""")
def e32(spark, sf):
    return LS.disagreement_loss(second_view(predictions(spark, sf)), "logit", "logit_b")


_SHOWN = {g: f"CASE WHEN c & {1 << i} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE" for i, g in enumerate(("score", "clicks", "purchases"))}


@query("e33_exact_group_values", f"""WITH {FULL_LENS}, z AS (SELECT range AS c, label, logit * 0.5 * {_SHOWN['score']} + seq_a_len * 0.125::DOUBLE * {_SHOWN['clicks']}
    - seq_c_len * 0.25::DOUBLE * {_SHOWN['purchases']} - 0.5::DOUBLE AS z FROM imp JOIN lens USING (sample_id), range(8)),
au AS ({auc_sql('z', 'z', 'c')}), lo AS (SELECT c, avg({bce_sql('z', 'label')}) AS loss FROM z GROUP BY c),
v AS (SELECT c, loss, coalesce(auc, 0.5) AS auc FROM au JOIN lo USING (c)),
g AS (SELECT unnest(['score', 'clicks', 'purchases']) AS name, unnest([1, 2, 4]) AS bit)
SELECT name AS "group", sum(w * (a.loss - b.loss)) AS loss_value, 0.0::DOUBLE AS loss_se, sum(w * (b.auc - a.auc)) AS auc_value, 0.0::DOUBLE AS auc_se,
  6::BIGINT AS n_permutations FROM g, (SELECT *, CASE WHEN bit_count(c) = 1 THEN 1 / 6::DOUBLE ELSE 1 / 3::DOUBLE END AS w FROM v) a JOIN v b ON b.c = a.c + bit
WHERE a.c & bit = 0 GROUP BY name""")
def e33_exact(spark, sf):
    """Exact Shapley values of three feature groups in a fixed linear scorer."""
    df = samples(spark, sf).select("sample_id", "label", F.col("logit").alias("x"), *[F.col(f"seq_{d}_raw_len").alias(f"n_{d}") for d in "ac"])

    def scorer(rows: DataFrame) -> DataFrame:
        return rows.withColumn("logit", F.col("x") * 0.5 + F.col("n_a") * 0.125 - F.col("n_c") * 0.25 - 0.5)

    return exact_importance(df, {"score": ["x"], "clicks": ["n_a"], "purchases": ["n_c"]}, scorer)


# --- set operations -----------------------------------------------------------------------------

@query("o1_set_overlap", f"""WITH {VIEWS} SELECT count(*) FILTER (a.sample_id IS NOT NULL AND b.sample_id IS NOT NULL) AS n_both, count(*) AS n_union,
  count(*) FILTER (b.sample_id IS NULL) AS n_left_only, count(*) FILTER (a.sample_id IS NULL) AS n_right_only,
  count(*) FILTER (a.sample_id IS NOT NULL AND b.sample_id IS NOT NULL)::DOUBLE / count(*) AS jaccard,
  count(*) FILTER (a.sample_id IS NULL)::DOUBLE / count(b.sample_id) AS entry_rate FROM ha a FULL JOIN hb b ON a.sample_id = b.sample_id""")
def o1(spark, sf):
    df = second_view(predictions(spark, sf))
    return P.set_overlap(E.hard_set(df, "loss"), E.hard_set(df, "loss_b"), "sample_id")


@query("o2_complementary_split", f"""WITH {IMP}{SPLIT} SELECT count(*) AS n_all, count(*) FILTER (ts < cutoff) AS n_train, count(*) FILTER (ts >= cutoff) AS n_valid,
  0::BIGINT AS n_both FROM imp, cut""")
def o2(spark, sf):
    df = P.time_split(predictions(spark, sf), "ts", 0.2).select("sample_id", "is_valid")
    sides = P.set_overlap(df.where(~F.col("is_valid")), df.where("is_valid"), "sample_id")
    return sides.select(F.col("n_union").alias("n_all"), F.col("n_left_only").alias("n_train"), F.col("n_right_only").alias("n_valid"), "n_both")


@query("o3_validation_only_rows", f"""WITH {IMP}{SPLIT} SELECT sample_id FROM imp, cut WHERE ts >= cutoff
  AND sample_id // 50 NOT IN (SELECT sample_id // 50 FROM imp, cut WHERE ts < cutoff)""")
def o3(spark, sf):
    df = P.time_split(predictions(spark, sf).select("sample_id", "ts"), "ts", 0.2)
    return P.validation_only_rows(df, F.floor(F.col("sample_id") / 50)).select("sample_id")
