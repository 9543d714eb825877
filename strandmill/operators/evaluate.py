"""Ranking metrics and reports over a prediction table.

A prediction table has ``sample_id``, ``label`` (0/1), ``logit``, ``prob`` and ``loss``.  Scores are
first collapsed to one row per distinct value with class counts, so ties cost nothing and ordering
work shrinks before it starts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions import scalars as S
from strandmill.operators.ranking import (
    TASK_ROWS, exact_quantiles, global_rank, running_totals, same_keys,
)
from strandmill.operators.splits import set_overlap, top_fraction_flags


def drop_nan_scores(df: DataFrame, logit: str = "logit") -> DataFrame:
    return df.where(~F.isnan(logit))


def auc_by(
    df: DataFrame, keys: Sequence[str], score: str = "prob", label: str = "label", task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Tie-aware ROC-AUC per key with ``n``, ``pos``; null when a class is missing."""
    hist = df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.count_if(F.col(label) > 0.5).alias("_p"), F.count_if(F.col(label) <= 0.5).alias("_q"))
    run = running_totals(hist, keys, [F.col("_s")], {"_below": F.col("_q")}, task_rows=task_rows)
    won = F.col("_p").cast("double") * (F.col("_below") - F.col("_q") + F.col("_q") / 2.0)
    agg = [F.sum(F.col("_p") + F.col("_q")).alias("n"), F.sum("_p").alias("pos"), F.sum(won).alias("_won"),
           F.sum("_q").alias("_neg")]
    out = run.groupBy(*keys).agg(*agg) if keys else run.agg(*agg)
    auc = F.try_divide(F.col("_won"), F.col("pos").cast("double") * F.col("_neg"))
    return out.select(*keys, "n", "pos", auc.alias("auc"))


def roc_auc(df: DataFrame, score: str = "prob", label: str = "label", task_rows: int = TASK_ROWS) -> DataFrame:
    """One row; 0.5 when only one class is present."""
    return auc_by(df, [], score, label, task_rows).select(F.coalesce("auc", F.lit(0.5)).alias("auc"))


def group_auc(
    df: DataFrame, group: str, score: str = "logit", label: str = "label", task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Row-weighted AUC over the groups that have both classes, and the share of such groups."""
    g = auc_by(df, [group], score, label, task_rows)
    covered = F.col("auc").isNotNull()
    return g.agg(
        F.coalesce(F.try_divide(F.sum(F.when(covered, F.col("auc") * F.col("n"))),
                                F.sum(F.when(covered, F.col("n")).cast("double"))), F.lit(0.5)).alias("gauc"),
        S.ratio(F.count_if(covered), F.count(F.lit(1))).alias("coverage"))


def domain_auc(
    df: DataFrame, domains: Mapping[str, Column], score: str = "prob", label: str = "label",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """AUC over the rows where each domain is present; domains with one class are skipped."""
    flags = F.filter(F.array(*[F.when(c, F.lit(d)) for d, c in domains.items()]), lambda d: d.isNotNull())
    rows = df.select(F.explode(flags).alias("domain"), score, label)
    return auc_by(rows, ["domain"], score, label, task_rows).where(F.col("auc").isNotNull()).select("domain", "auc")


def log_loss_report(df: DataFrame, prob: str = "prob", label: str = "label") -> DataFrame:
    return df.agg(F.coalesce(F.avg(S.log_loss(F.col(prob), F.col(label))), F.lit(0.0)).alias("logloss"))


def mean_calibration(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("prob").alias("mean_pred"), F.avg(F.col("label").cast("double")).alias("actual_rate"))


def binned_calibration(df: DataFrame, edges: Sequence[float], prob: str = "prob") -> DataFrame:
    """Counts, mean prediction and rate per bin ``[lo, hi)``, the last one closed."""
    p, last = F.col(prob), len(edges) - 2
    bin_ = F.when(p == float(edges[-1]), F.lit(last)).otherwise(S.edges_passed(p, edges, "right") - 1)
    inside = (p >= float(edges[0])) & (p <= float(edges[-1]))
    return df.where(inside).groupBy(bin_.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_pred"),
        F.avg(F.col("label").cast("double")).alias("actual_rate"))


def percentile_names(points: Sequence[float], prefix: str = "p") -> dict[str, float]:
    return {f"{prefix}{str(p).replace('.', '_')}": p / 100.0 for p in points}


def _beside(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side, each as scalar subqueries (no join)."""
    base, *rest = frames
    extra = {}
    for f in rest:
        packed = f.select(F.struct(*f.columns).alias("s")).scalar()
        extra |= {c: packed[c] for c in f.columns}
    return base.withColumns(extra)


def prediction_confidence(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Probability percentiles, mean binary entropy in bits, share outside [0.05, 0.95]."""
    p = S.clip(F.col("prob"), 1e-7, 1.0 - 1e-7)
    entropy = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    rest = df.agg(
        F.avg(entropy).alias("entropy"),
        F.avg(((F.col("prob") < 0.05) | (F.col("prob") > 0.95)).cast("double")).alias("high_conf"))
    return _beside(exact_quantiles(df, [], "prob", percentile_names([5, 25, 50, 75, 95]), task_rows), rest)


def logit_separation(
    df: DataFrame, points: Sequence[int] = (25, 50, 75), logit: str = "logit", task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Score percentiles per class, gap of the medians, share of negatives above the positive p25."""
    need = sorted(set(points) | {25, 50})
    side = df.select(F.when(F.col("label") == 1, "pos").otherwise("neg").alias("side"), logit)
    q = exact_quantiles(side, ["side"], logit, percentile_names(need), task_rows).collect()  # two rows
    if len(q) < 2:
        return df.sparkSession.createDataFrame([], "median_gap double, overlap double")
    by = {r["side"]: r for r in q}
    p25 = float(by["pos"]["p25"])
    cols = {f"{s}_p{p}": F.lit(float(by[s][f"p{p}"])) for s in ("neg", "pos") for p in points}
    gap = float(by["pos"]["p50"]) - float(by["neg"]["p50"])
    over = side.where(F.col("side") == "neg").agg(F.avg((F.col(logit) > p25).cast("double")).alias("overlap"))
    return over.select(*[c.alias(n) for n, c in cols.items()], F.lit(gap).alias("median_gap"), "overlap")


def loss_summary(df: DataFrame, loss: str = "loss", task_rows: int = TASK_ROWS) -> DataFrame:
    q = exact_quantiles(df, [], loss, percentile_names([5, 25, 50, 75, 95], "loss_p"), task_rows)
    return _beside(q, df.agg(F.stddev_pop(loss).alias("loss_std")))


HARD_FRACTIONS = {"top20": 5, "top10": 10, "top5": 20, "top1": 100}


def loss_concentration(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Share of all loss in the hardest 1/5/10/20 %, Herfindahl index, and two ratios."""
    flagged = top_fraction_flags(df.select("sample_id", "loss"), "loss", "sample_id", HARD_FRACTIONS, task_rows)
    sums = flagged.agg(
        F.sum("loss").alias("_t"), F.sum(F.col("loss") * F.col("loss")).alias("_sq"),
        *[F.sum(F.when(F.col(k), F.col("loss"))).alias(f"_{k}") for k in HARD_FRACTIONS])
    share = {k: F.col(f"_{k}") / F.col("_t") for k in HARD_FRACTIONS}
    return sums.where(F.col("_t") != 0).select(
        *[v.alias(f"{k}_frac") for k, v in share.items()],
        (F.col("_sq") / (F.col("_t") * F.col("_t"))).alias("loss_hhi"),
        (share["top1"] / F.greatest(share["top10"], F.lit(1e-12))).alias("top1_over_top10"),
        (share["top5"] / F.greatest(share["top20"], F.lit(1e-12))).alias("top5_over_top20"))


def hard_easy_profile(
    df: DataFrame, lengths: Mapping[str, str], raw_lengths: Mapping[str, str],
    recency: Mapping[str, str] | None = None, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """The hardest tenth against the rest: predictions, loss tail, domains, truncation, recency.

    The mappings go from domain to column name.
    """
    flagged = top_fraction_flags(df, "loss", "sample_id", {"is_hard": 10}, task_rows)
    n_domains = sum(((F.col(c) > 0).cast("double") for c in lengths.values()), F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("prob").alias("pred_mean"),
            F.avg(F.col("label").cast("double")).alias("pos_rate"), F.avg(n_domains).alias("n_domains")]
    for d, c in lengths.items():
        aggs.append(F.avg((F.col(c) > 0).cast("double")).alias(f"{d}_present"))
    for d, raw in raw_lengths.items():
        cut = 1.0 - F.col(lengths[d]) / F.greatest(F.col(raw).cast("double"), F.lit(1.0))
        aggs.append(F.avg(cut).alias(f"{d}_trunc"))
    for d, c in (recency or {}).items():
        aggs.append(F.avg(F.col(c).cast("double")).alias(f"{d}_recency"))
    out = flagged.groupBy("is_hard").agg(*aggs)
    tail = exact_quantiles(flagged, ["is_hard"], "loss", {"loss_p90": 0.9, "loss_p99": 0.99}, task_rows)
    raws = flagged.select("is_hard", F.inline(F.array(*[
        F.struct(F.lit(d).alias("_d"), F.col(raw).alias("_raw")) for d, raw in raw_lengths.items()])))
    medians = exact_quantiles(raws, ["is_hard", "_d"], "_raw", {"_m": 0.5}, task_rows).groupBy("is_hard").agg(*[
        F.max(F.when(F.col("_d") == d, F.col("_m"))).alias(f"{d}_raw_p50") for d in raw_lengths])
    return out.join(tail, "is_hard").join(medians, "is_hard")


def score_inversions(df: DataFrame, score: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Per distinct score: how many positives score no higher (``inv``)."""
    hist = df.groupBy(F.col(score).alias("_s")).agg(F.count_if(F.col("label") > 0.5).alias("_p"))
    return running_totals(hist, [], [F.col("_s")], {"inv": F.col("_p")}, task_rows=task_rows).select("_s", "inv")


def inversions(df: DataFrame, score: str = "logit", task_rows: int = TASK_ROWS) -> DataFrame:
    """Negatives with ``inv``: how many positives score no higher than they do."""
    upto = score_inversions(df, score, task_rows)
    negatives = df.where(F.col("label") <= 0.5)
    return negatives.join(upto, negatives[score] == upto["_s"]).drop("_s")


def rank_inversions(
    df: DataFrame, score: str = "logit", top_shares: Mapping[str, float] | None = None, pair_rows: int = 200_000,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Inverted (positive, negative) pairs: total, rate, standard error, share due to top negatives."""
    top_shares = top_shares or {"0_1": 0.001, "0_5": 0.005, "1": 0.01, "5": 0.05, "10": 0.10}
    totals = df.agg(F.count_if(F.col("label") > 0.5).alias("p"), F.count_if(F.col("label") <= 0.5).alias("q")).first()
    pos, neg = int(totals["p"]), int(totals["q"])
    tops = {f"top{k}neg": max(1, round(neg * s)) for k, s in top_shares.items()}
    hist = df.groupBy(F.col(score).alias("_s")).agg(
        F.count_if(F.col("label") > 0.5).alias("_p"), F.count_if(F.col("label") <= 0.5).alias("_q"))
    run = running_totals(hist, [], [F.col("_s")], {"_pu": F.col("_p"), "_qu": F.col("_q")}, task_rows=task_rows)
    above = F.lit(neg) - F.col("_qu")
    pairs = pos * neg
    sums = run.agg(
        F.sum(F.col("_q") * F.col("_pu")).alias("inv_total"),
        *[F.sum(F.least(F.greatest(F.lit(n) - above, F.lit(0)), F.col("_q")) * F.col("_pu")).alias(f"_{k}")
          for k, n in tops.items()])
    rate = S.ratio(F.col("inv_total"), F.lit(pairs))
    return sums.select(
        "inv_total", F.lit(pairs).cast("long").alias("pair_n"), rate.alias("inv_rate"),
        F.sqrt(F.greatest(rate * (1.0 - rate), F.lit(0.0)) / float(max(1, min(pair_rows, pairs)))).alias("inv_rate_se"),
        *[S.ratio(F.col(f"_{k}"), F.col("inv_total")).alias(f"inv_{k}_frac") for k in tops])


def sampled_pairs(
    df: DataFrame, pairs: int, seed: int, columns: Sequence[str] = ("logit",), task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``pairs`` uniform (positive, negative) pairs: two independent draws of a class rank per pair.

    Pairs meet their rows by an equi-join on (class, rank); no pair grid is ever formed.
    """
    ranked = running_totals(
        df.select("sample_id", "label", *columns), ["label"], [F.col("sample_id")],
        {"_rank": F.lit(1).cast("long")}, task_rows=task_rows)
    sizes = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return df.sparkSession.createDataFrame([], "pair long, pos_logit double, neg_logit double")
    ids = df.sparkSession.range(pairs).withColumnRenamed("id", "pair")
    picks = ids.withColumns({
        "_pr": F.floor(S.draw(seed, F.lit("pos"), F.col("pair")) * int(sizes[1])) + 1,
        "_nr": F.floor(S.draw(seed, F.lit("neg"), F.col("pair")) * int(sizes[0])) + 1})
    side = {
        name: ranked.where(F.col("label") == value).select(
            F.col("_rank").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("sample_id", *columns)])
        for name, value, key in (("pos", 1, "_pr"), ("neg", 0, "_nr"))}
    return picks.join(side["pos"], "_pr").join(side["neg"], "_nr").drop("_pr", "_nr")


def margin_distribution(
    pairs: DataFrame, points: Sequence[int] = (1, 5, 10, 25, 50, 75, 90),
    eps: Sequence[float] = (0.01, 0.03, 0.05, 0.10, 0.20), task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Percentiles of positive - negative margins and shares of near-zero margins."""
    m = pairs.select((F.col("pos_logit") - F.col("neg_logit")).alias("margin"))
    near = m.agg(*[
        F.avg((F.abs(F.col("margin")) < e).cast("double")).alias(f"near_zero_e{str(e).replace('.', '_')}") for e in eps])
    return _beside(exact_quantiles(m, [], "margin", percentile_names(points, "margin_p"), task_rows), near)


def quantile_edges(
    df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[float]]], task_rows: int = TASK_ROWS,
) -> dict[str, list[float]]:
    """Quantile edges of several columns in one pass (a few numbers each)."""
    size = max(len(p) for _, p in wanted.values())
    rows = df.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("_k"), c.cast("double").alias("_v")) for k, (c, _) in wanted.items()])))
    every = sorted({float(p) for _, probs in wanted.values() for p in probs})
    names = {f"q{i}": p for i, p in enumerate(every)}
    got = {r["_k"]: r for r in exact_quantiles(rows, ["_k"], "_v", names, task_rows).collect()}
    place = {p: n for n, p in names.items()}
    return {k: [float(got[k][place[float(p)]]) for p in probs] for k, (_, probs) in wanted.items() if k in got and size}


def bucket_of(value: Column, edges: Sequence[float], unique: bool = True) -> Column:
    """Bucket number among quantile edges (upper edges closed)."""
    edges = sorted(set(edges)) if unique else list(edges)
    return S.edges_passed(value, edges, "left") if edges else F.lit(0)


def distorted_slices(
    df: DataFrame, lengths: Sequence[str], raw_lengths: Mapping[str, str] | None = None, score: str = "logit",
    top_k: int | None = None, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Slices by score decile, active domains and truncation: their shares and distortion.

    ``raw_lengths`` maps a length column to its column before truncation.
    """
    work = df.select(
        "sample_id", "label", "loss", score,
        sum(((F.col(c) > 0).cast("long") for c in lengths), F.lit(0).cast("long")).alias("_nd"),
        (sum((1.0 - F.col(c) / F.greatest(F.col(r).cast("double"), F.lit(1.0))
              for c, r in (raw_lengths or {}).items()), F.lit(0.0)) / float(max(1, len(raw_lengths or {})))).alias("_cut"))
    wanted = {"score_decile": (F.col(score), [i / 10 for i in range(1, 10)])}
    if raw_lengths:
        wanted["trunc_quintile"] = (F.col("_cut"), [0.2, 0.4, 0.6, 0.8])
    edges = quantile_edges(work, wanted, task_rows)
    kinds = [(k, bucket_of(c, edges.get(k, []))) for k, (c, _) in wanted.items()] + [("n_domains", F.col("_nd"))]
    upto = score_inversions(work, score, task_rows)
    tagged = work.join(upto, work[score] == upto["_s"], "left").select(
        "label", "loss", score, F.when(F.col("label") <= 0.5, F.col("inv")).alias("inv"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), b.cast("long").alias("bucket")) for k, b in kinds])))
    aucs = auc_by(tagged, ["kind", "bucket"], score, task_rows=task_rows).select("kind", "bucket", F.col("auc").alias("slice_auc"))
    sums = tagged.groupBy("kind", "bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("loss").alias("_l"), F.coalesce(F.sum("inv"), F.lit(0)).alias("_i"))
    # Every kind holds each row once, so its own few buckets add up to the whole table.
    kind = Window.partitionBy("kind")
    sums = sums.withColumns({f"_t{c}": F.sum(c).over(kind) for c in ("_n", "_l", "_i")})
    sample, inverted = S.ratio(F.col("_n"), F.col("_t_n")), S.ratio(F.col("_i"), F.col("_t_i"))
    out = sums.join(aucs, ["kind", "bucket"], "left").select(
        "kind", "bucket", sample.alias("sample_share"), S.ratio(F.col("_l"), F.col("_t_l")).alias("loss_share"),
        inverted.alias("inv_share"), (inverted / F.greatest(sample, F.lit(1e-12))).alias("distortion"), "slice_auc")
    return out if top_k is None else out.orderBy(F.desc("distortion"), "kind", "bucket").limit(top_k)


def hard_set(df: DataFrame, loss: str = "loss", task_rows: int = TASK_ROWS) -> DataFrame:
    """Ids of the hardest tenth."""
    return top_fraction_flags(df.select("sample_id", loss), loss, "sample_id", {"hard": 10}, task_rows).where(
        "hard").select("sample_id")


def hard_set_churn(previous: DataFrame, current: DataFrame) -> DataFrame:
    return set_overlap(previous, current, "sample_id").select(
        F.col("jaccard").alias("hard_jaccard"), F.col("entry_rate").alias("hard_entry_rate"))


def hub_negatives(df: DataFrame, keys: Sequence[str] = (), score: str = "logit", share: float = 0.01, task_rows: int = TASK_ROWS) -> DataFrame:
    """Per key, ids of the negatives with the most inverted pairs (at least one, ties by id).

    A negative's inversions never fall as its score rises, so the score orders them and no pair is counted.
    """
    negatives = df.where(F.col("label") <= 0.5).select(*keys, "sample_id", score)
    ranked = global_rank(negatives, [F.col(score).desc(), F.col("sample_id")], "_rank", keys, task_rows)
    known = [f"_k{i}" for i in range(len(keys))]
    sizes = negatives.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, known, strict=True)]).agg(
        F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(float(share)))).alias("_top"))
    return ranked.join(F.broadcast(sizes) if not keys else sizes, same_keys(keys, known)).where(
        F.col("_rank") <= F.col("_top")).select(*keys, "sample_id")


def successive_churn(sets: DataFrame, step: str, prefix: str) -> DataFrame:
    """Jaccard and entry rate of each step's id set against the step before (columns ``step``, ``sample_id``).

    Every id meets itself in the neighbouring step in one aggregate; the list of steps is as long as the evaluation history.
    """
    rows = sets.select(F.col(step).alias("_step"), "sample_id").distinct()
    steps = rows.select("_step").distinct().withColumn("_next", F.lead("_step").over(Window.orderBy("_step")))
    sides = rows.join(steps, "_step").select("sample_id", F.inline(F.array(
        F.struct(F.col("_next").alias(step), F.lit(1).alias("_old"), F.lit(0).alias("_new")),
        F.struct(F.col("_step").alias(step), F.lit(0).alias("_old"), F.lit(1).alias("_new"))))).where(F.col(step).isNotNull())
    met = sides.groupBy(step, "sample_id").agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    old, new = F.col("_old") == 1, F.col("_new") == 1
    out = met.groupBy(step).agg(
        S.ratio(F.count_if(old & new), F.count(F.lit(1))).alias(f"{prefix}_jaccard"),
        S.ratio(F.count_if(new & ~old), F.count_if(new)).alias(f"{prefix}_entry_rate"), F.max("_old").alias("_old"))
    return out.where("_old = 1").drop("_old")  # the first step has none before it


AUC_SOURCES = {"seq_len", "active_domain_count", "primary_domain"}


def bucket_memberships(
    df: DataFrame, lengths: Sequence[str], loss_cuts: Mapping | None = None, score_cuts: Mapping | None = None,
    length_edges: Mapping[str, Sequence[int]] | None = None, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Rows exploded over the buckets they belong to (``bucket``, ``source``).

    The cut mappings hold ``quantiles`` and ``labels``; the score band ranks positives by falling and
    negatives by rising probability, so high bands are the easy ones to get wrong.
    """
    hardness = F.when(F.col("label") > 0.5, -F.col("prob")).otherwise(F.col("prob"))
    cuts = {"loss": (F.col("loss"), loss_cuts), "score_band": (hardness, score_cuts)}
    cuts = {k: (c, cfg) for k, (c, cfg) in cuts.items() if cfg}
    found = quantile_edges(df, {k: (c, cfg["quantiles"]) for k, (c, cfg) in cuts.items()}, task_rows) if cuts else {}
    tags: list[Column] = [F.struct(F.lit("all").alias("bucket"), F.lit("all").alias("source"))]

    def tag(bucket: Column, source: str) -> None:
        tags.append(F.struct(bucket.alias("bucket"), F.lit(source).alias("source")))

    for k, (c, cfg) in cuts.items():
        tag(F.get(F.array(*[F.lit(x) for x in cfg["labels"]]), bucket_of(c, found[k], unique=False)), k)
    for col, edges in (length_edges or {}).items():
        v = F.col(col)
        cases = None
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            inside = ((v >= lo) if i == 0 else (v > lo)) & (v <= hi)
            label = F.lit(f"{col}_{lo}_to_{hi}")
            cases = F.when(inside, label) if cases is None else cases.when(inside, label)
        tag(cases.when(v > edges[-1], F.lit(f"{col}_gt_{edges[-1]}")), "seq_len")
    active = sum(((F.col(c) > 0).cast("long") for c in lengths), F.lit(0).cast("long"))
    tag(F.concat(F.lit("active_domains_"), active.cast("string")), "active_domain_count")
    best = F.greatest(*[F.col(c) for c in lengths])
    primary = F.when(best <= 0, F.lit("primary_domain_none"))
    for c in lengths:
        primary = primary.when(F.col(c) == best, F.lit(f"primary_domain_{c.removesuffix('_len')}"))
    tag(primary, "primary_domain")
    return df.select("*", F.inline(F.array(*tags))).where(F.col("bucket").isNotNull())


def bucket_names(lengths: Sequence[str], loss_cuts: Mapping | None = None, score_cuts: Mapping | None = None,
                 length_edges: Mapping[str, Sequence[int]] | None = None) -> list[tuple[str, str]]:
    """(bucket, source) of every bucket that ``bucket_memberships`` can give with the same configuration."""
    out = [("all", "all")]
    out += [(label, source) for source, cfg in (("loss", loss_cuts), ("score_band", score_cuts)) if cfg for label in cfg["labels"]]
    for col, edges in (length_edges or {}).items():
        out += [(f"{col}_{lo}_to_{hi}", "seq_len") for lo, hi in zip(edges[:-1], edges[1:], strict=True)] + [(f"{col}_gt_{edges[-1]}", "seq_len")]
    out += [(f"active_domains_{n}", "active_domain_count") for n in range(len(lengths) + 1)]
    return out + [(f"primary_domain_{c.removesuffix('_len')}", "primary_domain") for c in [*lengths, "none"]]


def bucket_outcomes(
    members: DataFrame, min_n: int = 50, min_pos: int = 5, task_rows: int = TASK_ROWS, buckets: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Denominators and outcomes per bucket, with AUC only for the length and domain families.

    ``buckets`` are all (bucket, source) that could have members: one without any gets a row with n = 0, no outcomes and
    the reason ``empty``.
    """
    keys = ["bucket", "source"]
    base = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") > 0.5).alias("pos"),
        F.avg("loss").alias("logloss"), F.avg("prob").alias("mean_pred"))
    aucs = auc_by(members.where(F.col("source").isin(*sorted(AUC_SOURCES))), keys, "prob", task_rows=task_rows)
    out = base.join(aucs.select(*keys, "auc"), keys, "left")
    if buckets is not None:
        # A list as long as the configuration.
        every = members.sparkSession.createDataFrame(list(buckets), "bucket string, source string")
        out = F.broadcast(every).join(out, keys, "full").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "pos")})
    valid = (F.col("n") >= min_n) & (F.col("pos") >= min_pos)
    return out.select(
        *keys, "n", "pos", F.when(F.col("n") > 0, F.col("pos") / F.greatest("n", F.lit(1))).alias("pos_rate"), valid.cast("long").alias("valid"),
        F.when(valid, "").when(F.col("n") == 0, "empty").when(F.col("n") < min_n, "min_bucket_n").otherwise("min_bucket_pos").alias("skip"),
        "logloss", "mean_pred", "auc")


def pair_cosine(members: DataFrame, left: Column, right: Column, min_n: int = 50, min_pos: int = 5) -> DataFrame:
    """Mean cosine of two equally wide vectors per bucket and class, and their gap."""
    from strandmill.functions import arrays as A

    cos = A.dot(left, right) / ((A.norm(left) + 1e-8) * (A.norm(right) + 1e-8))
    rows = members.withColumn("_cos", F.when(F.size(left) == F.size(right), cos)).where(F.col("_cos").isNotNull())
    is_pos = F.col("label") > 0.5
    out = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_pos).alias("pos"),
        F.avg(F.when(is_pos, F.col("_cos"))).alias("pos_mean"), F.avg(F.when(~is_pos, F.col("_cos"))).alias("neg_mean"))
    return out.where(
        (F.col("n") >= min_n) & (F.col("pos") >= min_pos) & F.col("pos_mean").isNotNull() & F.col("neg_mean").isNotNull()
    ).withColumn("gap", F.col("pos_mean") - F.col("neg_mean"))
