"""Row-local sequence features on the wide sample table (arrays of event structs, no shuffle).

A domain column is ``array<struct<ts, action, item, category, campaign, advertiser>>``; the
impression time column is ``ts``.  A later event than the impression counts as gap 0.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import arrays as A
from strandmill.functions import scalars as S

# Upper edges in seconds of the 63 recency buckets.
RECENCY_EDGES = [
    5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60,
    120, 180, 240, 300, 360, 420, 480, 540, 600,
    900, 1200, 1500, 1800, 2100, 2400, 2700, 3000, 3300, 3600,
    5400, 7200, 9000, 10800, 12600, 14400, 16200, 18000, 19800, 21600,
    32400, 43200, 54000, 64800, 75600, 86400,
    172800, 259200, 345600, 432000, 518400, 604800,
    1123200, 1641600, 2160000, 2592000,
    4320000, 6048000, 7776000, 11664000, 15552000, 31536000,
]
# Default thresholds and normalisers.
LENGTH_EDGES = [1, 10, 50, 100, 200, 500, 1000]
RECENT_FLAGS = [300, 3600, 86400]
CONVERSION_WINDOWS = [3600, 86400, 604800]
MAX_LENGTH = 4000
YEAR = 31536000


def valid_events(seq: Column) -> Column:
    return F.filter(seq, lambda e: e["ts"] > 0)


def gap(imp_ts: Column, event_ts: Column) -> Column:
    return F.greatest(imp_ts - event_ts, F.lit(0).cast("long"))


def count_events(seq: Column, predicate) -> Column:
    return F.size(F.filter(seq, predicate)).cast("long")


def last_gap(seq: Column, imp_ts: Column) -> Column:
    """Seconds since the latest valid event; null when there is none."""
    latest = F.array_max(F.transform(valid_events(seq), lambda e: e["ts"]))
    return gap(imp_ts, latest) + F.when(latest.isNull(), F.lit(None).cast("long")).otherwise(F.lit(0))


def log_share(count: Column, top: float) -> Column:
    return F.log1p(count.cast("double")) / math.log1p(top)


def dense_sequence_stats(
    seq: Column, imp_ts: Column, length: Column | None = None, length_bucket: bool = True,
    gap_log: bool = True, gap_missing: bool = True, recent: Sequence[int] | None = RECENT_FLAGS,
    max_length: int = MAX_LENGTH, max_gap: int = YEAR, length_edges: Sequence[int] = LENGTH_EDGES,
    missing_value: float = 1.0, since: Column | None = None,
) -> dict[str, Column]:
    """Presence, length and recency summary of one domain, in the order of the feature vector; ``since`` is a known ``last_gap``."""
    n = length if length is not None else F.size(seq)
    since = since if since is not None else last_gap(seq, imp_ts)
    out = {
        "present": (n > 0).cast("double"),
        "empty": (n <= 0).cast("double"),
        "len_log": log_share(F.least(n, F.lit(max_length)), max_length),
    }
    if length_bucket:
        out["len_bucket"] = S.edges_passed(n, length_edges, "right") / float(max(len(length_edges), 1))
    if gap_log:
        out["last_gap_log"] = F.coalesce(log_share(S.clip(since, hi=max_gap), max_gap), F.lit(missing_value))
    if gap_missing:
        out["gap_missing"] = since.isNull().cast("double") * missing_value
    for t in sorted(recent or []):
        out[f"recent_{t}"] = F.coalesce((since <= t).cast("double"), F.lit(0.0))
    return out


def time_bucket(event_ts: Column, imp_ts: Column) -> Column:
    """Recency bucket 1..63 of one event; 0 for a missing timestamp."""
    edges = S.edges_passed(gap(imp_ts, event_ts), RECENCY_EDGES, "left")
    return F.when(event_ts == 0, F.lit(0)).otherwise(F.least(edges, F.lit(len(RECENCY_EDGES) - 1)) + 1)


def time_buckets(seq: Column, imp_ts: Column) -> Column:
    return F.transform(seq, lambda e: time_bucket(e["ts"], imp_ts))


def newest_first(seq: Column, ceiling: int) -> Column:
    """Newest ``ceiling`` events, stable among equal timestamps.

    A sequence that already never increases keeps its order, which the same stable sort gives.
    """
    keyed = F.transform(seq, lambda e, i: F.struct((-e["ts"]).alias("k"), i.alias("i"), e.alias("e")))
    return F.transform(F.slice(F.sort_array(keyed), 1, ceiling), lambda s: s["e"])


def truncate(df: DataFrame, ceilings: Mapping[str, int]) -> DataFrame:
    """Sort and cut each domain, recording the length before the cut; a ``{domain}_raw_len`` already there stays.

    The sample table may hold the newest events alone; its own lengths count the whole log.
    """
    out: dict[str, Column] = {}
    for domain, ceiling in ceilings.items():
        if f"{domain}_raw_len" not in df.columns:
            out[f"{domain}_raw_len"] = F.size(domain).cast("long")
        out[domain] = newest_first(F.col(domain), ceiling)
        out[f"{domain}_len"] = F.least(F.size(domain).cast("long"), F.lit(ceiling).cast("long"))
    return df.withColumns(out)


# Run-count bucket edges; last position / size of each session bucket but the open one.
RUN_EDGES = [2, 5, 10, 25, 50, 100, 200]
POSITION_EDGES = [2, 3, 4, 6, 11]
SESSION_SIZE_EDGES = [2, 3, 5, 9, 17]


def run_bucket(count: Column, edges: Sequence[int] = RUN_EDGES) -> Column:
    """1 for a single event, else one more than the edges reached."""
    return F.when(count == 1, F.lit(1)).otherwise(S.edges_passed(count, edges, "right") + 1)


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _by_time(domain: str) -> Column:
    return F.sort_array(F.transform(domain, lambda e, i: F.struct(e["ts"].alias("k"), i.alias("i"), e.alias("e"))))


def compress_runs(
    df: DataFrame, domain: str, action: str, item: str, protect_recent: int = 0, edges: Sequence[int] = RUN_EDGES,
) -> DataFrame:
    """Run-length compression inside the row: the last event of each run, with its ``run_bucket``.

    Row form of ``sequence_rows.run_length_compress``; one narrow projection, no shuffle.
    """
    by_time = _by_time(domain)

    def starts(rows: Column, i: Column) -> Column:
        n, here, prev = F.size(rows), F.get(rows, i)["e"], F.get(rows, i - 1)["e"]
        new = (i == 0) | (here[action] != prev[action]) | (here[item] != prev[item])
        return new | ((n > protect_recent) & (i >= n - protect_recent)) if protect_recent > 0 else new

    def keep(rows: Column, first: Column, start: Column, j: Column) -> Column:
        end = F.coalesce(F.get(first, j + 1), F.size(rows)) - 1
        return F.get(rows, end)["e"].withField("run_bucket", run_bucket(end - start + 1, edges))

    out = A.let(by_time, lambda rows: A.let(
        F.filter(_positions(F.size(rows)), lambda i: starts(rows, i)),
        lambda first: F.transform(first, lambda start, j: keep(rows, first, start, j))))
    return df.withColumn(domain, out)


def compress_budget(
    df: DataFrame, domain: str, group: Sequence[str], diverse: str, cap: int, protect_recent: int = 0, edges: Sequence[int] = RUN_EDGES,
) -> DataFrame:
    """Budget compression inside the row; every kept event gets its ``run_bucket``.

    Row form of ``sequence_rows.budget_compress``; no shuffle.  Work in a row grows with the square of its sequence's length at most.
    """
    if protect_recent > cap:
        raise ValueError("protect_recent cannot exceed cap")

    def times(rows: Column) -> Column:
        return F.transform(rows, lambda r: r["k"])

    def group_of(r: Column) -> Column:
        return F.struct(*[r["e"][g].alias(g) for g in group])

    def ranked(rows: Column, lo: Column, hi: Column, g: Column) -> Column:
        """The events of one group in the order of their slots, before each what it is picked by."""
        def score(mine: Column, r: Column) -> Column:
            newest = F.array_max(times(F.filter(mine, lambda x: x["e"][diverse].eqNullSafe(r["e"][diverse]))))
            return (r["k"] == newest).cast("double") * 2.0 + S.ratio(r["k"] - lo, hi - lo)

        def slot(r: Column, j: Column, count: Column, latest: Column) -> Column:
            return F.struct(
                j.alias("r"), F.when(j == 0, F.lit(0)).otherwise(j - count).alias("later"), latest.isNull().alias("never"), (-latest).alias("latest"),
                g.alias("g"), count.alias("count"), r.alias("row"))

        def scored(mine: Column) -> Column:
            keyed = F.transform(mine, lambda r: A.let(score(mine, r), lambda v: F.struct(
                v.isNull().alias("none"), (-v).alias("s"), r["i"].alias("i"), r["k"].alias("k"), r["e"].alias("e"))))
            return A.let(F.array_max(times(mine)), lambda latest: F.transform(
                F.sort_array(keyed), lambda r, j: slot(r, j, F.size(mine), latest)))

        return A.let(F.filter(rows, lambda r: group_of(r).eqNullSafe(g)), scored)

    def cut(rows: Column) -> Column:
        """The events beyond the protected ones, within the budget and in order."""
        groups = F.array_distinct(F.transform(rows, group_of))
        slots = A.let(F.array_min(times(rows)), lambda lo: A.let(F.array_max(times(rows)), lambda hi: F.flatten(
            F.transform(groups, lambda g: ranked(rows, lo, hi, g)))))
        picked = F.transform(F.slice(F.sort_array(slots), 1, cap - protect_recent), lambda s: F.struct(
            s["row"]["k"].alias("k"), s["g"].alias("g"), s["row"]["s"].alias("s"), s["row"]["i"].alias("i"), s["count"].alias("count"), s["row"]["e"].alias("e")))
        return F.transform(F.sort_array(picked), lambda s: s["e"].withField("run_bucket", run_bucket(s["count"], edges)))

    def single(events: Column) -> Column:
        return F.transform(events, lambda e: e.withField("run_bucket", F.lit(1)))

    def long(rows: Column) -> Column:
        n = F.size(rows) - protect_recent
        recent = F.transform(F.slice(rows, n + 1, F.lit(protect_recent)), lambda r: r["e"])
        return F.concat(A.let(F.slice(rows, F.lit(1), n), cut), single(recent))

    out = F.when(F.size(domain) > cap, A.let(_by_time(domain), long)).otherwise(single(F.col(domain)))
    return df.withColumn(domain, out)


def add_session_state(
    df: DataFrame, domain: str, threshold: int = 3600, gap_buckets: int = 64, category: str | None = None,
    daypart: bool = False, weekend: bool = False,
) -> DataFrame:
    """Gap, session, position and transition fields on every event, inside the row.

    Row form of ``sequence_rows.session_state``; needs the ``time_bucket`` field.
    """
    edges = F.array(*[F.lit(float(e)) for e in [0, *RECENCY_EDGES]])
    old = df.schema[domain].dataType.elementType.fieldNames()

    def approx(bucket: Column) -> Column:
        return F.get(edges, F.least(F.greatest(bucket, F.lit(0)), F.lit(len(RECENCY_EDGES))))

    def fresh(t: Column, i: Column) -> Column:
        here, far = F.get(t, i), F.abs(approx(F.get(t, i)) - approx(F.get(t, i - 1))) > float(threshold)
        return (here > 0) & ((i == 0) | far)

    def valid_in(t: Column, first: Column, length: Column) -> Column:
        return F.size(F.filter(F.slice(t, first + 1, length), lambda b: b > 0))

    def coded(valid: Column, yes: Column) -> Column:
        return F.when(~valid, F.lit(0)).when(yes, F.lit(2)).otherwise(F.lit(1))

    def grow(t: Column, new: Column, begins: Column, e: Column, i: Column) -> Column:
        valid, is_new = e["time_bucket"] > 0, F.get(new, i)
        follows = (F.coalesce(F.get(t, i + 1), F.lit(0)) > 0) & ~F.coalesce(F.get(new, i + 1), F.lit(True))
        session = F.size(F.filter(begins, lambda s: s <= i))
        first = F.when(session > 0, F.get(begins, session - 1)).otherwise(0)
        after = F.coalesce(F.get(begins, session), F.size(t))
        step = F.least(F.abs(F.get(t, i) - F.get(t, i - 1)), F.lit(gap_buckets - 1))
        fields = {
            "gap": F.when(i == 0, F.lit(0)).otherwise(step), "ss_prev": coded(valid, ~is_new),
            "ss_next": coded(valid, follows), "ss_bnd": coded(valid, is_new | ~follows),
            "ss_pos": F.when(valid, S.edges_passed(valid_in(t, first, i - first + 1), POSITION_EDGES, "right") + 1).otherwise(0),
            "ss_len": F.when(valid, S.edges_passed(valid_in(t, first, after - first), SESSION_SIZE_EDGES, "right") + 1).otherwise(0),
        }
        if daypart:
            fields["daypart"] = event_daypart(e["ts"])
        if weekend:
            fields["weekend"] = event_weekend(e["ts"])
        return F.struct(*[e[f].alias(f) for f in old if f not in fields], *[c.alias(f) for f, c in fields.items()])

    def transitions(rows: Column, e: Column, i: Column) -> Column:
        cur = e[category]
        prev = F.coalesce(F.get(rows, i - 1)[category], F.lit(0))
        nxt = F.coalesce(F.get(rows, i + 1)[category], F.lit(0))
        has_prev, has_next = (cur > 0) & (prev > 0), (cur > 0) & (nxt > 0)
        fields = {
            "cat_same_prev": F.when(~has_prev, 0).when(cur == prev, 2).otherwise(1),
            "cat_same_next": F.when(~has_next, 0).when(cur == nxt, 2).otherwise(1),
            "cat_change": F.when(~has_prev, 0).when(cur != prev, 2).otherwise(1),
        }
        for name, value in fields.items():
            e = e.withField(name, value)
        return e

    def rebuilt(rows: Column) -> Column:
        return A.let(F.transform(rows, lambda e: e["time_bucket"]), lambda t: A.let(
            F.transform(_positions(F.size(t)), lambda i: fresh(t, i)), lambda new: A.let(
                F.filter(_positions(F.size(t)), lambda i: F.get(new, i)),
                lambda begins: F.transform(rows, lambda e, i: grow(t, new, begins, e, i)))))

    out = A.let(F.col(domain), rebuilt)
    if category:
        out = A.let(out, lambda rows: F.transform(rows, lambda e, i: transitions(rows, e, i)))
    return df.withColumn(domain, out)


def impression_time_categories(ts: Column) -> dict[str, Column]:
    hour, weekday = S.hour_id(ts), S.weekday_id(ts)
    weekend, daypart = S.weekend_from_weekday(weekday), S.daypart_from_hour(hour)
    return {
        "time_hour": hour,
        "time_weekday": weekday,
        "time_weekend": weekend,
        "time_daypart": daypart,
        "time_weekpart_daypart": (weekend - 1) * 6 + daypart,
        "time_hour_weekend": (weekend - 1) * 24 + hour,
    }


def event_hour(event_ts: Column) -> Column:
    return F.when(event_ts == 0, F.lit(0)).otherwise(S.hour_id(event_ts))


def event_weekday(event_ts: Column) -> Column:
    return F.when(event_ts == 0, F.lit(0)).otherwise(S.weekday_id(event_ts))


def event_daypart(event_ts: Column) -> Column:
    return F.when(event_ts == 0, F.lit(0)).otherwise(S.daypart_from_hour(S.hour_id(event_ts)))


def event_weekend(event_ts: Column) -> Column:
    return F.when(event_ts == 0, F.lit(0)).otherwise(S.weekend_from_weekday(S.weekday_id(event_ts)))


def window_name(seconds: int) -> str:
    for unit, size in (("d", 86400), ("h", 3600), ("m", 60)):
        if seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds}s"


def conversion_counts(
    df: DataFrame, domains: Sequence[str], windows: Sequence[int] = CONVERSION_WINDOWS,
) -> DataFrame:
    """Recent-event counts from the arrays: ``{domain}_n`` and ``{domain}_n_{window}``."""
    imp = F.col("ts")
    gaps = {f"_g_{d}": F.transform(valid_events(F.col(d)), lambda e: gap(imp, e["ts"])) for d in domains}
    out: dict[str, Column] = {}
    for d in domains:
        out[f"{d}_n"] = F.size(f"_g_{d}").cast("long")
        for w in windows:
            out[f"{d}_n_{window_name(w)}"] = F.size(F.filter(f"_g_{d}", lambda g: g <= w)).cast("long")
    return df.withColumns(gaps).withColumns(out).drop(*gaps)


def conversion_state(
    domains: Sequence[str], windows: Sequence[int] = CONVERSION_WINDOWS, max_length: float = MAX_LENGTH,
) -> dict[str, Column]:
    """Counts, ratios and global activity state from ``{domain}_n`` / ``{domain}_n_{window}``."""
    windows = sorted(windows)
    suffix = [window_name(w) for w in windows]
    c = {(d, s): F.col(f"{d}_n_{s}").cast("double") for d in domains for s in suffix}
    n = {d: F.col(f"{d}_n").cast("double") for d in domains}

    def plus(values):
        values = list(values)
        out = values[0]
        for v in values[1:]:
            out = out + v
        return out

    out: dict[str, Column] = {}
    for d in domains:
        for s in suffix:
            out[f"conv_state_{d}_recent_count_le_{s}"] = log_share(c[d, s], max_length)
    for d in domains:
        for s in suffix:
            out[f"conv_state_{d}_recent_ratio_le_{s}"] = c[d, s] / F.greatest(n[d], F.lit(1.0))
    for s in suffix:
        active = plus((c[d, s] > 0).cast("double") for d in domains)
        out[f"conv_state_active_domains_le_{s}"] = active / float(max(len(domains), 1))
        out[f"conv_state_any_domain_recent_le_{s}"] = (active > 0).cast("double")
    whole = plus(n.values())
    shares = [v / F.greatest(whole, F.lit(1.0)) for v in n.values()]
    entropy = plus(-(p * F.log(F.greatest(p, F.lit(1e-8)))) for p in shares)
    out["conv_state_len_entropy_norm"] = entropy / math.log(max(len(domains), 2)) + 0.0
    recent = [plus(c[d, s] for d in domains) for s in suffix]
    zero = F.lit(0.0)
    out["conv_state_burst_ratio_t0_over_t1"] = (
        F.log1p(recent[0]) / F.log1p(recent[1] + 1.0) if len(windows) >= 2 else zero)
    out["conv_state_burst_ratio_t1_over_t2"] = (
        F.log1p(recent[1]) / F.log1p(recent[2] + 1.0) if len(windows) >= 3 else zero)
    out["conv_state_total_recent_t0_log_norm"] = log_share(recent[0], max_length) if windows else zero
    out["conv_state_total_recent_t1_log_norm"] = log_share(recent[1], max_length) if len(windows) >= 2 else zero
    out["conv_state_total_len_log_norm"] = log_share(whole, max_length)
    return out


def target_evidence(
    seq: Column, imp_ts: Column, target: Column, field: str, item_id: Column,
    thresholds: Sequence[int] = (3600, 86400, 604800), max_length: int = MAX_LENGTH,
    max_gap: int = YEAR, missing_value: float = 1.0, max_action: int = 32,
) -> dict[str, Column]:
    """Eight statistics of the history events whose ``field`` equals the target.

    A non-positive item or an empty history leaves all eight at 0; a known history without a match
    sets only ``gap_missing``.  The last action is last by position, not by time.
    """
    n, since, action = evidence_of(matches(seq, target, field), imp_ts)
    usable = (item_id > 0) & (F.size(seq) > 0)
    return evidence_features(n, since, action, usable, thresholds, max_length, max_gap, missing_value, max_action)


def matches(seq: Column, target: Column, field: str) -> Column:
    return F.filter(seq, lambda e: (e[field] == target) & (target > 0))


def evidence_of(hits: Column, imp_ts: Column) -> tuple[Column, Column, Column]:
    """How many events match, the seconds since the last in time and the action of the last by position."""
    n = F.size(hits)
    return n, last_gap(hits, imp_ts), F.get(hits, F.greatest(n - 1, F.lit(0)))["action"]


def evidence_features(
    n: Column, since: Column, action: Column, usable: Column, thresholds: Sequence[int] = (3600, 86400, 604800),
    max_length: int = MAX_LENGTH, max_gap: int = YEAR, missing_value: float = 1.0, max_action: int = 32,
) -> dict[str, Column]:
    """The eight statistics from the number of matches, the seconds since the last and its action."""
    capped = S.clip(since, hi=max_gap)

    def guarded(value: Column) -> Column:
        return F.when(usable, F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))

    t = (sorted(thresholds) + [10**18] * 3)[:3]
    return {
        "flag": guarded((n > 0).cast("double")),
        "log_count": guarded(log_share(F.least(n, F.lit(max_length)), max_length)),
        "last_gap_log": guarded(log_share(capped, max_gap)),
        "gap_missing": guarded(since.isNull().cast("double") * missing_value),
        "recent_1": guarded((capped <= t[0]).cast("double")),
        "recent_2": guarded((capped <= t[1]).cast("double")),
        "recent_3": guarded((capped <= t[2]).cast("double")),
        "last_action": guarded(F.when(action > 0, F.least(action, F.lit(max_action)) / float(max_action))),
    }


def in_history(seq: Column, target: Column, field: str = "item") -> Column:
    """True when a positive target id occurs in the history."""
    return (target > 0) & F.exists(seq, lambda e: e[field] == target)


# Windows and normalisers of the temporal block.
VELOCITY_WINDOW, VELOCITY_BASE = 3 * 86400, 30 * 86400
FATIGUE_RECENT, FATIGUE_BASE = 86400, 30 * 86400
AD_LOAD_WINDOW = 86400
MAX_EXPOSURES, MAX_RECENT_EXPOSURES, MAX_AD_LOAD, MAX_ADVERTISERS = 500, 50, 200, 50


def temporal_velocity(
    domains: Sequence[str], imp_ts: Column, category: Column, ad_domain: str = "seq_c",
) -> tuple[dict[str, Column], dict[str, Column]]:
    """(scratch counts, velocity features) of events in the target category."""
    counts: dict[str, Column] = {}
    for d in domains:
        hits = F.filter(F.col(d), lambda e: (e["category"] == category) & (category > 0) & (e["ts"] > 0) & (gap(imp_ts, e["ts"]) <= VELOCITY_BASE))
        counts[f"_base_{d}"] = F.size(hits).cast("double")
        counts[f"_rec_{d}"] = F.size(F.filter(hits, lambda e: gap(imp_ts, e["ts"]) <= VELOCITY_WINDOW)).cast("double")
    return counts, velocity_features(domains, ad_domain)


def velocity_features(domains: Sequence[str], ad_domain: str = "seq_c") -> dict[str, Column]:
    """Velocity of the target category from ``_rec_{domain}`` (3 days) and ``_base_{domain}`` (30 days)."""
    rec = {d: F.col(f"_rec_{d}") for d in domains}
    out = {
        f"td_cat_velocity_{d}": F.when(F.col(f"_base_{d}") > 0, F.log1p(rec[d]) / F.log1p(F.col(f"_base_{d}")))
        .otherwise(0.0) for d in domains
    }
    organic = [d for d in domains if d != ad_domain]
    active = {d: (rec[d] > 0).cast("double") for d in domains}
    out["td_cross_domain_active"] = sum((active[d] for d in domains), F.lit(0.0)) / float(len(domains))
    out["td_cross_domain_organic"] = F.log1p(sum((active[d] for d in organic), F.lit(0.0))) / math.log1p(3.0)
    out["td_cross_domain_ratio"] = (
        F.log1p(sum((rec[d] for d in organic), F.lit(0.0))) / F.log1p(rec[ad_domain] + 1.0))
    return out


def temporal_fatigue(seq: Column, imp_ts: Column, advertiser: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """(scratch columns, exposure-curve features) for one advertiser in the ad history."""
    hits = F.filter(seq, lambda e: (e["advertiser"] == advertiser) & (advertiser > 0))
    scratch = {
        "_expo": F.size(hits).cast("double"),
        "_gaps": F.transform(F.filter(hits, lambda e: e["ts"] > 0), lambda e: gap(imp_ts, e["ts"])),
    }
    n = F.col("_expo")

    def within(lo: int | None, hi: int) -> Column:
        def test(g: Column) -> Column:
            return (g <= hi) if lo is None else (g > lo) & (g <= hi)
        return F.size(F.filter("_gaps", test)).cast("double")

    return scratch, fatigue_features(
        n, within(None, FATIGUE_RECENT), within(None, FATIGUE_BASE), within(None, VELOCITY_WINDOW),
        within(VELOCITY_WINDOW, FATIGUE_BASE), F.array_max("_gaps"))


def fatigue_features(n: Column, recent: Column, base: Column, near: Column, mid: Column, oldest: Column) -> dict[str, Column]:
    """The exposure curve from counts in windows and the seconds since the first exposure."""
    near_days, mid_days = VELOCITY_WINDOW / 86400.0, (FATIGUE_BASE - VELOCITY_WINDOW) / 86400.0
    accel = S.ratio(near / near_days, mid / mid_days)
    return {
        "td_adv_n_exposures_log": log_share(n, MAX_EXPOSURES),
        "td_adv_recent_exposures": log_share(recent, MAX_RECENT_EXPOSURES),
        "td_adv_fatigue_ratio": F.least(S.ratio(recent, base), F.lit(1.0)),
        "td_adv_exposure_accel": F.when(mid > 0, F.least(F.log1p(accel) / math.log1p(10), F.lit(1.0)))
        .when(near > 0, 1.0).otherwise(0.0),
        "td_adv_days_since_first": F.coalesce(log_share(oldest, YEAR), F.lit(0.0)),
    }


def temporal_context(
    domains: Sequence[str], imp_ts: Column, category: Column, advertiser: Column, ad_domain: str = "seq_c",
) -> dict[str, Column]:
    """First exposure, ad load, distinct advertisers (0 is one of them), category share."""
    ads = F.col(ad_domain)
    day = F.filter(ads, lambda e: (e["ts"] > 0) & (gap(imp_ts, e["ts"]) <= AD_LOAD_WINDOW))
    seen = F.exists(ads, lambda e: (e["advertiser"] == advertiser) & (advertiser > 0))
    every = sum((count_events(F.col(d), lambda e: e["category"] > 0) for d in domains), F.lit(0).cast("long"))
    hits = sum((count_events(F.col(d), lambda e: (e["category"] == category) & (e["category"] > 0)) for d in domains), F.lit(0).cast("long"))
    return context_features(F.coalesce(seen, F.lit(False)), F.size(day), F.size(F.array_distinct(F.transform(day, lambda e: e["advertiser"]))),
                            hits.cast("double"), every.cast("double"))


def context_features(seen: Column, ad_load: Column, advertisers: Column, hits: Column, every: Column) -> dict[str, Column]:
    """First exposure, ad load and distinct advertisers of a day, share of the target category."""
    return {
        "td_first_exposure_flag": (~seen).cast("double"),
        "td_ad_load_24h_log": log_share(ad_load, MAX_AD_LOAD),
        "td_n_advertisers_24h_log": log_share(advertisers, MAX_ADVERTISERS),
        "td_category_share": hits / F.greatest(every, F.lit(1.0)),
    }


def magnitude_ratio(num: Column, den: Column) -> Column:
    """log1p|mean(a)| - log1p|mean(b)|; 0 when either side is absent."""
    value = F.log1p(F.abs(A.mean(num))) - F.log1p(F.abs(A.mean(den)))
    return F.coalesce(F.when(num.isNotNull() & den.isNotNull(), value), F.lit(0.0))


def set_size(slots: Column) -> Column:
    return F.log1p(F.size(F.filter(slots, lambda v: v != 0)).cast("double"))


def l2_normalised(values: Column) -> Column:
    size = F.greatest(A.norm(values), F.lit(1e-6))
    return A.let(size, lambda n: F.transform(values, lambda v: v.cast("double") / n))
