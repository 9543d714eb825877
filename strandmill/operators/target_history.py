"""Features of a target id over the whole event log: as-of sweeps per (user, target), no arrays, no pairs.

Impressions and events meet on one ordered timeline per user and target value.  What an impression needs is
read off running counts and running maxima at its probe times, so a history of any length costs its
events once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.ranking import TASK_ROWS, running_totals


def _usable(keys: Sequence[str]) -> Column:
    """A time and every key are known."""
    out = F.col("ts").isNotNull()
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _long(df: DataFrame, keep: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """One row per kind with a positive value: ``keep``, ``_kind``, ``_value``."""
    kinds = F.array(*[F.struct(F.lit(k).alias("_kind"), v.cast("long").alias("_value")) for k, v in values.items()])
    return df.select(*keep, F.inline(kinds)).where(F.col("_value") > 0)


def target_history(
    impressions: DataFrame, events: DataFrame, keys: Sequence[str], targets: Mapping[str, tuple[str, str]],
    at: Mapping[str, Column], domains: Sequence[str], tie: str, payload: Sequence[str] = (), task_rows: int = TASK_ROWS,
) -> DataFrame:
    """What each impression's targets have in its past: (sample_id, kind) rows, for positive targets.

    ``targets`` names, per kind, the event field and the impression column that must agree; ``at`` are probe
    times (the first is the impression's own).  Per domain d and probe p there is ``{p}_{d}``, the number of matching events
    strictly before the probe; at the first probe also ``first_{d}`` (the earliest time) and ``last_{d}``, a struct of ts,
    tie and the payload of the last event in (ts, tie) order.  Counts of a window are differences of two probes.
    A null key, time or target meets nothing.
    """
    now = next(iter(at))
    ev = _long(events, [*keys, "ts", "domain", tie, *[c for c in payload if c != tie]], {k: F.col(e) for k, (e, _) in targets.items()})
    ev = ev.select(*keys, "_kind", "_value", "ts", F.lit(1).alias("_event"), F.struct(tie).alias("_tie"), "domain", F.lit(None).cast("long").alias("sample_id"),
                   F.lit(None).cast("string").alias("_probe"), F.struct("ts", F.col(tie).alias("tie"), *payload).alias("_row"))
    kinds = {f.name: f.dataType for f in ev.schema.fields}
    probes = _long(impressions.withColumn("_times", F.array(*[F.struct(F.lit(p).alias("_probe"), t.cast("long").alias("ts")) for p, t in at.items()])),
                   [*keys, "sample_id", "_times"], {k: F.col(i) for k, (_, i) in targets.items()})
    probes = probes.select(*keys, "_kind", "_value", "sample_id", F.inline("_times")).select(
        *keys, "_kind", "_value", "ts", F.lit(0).alias("_event"), F.lit(None).cast(kinds["_tie"]).alias("_tie"), F.lit(None).cast("string").alias("domain"),
        F.col("sample_id").cast("long"), "_probe", F.lit(None).cast(kinds["_row"]).alias("_row"))
    usable = F.col("ts").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    of = lambda d, value: F.when(F.col("domain") == d, value)
    line = running_totals(
        ev.unionByName(probes).where(usable), [*keys, "_kind", "_value"], [F.col("ts"), F.col("_event"), F.col("_tie")],
        {f"_n_{d}": F.coalesce(of(d, F.lit(1)), F.lit(0)).cast("long") for d in domains}, task_rows,
        peaks={f"_l_{d}": of(d, F.col("_row")) for d in domains} | {f"_f_{d}": of(d, -F.col("ts")) for d in domains})
    asked = line.where(F.col("_event") == 0)
    probe = lambda p, c: F.max(F.when(F.col("_probe") == p, F.col(c)))
    return asked.groupBy("sample_id", F.col("_kind").alias("kind")).agg(
        *[probe(p, f"_n_{d}").alias(f"{p}_{d}") for p in at for d in domains],
        *[probe(now, f"_l_{d}").alias(f"last_{d}") for d in domains], *[(-probe(now, f"_f_{d}")).alias(f"first_{d}") for d in domains])


def distinct_in_window(
    impressions: DataFrame, events: DataFrame, keys: Sequence[str], value: str, window: int, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(sample_id, n_distinct): distinct values of the events in [ts - window, ts) of each impression.

    A value is in the windows of the times (e, e + window] of its events e.  Per (user, value) these intervals merge
    into islands; an impression counts the islands over it, as a running sum of +1 where one
    begins and -1 where it ends.  So every event counts twice at most, whatever the windows overlap.  Null values
    are one value; null keys and times take no part.
    """
    usable = _usable(keys)
    times = events.where(usable).select(*keys, F.col(value).alias("_value"), F.col("ts").cast("long").alias("ts")).distinct()
    seen = running_totals(times, [*keys, "_value"], [F.col("ts")], {}, task_rows, peaks={"_before": F.col("ts")}, inclusive=False)
    apart = F.col("_before").isNull() | (F.col("ts") > F.col("_before") + window)
    edges = seen.where(apart).select(*keys, F.inline(F.filter(F.array(
        F.struct(F.col("ts"), F.lit(1).alias("_step")), F.struct((F.col("_before") + window).alias("ts"), F.lit(-1).alias("_step"))), lambda e: e["ts"].isNotNull())))
    ends = times.groupBy(*keys, "_value").agg((F.max("ts") + window).alias("ts")).select(*keys, "ts", F.lit(-1).alias("_step"))
    steps = edges.unionByName(ends).groupBy(*keys, "ts").agg(F.sum("_step").alias("_step")).select(
        *keys, "ts", F.lit(1).alias("_event"), "_step", F.lit(None).cast("long").alias("sample_id"))
    asked = impressions.where(usable).select(*keys, F.col("ts").cast("long").alias("ts"), F.lit(0).alias("_event"), F.lit(0).cast("long").alias("_step"), F.col("sample_id").cast("long"))
    line = running_totals(steps.unionByName(asked), keys, [F.col("ts"), F.col("_event"), F.col("sample_id")], {"n_distinct": F.col("_step")}, task_rows)
    return line.where(F.col("_event") == 0).select("sample_id", "n_distinct")


def least_later(
    times: DataFrame, impressions: DataFrame, keys: Sequence[str], order: str, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Rows of ``times`` (keys, ts and more) with ``_least``, the least ``order`` among their key's later impressions.

    A running maximum over the key's timeline read backwards.  Rows without a later impression are left out; null keys and
    times take no part.
    """
    more = [c for c in times.columns if c not in (*keys, "ts")]
    of = {f.name: f.dataType for f in times.schema.fields}
    back = times.where(_usable(keys)).select(*keys, "ts", F.lit(0).alias("_imp"), F.lit(None).cast("long").alias("_order"), *more)
    imps = impressions.where(_usable(keys)).select(
        *keys, "ts", F.lit(1).alias("_imp"), F.col(order).cast("long").alias("_order"), *[F.lit(None).cast(of[c]).alias(c) for c in more])
    line = running_totals(back.unionByName(imps), keys, [-F.col("ts"), F.col("_imp"), F.col("_order"), *[F.col(c) for c in more]], {}, task_rows, peaks={"_near": -F.col("_order")})
    return line.where((F.col("_imp") == 0) & F.col("_near").isNotNull()).select(*keys, "ts", *more, (-F.col("_near")).alias("_least"))


def first_partners(events: DataFrame, source: str, targets: Sequence[str], tie: str) -> DataFrame:
    """source -> first positive partner by (least impression after the event, ts, tie); one row per source that has one."""
    place = F.struct("_least", "ts", F.col(tie).alias("tie"))
    known = [F.col(t) > 0 for t in targets]
    some = F.lit(False)
    for k in known:
        some = some | F.coalesce(k, F.lit(False))
    return events.where((F.col(source) > 0) & some).groupBy(source).agg(
        *[F.min_by(t, F.when(k, place)).alias(t) for t, k in zip(targets, known, strict=True)])


def first_seen_from_log(
    impressions: DataFrame, events: DataFrame, keys: Sequence[str], source: str, targets: Sequence[str], order: str, tie: str,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """source -> first positive partner over the impressions in ``order``, each with all earlier events of its key.

    An event is first met by the least impression after it, which depends on its key and time alone: that is found once per
    distinct time, and the events go straight to one aggregate.  Null keys and times take no part.
    """
    met = least_later(events.select(*keys, "ts").distinct(), impressions, keys, order, task_rows)
    return first_partners(events.select(*keys, "ts", source, tie, *[t for t in targets if t != tie]).join(met, [*keys, "ts"]), source, targets, tie)
