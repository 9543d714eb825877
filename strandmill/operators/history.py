"""Histories as of an impression, built from a raw event log.

Nothing here pairs impressions with events.  One ordered pass per key numbers the events and counts,
for every probe time, how many events came before it; a history of the last ``ceiling`` events is
then read from at most two fixed-size blocks of numbered events.  Work and shuffle volume are linear
in impressions + events however much of the log one user owns.  While every key's log fits a task, the log is
shuffled once, by key, and histories are made where it lies; they are never shuffled themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.ranking import TASK_ROWS, group_sizes, running_totals

#: Rows of the log in one task; with its histories a row takes up to ``ceiling`` times its own memory.
LOG_ROWS = 250_000


def numbered_timeline(
    events: DataFrame, probes: DataFrame, keys: Sequence[str], domains: Sequence[str],
    payload: Sequence[str] = (), tie: Column | None = None, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Events and probe times on one timeline per key with running per-domain event counts.

    ``events`` has the keys, ``domain``, ``ts`` and the payload; ``probes`` has the keys,
    ``sample_id``, ``probe`` and ``ts``.  A probe counts the events strictly before it.
    """
    tie = tie if tie is not None else F.lit(0)
    ev = events.select(
        *keys, "ts", F.lit(1).alias("_kind"), F.struct(tie.alias("t")).alias("_tie"), "domain",
        F.lit(None).cast("long").alias("sample_id"), F.lit(None).cast("string").alias("probe"),
        F.struct(*[F.col(c) for c in payload] or [F.lit(0).alias("_")]).alias("_event"),
    )
    null_like = {f.name: f.dataType for f in ev.schema.fields}
    pr = probes.select(
        *keys, "ts", F.lit(0).alias("_kind"), F.lit(None).cast(null_like["_tie"]).alias("_tie"),
        F.lit(None).cast("string").alias("domain"), F.col("sample_id").cast("long"), "probe",
        F.lit(None).cast(null_like["_event"]).alias("_event"),
    )
    counts = {f"n_{d}": F.when(F.col("domain") == d, 1).otherwise(0).cast("long") for d in domains}
    return running_totals(
        ev.unionByName(pr), keys, [F.col("ts"), F.col("_kind"), F.col("_tie")], counts, task_rows=task_rows,
    )


def probe_rows(impressions: DataFrame, keys: Sequence[str], at: Mapping[str, Column]) -> DataFrame:
    """One row per impression and named probe time."""
    times = F.array(*[
        F.struct(F.lit(name).alias("probe"), when.cast("long").alias("ts")) for name, when in at.items()
    ])
    return impressions.select(*keys, "sample_id", F.inline(times))


def counts_at_probes(timeline: DataFrame, probes: Sequence[str], domains: Sequence[str]) -> DataFrame:
    """``sample_id`` with one count per (probe, domain), named ``{probe}_{domain}``."""
    rows = timeline.where(F.col("_kind") == 0)
    return rows.groupBy("sample_id").agg(*[
        F.max(F.when(F.col("probe") == p, F.col(f"n_{d}"))).alias(f"{p}_{d}")
        for p in probes for d in domains
    ])


def counts_as_of(
    impressions: DataFrame, events: DataFrame, keys: Sequence[str], at: Mapping[str, Column],
    domains: Sequence[str], task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Exact event counts before each probe time; ``(t - w, t)`` windows are differences of two."""
    line = numbered_timeline(events, probe_rows(impressions, keys, at), keys, domains, task_rows=task_rows)
    return counts_at_probes(line, list(at), domains)


def _histories_in_place(
    impressions: DataFrame, events: DataFrame, keys: Sequence[str], domains: Sequence[str], payload: Sequence[str],
    ceiling: int, tie: Column, at: Mapping[str, Column], rows: int,
) -> DataFrame:
    """``attach_histories`` over a log that is shuffled by key once.

    An event's number counts up in its domain and an impression has the number of its last event, so a window over the
    numbers from ``ceiling - 1`` below to its own holds the history in order; other impressions in it add nothing.
    """
    kept = impressions.columns
    own_columns = {f"_s_{c}": c for c in kept if c not in keys}
    of = {f.name: f.dataType for f in impressions.schema.fields}
    ev = events.select(
        *keys, "ts", F.lit(1).alias("_kind"), F.struct(tie.alias("t")).alias("_tie"), "domain",
        F.struct(*payload).alias("_event"), F.lit(None).cast("string").alias("_probe"), F.lit(None).cast("long").alias("_id"),
        *[F.lit(None).cast(of[c]).alias(s) for s, c in own_columns.items()])
    kinds = {f.name: f.dataType for f in ev.schema.fields}
    times = F.array(*[F.struct(F.lit(p).alias("_probe"), when.cast("long").alias("ts")) for p, when in at.items()])
    pr = impressions.select(*keys, F.col("sample_id").cast("long").alias("_id"), *[F.col(c).alias(s) for s, c in own_columns.items()], F.inline(times)).select(
        *keys, "ts", F.lit(0).alias("_kind"), F.lit(None).cast(kinds["_tie"]).alias("_tie"), F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast(kinds["_event"]).alias("_event"), "_probe", "_id", *[F.when(F.col("_probe") == "now", F.col(s)).alias(s) for s in own_columns])
    tasks = max(events.sparkSession.sparkContext.defaultParallelism, rows // LOG_ROWS + 1)
    log = ev.unionByName(pr).repartition(tasks, *keys)

    upto = Window.partitionBy(*keys).orderBy("ts", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = log.withColumns({f"_n_{d}": F.sum(F.when(F.col("domain") == d, 1).otherwise(0).cast("long")).over(upto) for d in domains})
    own = F.coalesce(*[F.when(F.col("domain") == d, F.col(f"_n_{d}")) for d in domains])

    def place(domain: Column, seq: Column) -> Column:
        return F.struct(domain.cast("string").alias("_domain"), seq.cast("long").alias("_seq"))

    places = F.when(F.col("_kind") == 1, F.array(place(F.col("domain"), own))).when(
        F.col("_probe") == "now", F.array(*[place(F.lit(d), F.col(f"_n_{d}")) for d in domains])).otherwise(F.array(place(F.lit(None), F.lit(None))))
    placed = counted.select(*keys, "_kind", "_probe", "_id", *own_columns, "_event", *[f"_n_{d}" for d in domains], F.inline_outer(places))
    last = Window.partitionBy(*keys, "_domain").orderBy("_seq").rangeBetween(1 - ceiling, Window.currentRow)
    asked = placed.withColumn("_h", F.collect_list(F.when(F.col("_kind") == 1, F.col("_event"))).over(last)).where("_kind = 0")
    back = [F.col(c if c in keys else f"_s_{c}").alias(c) for c in kept]
    if len(domains) == 1 and len(at) == 1:
        d = domains[0]
        return asked.select(*back, F.col("_h").alias(d), F.col(f"_n_{d}").alias(f"{d}_raw_len"))
    here = lambda p, c: F.max(F.when(F.col("_probe") == p, F.col(c)))
    first = lambda when, c: F.first(F.when(when, F.col(c)), ignorenulls=True)
    out = asked.groupBy(*keys, "_id").agg(
        *[first(F.col("_domain") == domains[0], s).alias(s) for s in own_columns],
        *[first(F.col("_domain") == d, "_h").alias(d) for d in domains],
        *[here("now", f"_n_{d}").alias(f"{d}_raw_len") for d in domains],
        *[here(p, f"_n_{d}").alias(f"{p}_{d}") for p in at if p != "now" for d in domains])
    return out.select(
        *back, *domains, *[f"{d}_raw_len" for d in domains],
        *[f"{p}_{d}" for p in at if p != "now" for d in domains])


def attach_histories(
    impressions: DataFrame, events: DataFrame, keys: Sequence[str], domains: Sequence[str],
    payload: Sequence[str], ceiling: int, tie: Column, extra_probes: Mapping[str, Column] | None = None,
    task_rows: int = TASK_ROWS, sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Impressions with, per domain, the last ``ceiling`` events before them and the full count.

    Adds ``{domain}`` (array of payload structs, oldest first) and ``{domain}_raw_len``; counts at
    ``extra_probes`` come out as ``{probe}_{domain}``.  The ceiling is the sequence length of the
    sample table; counts over the whole history stay exact in ``_raw_len``.  Null keys and times meet nothing.
    ``sizes`` are known upper bounds of (events + impressions, those of the largest key).  The result is hash-distributed
    by the keys where each of them fits a task.
    """
    at = {"now": F.col("ts"), **(extra_probes or {})}
    known = F.col("ts").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    events = events.where(known)
    n, largest = sizes or group_sizes(events.select(*keys).unionByName(impressions.select(*keys)), keys)
    if largest * len(at) <= task_rows:
        return _histories_in_place(impressions, events, keys, domains, payload, ceiling, tie, at, n)
    line = numbered_timeline(
        events, probe_rows(impressions, keys, at), keys, domains, payload, tie, task_rows)

    own = F.coalesce(*[F.when(F.col("domain") == d, F.col(f"n_{d}")) for d in domains])
    numbered = line.where(F.col("_kind") == 1).select(*keys, "domain", own.alias("_seq"), "_event")
    blocks = numbered.groupBy(
        *keys, "domain", F.floor((F.col("_seq") - 1) / ceiling).alias("_block")
    ).agg(F.sort_array(F.collect_list(F.struct("_seq", "_event"))).alias("_rows"))

    counted = impressions.join(counts_at_probes(line, list(at), domains), "sample_id")
    kept = [c for c in impressions.columns]
    extras = [f"{p}_{d}" for p in at if p != "now" for d in domains]

    def wanted(d: str) -> Column:
        n = F.col(f"now_{d}")
        last = F.floor((n - 1) / ceiling)
        def need(block: Column) -> Column:
            return F.struct(F.lit(d).alias("domain"), block.alias("_block"), n.alias("_n"))
        return (F.when(n <= 0, F.array().cast(f"array<struct<domain:string,_block:bigint,_n:bigint>>"))
                .when((n % ceiling == 0) | (last == 0), F.array(need(last)))
                .otherwise(F.array(need(last - 1), need(last))))

    requests = counted.withColumn(
        "_sample", F.struct(*kept, *[F.col(f"now_{d}").alias(f"{d}_raw_len") for d in domains], *extras)
    ).select(
        *keys, "sample_id", "_sample",
        F.explode_outer(F.concat(*[wanted(d) for d in domains])).alias("_want"),
    ).select(*keys, "sample_id", "_sample", "_want.domain", "_want._block", "_want._n")

    met = requests.join(blocks, [*keys, "domain", "_block"], "left")
    inside = F.filter("_rows", lambda r: (r["_seq"] > F.col("_n") - ceiling) & (r["_seq"] <= F.col("_n")))
    part = F.when(
        F.col("_rows").isNotNull(),
        F.struct("_block", F.transform(inside, lambda r: r["_event"]).alias("_part")),
    )
    out = met.withColumn("_part", part).groupBy("sample_id").agg(
        F.first("_sample").alias("_sample"),
        *[F.sort_array(F.collect_list(F.when(F.col("domain") == d, F.col("_part")))).alias(f"_h_{d}")
          for d in domains],
    )
    return out.select(
        *[F.col(f"_sample.{c}").alias(c) for c in kept],
        *[F.flatten(F.transform(f"_h_{d}", lambda b: b["_part"])).alias(d) for d in domains],
        *[F.col(f"_sample.{d}_raw_len").alias(f"{d}_raw_len") for d in domains],
        *[F.col(f"_sample.{c}").alias(c) for c in extras],
    )
