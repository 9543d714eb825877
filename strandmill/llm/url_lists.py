"""URL block and allow lists that change over time: each capture is judged by the entries of its day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.tables import cut


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def keys_of(url: Column, depth: int, levels: Sequence[int]) -> Column:
    """Patterns that could name a URL: its last labels, as many as ``levels`` says, and the host with its first path parts."""
    host = host_of(url)
    labels = F.split(host, "\\.")
    tried = F.filter(F.array(*[F.lit(n) for n in levels]).cast("array<int>"), lambda n: n <= F.size(labels))
    domains = F.transform(tried, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    path = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.slice(F.split(path, "/", depth + 1), 1, depth)
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, paths)) if depth else domains)


def intervals(changes: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to): changes of a pattern become validity intervals.

    ``changes`` has pattern, day and action ("block", "allow" or "remove").  Several changes of a
    pattern on one day count as one: block over allow over remove.  So a pattern has at most one row
    a day, however often it is listed.  The last interval has no end.  Changes with a null pattern,
    day or action take no part.
    """
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    daily = changes.dropna(subset=["pattern", "day", "action"]).groupBy("pattern", "day").agg(F.min(rank).alias("rank"))
    ends = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    action = F.when(F.col("rank") == 0, "block").when(F.col("rank") == 1, "allow").otherwise("remove")
    return daily.select("pattern", action.alias("action"), F.col("day").alias("valid_from"), ends.alias("valid_to"))


def judge_captures(captures: DataFrame, changes: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """``captures`` with _verdict ("block", "allow" or "none"), _pattern, _valid_from and _valid_to.

    The longest pattern active on the capture's day decides (a removed one is not active); a pattern
    is a domain, which covers its subdomains, or a host with path parts.  Distinct (pattern, day)
    pairs of the captures meet the list in one ordered pass per pattern, which holds at most one row
    a day from either side; verdicts then return over distinct (URL, day) pairs.  A host with a third
    of all captures is therefore a few hundred rows in the ordered pass, and plain join rows, which
    Spark splits, in the two joins.

    Of a host's parent domains only those with as many labels as some listed domain are tried, so a
    host of any length costs no more than its text and the list's levels.

    A null URL or day, or a URL without host, gives "none"; repeated captures are judged alike; an
    empty list gives "none" throughout.  Given columns may have any names; those named like the four
    results are left out.
    """
    captures = captures.drop("_verdict", "_pattern", "_valid_from", "_valid_to")
    named, found = captures.columns, ["_verdict", "_pattern", "_valid_from", "_valid_to"]
    captures = captures.toDF(*[f"c{i}" for i in range(len(named))])
    url_col, day_col = (f"c{named.index(c)}" for c in (url_col, day_col))
    spans = cut(intervals(changes))
    depth = spans.agg(F.max(F.size(F.split("pattern", "/")))).first()[0] or 1
    levels = sorted(r["n"] for r in spans.where(~F.col("pattern").contains("/")).select(F.size(F.split("pattern", "\\.")).alias("n")).distinct().collect())
    asked = cut(captures.select(F.col(url_col).alias("_u"), F.col(day_col).alias("_d")).dropna().distinct()
                .select("_u", "_d", F.explode(keys_of(F.col("_u"), depth - 1, levels)).alias("pattern")))
    none = lambda kind: F.lit(None).cast(kind)
    points = asked.select("pattern", F.col("_d").alias("day"), none("struct<action:string,valid_from:date,valid_to:date>").alias("entry")).distinct()
    listed = spans.select("pattern", F.col("valid_from").alias("day"), F.struct("action", "valid_from", "valid_to").alias("entry"))
    order = Window.partitionBy("pattern").orderBy("day", F.col("entry").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = points.unionByName(listed).withColumn("now", F.last("entry", ignorenulls=True).over(order)).where(
        F.col("entry").isNull() & (F.col("now.action") != "remove")).select("pattern", F.col("day").alias("_d"), "now")
    hit = asked.join(cut(active), ["pattern", "_d"]).groupBy("_u", "_d").agg(F.max(F.struct(
        F.length("pattern").alias("n"), "pattern", F.col("now.action").alias("action"), F.col("now.valid_from").alias("a"), F.col("now.valid_to").alias("b"))).alias("_best"))
    out = captures.join(cut(hit), (F.col(url_col) == F.col("_u")) & (F.col(day_col) == F.col("_d")), "left")
    return out.select(*[captures[c] for c in captures.columns], F.coalesce("_best.action", F.lit("none")).alias("_verdict"), F.col("_best.pattern").alias("_pattern"),
                      F.col("_best.a").alias("_valid_from"), F.col("_best.b").alias("_valid_to")).toDF(*named, *found)
