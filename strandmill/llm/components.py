"""Connected components by alternating large and small stars: two aggregates a round, no driver state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.tables import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them.

    The large star moves the neighbours above the node, the small star those below it and the node.
    """
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = near.join(least, "a")
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    ``edges`` has long columns a and b.  Nulls and loops are left out; repeated edges count once; no
    edges give no rows.  Each round is a table in the shared folder, dropped after the next; a path of n
    edges needs about log n rounds.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.keep(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = None
    while True:
        edges, last = scratch.keep(_stars(_stars(edges, True), False)), edges
        scratch.drop(last)
        now = sign(edges)
        if now == before or not now[0]:
            break
        before = now
    found = scratch.keep(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    scratch.drop(edges)
    return found
