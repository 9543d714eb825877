"""Exact top-k by inner product: three phases over vertical lists with one uniform threshold.

The components of every vector are dealt to a few lists, each kept apart from the others, as the score
lists of different nodes would be.  A list only knows its own part of a score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.tables import BROADCAST_ROWS, cut, small

#: Lists of components; places per neighbour that phase one gathers from each list; rows of a cell.
LISTS, DEPTH, SHARD_ROWS, BLOCK_ROWS, TILE = 2, 8, 8192, 4096, 64
#: A cutoff that everything reaches; scores stay within 2^54, and up to 16 lists' sums of either in a long.
LOWEST = -(1 << 57)
ENTRIES = "q long, list int, row long, part long"


def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, as longs.

    A component beyond 2^27 over the root of the length counts as that bound, so no score exceeds 2^54.
    """
    most = F.floor(F.lit(float(1 << 27)) / F.sqrt(F.greatest(F.size(vector), F.lit(1)))).cast("double")
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, most), -most)).cast("long"))


def _clean(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).select("id", scaled(F.col("v"), scale).alias("v")).dropDuplicates()


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1)).astype(np.int64)


def _gather(pick: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """Function of a cell (one list's parts of a shard of vectors and of a block of queries) to the entries picked."""

    def gather(key, base: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3]
        if base.num_rows and asked.num_rows:
            parts, probes = _rows(base.column("v")), _rows(asked.column("v"))
            rows, q, least = (t.column(c).to_numpy() for t, c in ((base, "row"), (asked, "q"), (asked, "least")))
            # In doubles as long as every partial sum is a whole number below 2^53.
            if np.abs(parts).max(initial=1) * float(np.abs(probes).max(initial=1)) * max(parts.shape[1], 1) < 2.0**53:
                parts, probes = parts.astype(np.float64), probes.astype(np.float64)
            for i in range(0, len(q), TILE):
                score = probes[i: i + TILE] @ parts.T
                at, where = pick(score, least[i: i + TILE])
                found.append([q[i + at], rows[where], score[at, where].astype(np.int64)])
        who, where, part = (np.concatenate(x) for x in zip(*found, strict=True))
        number = np.full(len(who), key[0].as_py(), np.int32)
        return pa.table({"q": who, "list": number, "row": where, "part": part})

    return gather


def _longest(depth: int):
    """The ``depth`` best of every query."""

    def pick(score: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = score.shape[1]
        best = np.argpartition(-score, depth - 1, axis=1)[:, :depth] if n > depth else np.broadcast_to(np.arange(n), score.shape)
        return np.repeat(np.arange(len(score)), best.shape[1]), best.reshape(-1)

    return pick


def _reaching(lists: int):
    """All that reach a query's threshold, which comes multiplied by the number of lists to be a whole number."""
    return lambda score, least: np.nonzero(score * lists >= least[:, None])


def _entries(base: DataFrame, asked: DataFrame, pick, lists: int, shards: int, blocks: int) -> DataFrame:
    """What ``pick`` takes from every list, cell by cell; ``asked`` has q, v and the cutoffs per list."""
    ends = lambda b: F.floor(b * F.size("v") / lists).cast("int")
    part = F.slice("v", ends(F.col("list")) + 1, ends(F.col("list") + 1) - ends(F.col("list")))
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.withColumn("list", deal(lists)).withColumn("block", deal(blocks)).select(
        "list", F.size("v").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "block", "row", part.alias("v"))
    right = asked.withColumn("list", deal(lists)).withColumn("shard", deal(shards)).select(
        "list", F.size("v").alias("dim"), "shard", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"),
        "q", part.alias("v"), F.get("least", F.col("list")).alias("least"))
    keys = ["list", "dim", "shard", "block"]
    cells = lambda df: df.repartition(3 * lists * shards * blocks, *keys).groupBy(*keys)
    return cells(left).cogroup(cells(right)).applyInArrow(_gather(pick), ENTRIES)


def _exact(pairs: DataFrame, base: DataFrame, asked: DataFrame, *more: str) -> DataFrame:
    """``pairs`` (q, row) with ids, query_id and the whole score, and with ``more`` of their columns."""
    product = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
    return pairs.join(base, "row").join(asked, "q").select("q", "query_id", "ids", product.alias("score"), *more)


def _ranked(scored: DataFrame, by: str, k: int) -> DataFrame:
    """The k best single rows per query, ties to the smaller id; a query's own id is left out."""
    each = scored.select("q", "query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    each = each.select(by, "query_id", "vec_id", "score").distinct() if by != "query_id" else each.select("query_id", "vec_id", "score").distinct()
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_scores(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id",
               vector_col: str = "embedding", lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the largest integer inner products.

    Components count as floor(scale * x).  (1) Every list gathers the 8 k best parts of each query; the
    gathered vectors are scored as a whole, and the k-th of these scores is a safe cutoff c: k rows reach it.
    (2) With the lists' largest parts t_1..t_m, every list gets the threshold t_i - (t_1 + .. + t_m - c) / m.
    The thresholds add up to c, so a vector below all of them scores below c: collecting what reaches a
    threshold collects every answer and every tie.  (3) Collected vectors whose known parts, with the
    thresholds in place of the others, stay below c go; the rest is scored exactly where a part is unknown.

    Lists are held in cells of a shard of vectors and a block of queries, so no group grows with the
    table; the cutoff travels on the query rows.  Equal vectors are one row with their k + 1 smallest ids.

    Null vectors, vectors with a null or non-finite component and null ids take no part on either side;
    zero and empty vectors do.  Vectors meet those of their own length.  A repeated row counts once, an id
    with two vectors once per vector; it is never its own neighbour.  Ties go to the smaller id, with fewer than k
    candidates all are returned, empty tables give no rows, other columns are not read.
    """
    rows = _clean(vectors, id_col, vector_col, scale)
    first = Window.partitionBy("v").orderBy("id")
    groups = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).groupBy("v").agg(F.collect_set("id").alias("ids"))
    base = cut(groups.withColumn("row", F.monotonically_increasing_id()))
    asked = cut(_clean(queries, id_col, vector_col, scale).withColumnRenamed("id", "query_id").withColumn("q", F.monotonically_increasing_id()))
    n_base, (n_asked, widest) = base.count(), asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards, blocks, depth = n_base // SHARD_ROWS + 1, n_asked // BLOCK_ROWS + 1, DEPTH * k + 1
    probes = small(asked.withColumnRenamed("v", "w"), n_asked, 3 * BROADCAST_ROWS // (widest + 1))

    everything = asked.withColumn("least", F.array_repeat(F.lit(LOWEST), lists))
    best = Window.partitionBy("q", "list").orderBy(F.col("part").desc(), "row")
    tops = cut(_entries(base, everything, _longest(depth), lists, shards, blocks).withColumn(
        "at", F.row_number().over(best)).where(F.col("at") <= depth))
    known = _exact(tops.select("q", "row").distinct(), base, probes)
    reached = _ranked(known, "q", k).where(F.col("rank") == k).select("q", F.col("score").alias("cutoff"))
    heads = tops.where("at = 1").groupBy("q").agg(F.sum("part").alias("heads"), F.map_from_entries(F.collect_list(F.struct("list", "part"))).alias("head"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(lists - 1)), lambda b: lists * F.element_at("head", b) - F.col("heads") + F.col("cutoff"))
    depths = cut(heads.join(reached, "q", "left").select(
        "q", F.coalesce("cutoff", F.lit(LOWEST)).alias("cutoff"),
        F.when(F.col("cutoff").isNull(), F.array_repeat(F.lit(LOWEST), lists)).otherwise(numbers).alias("least")))

    found = _entries(base, asked.join(depths, "q"), _reaching(lists), lists, shards, blocks)
    limits = small(depths, n_asked, 3 * BROADCAST_ROWS // (lists + 2))
    seen = found.groupBy("q", "row").agg(
        F.count(F.lit(1)).alias("n"), F.sum("part").alias("score"), F.collect_list("list").alias("lists")).join(limits, "q")
    unseen = F.aggregate(F.sequence(F.lit(0), F.lit(lists - 1)), F.lit(0).cast("long"), lambda a, b: a + F.when(
        F.array_contains("lists", b), F.lit(0)).otherwise(F.get("least", b)))
    possible = cut(seen.where(lists * F.col("score") + unseen >= lists * F.col("cutoff")).select("q", "row", "cutoff", F.when(F.col("n") == lists, F.col("score")).alias("score")))
    whole = possible.where("score is not null and score >= cutoff").join(base.select("row", "ids"), "row").join(
        probes.select("q", "query_id"), "q").select("q", "query_id", "ids", "score")
    open_ = _exact(possible.where("score is null").select("q", "row", "cutoff"), base, probes, "cutoff").where("score >= cutoff").drop("cutoff")
    return _ranked(whole.unionByName(open_), "query_id", k).select("query_id", "rank", "vec_id", "score")
