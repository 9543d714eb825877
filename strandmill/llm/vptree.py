"""Nearest neighbours by largest inner product: a vantage-point tree per shard of the vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.tables import cut

LEAF, SHARD_ROWS, BLOCK_ROWS, RANGE_ROWS = 256, 8192, 4096, 256


class VantageTree:
    """Points split again and again at the median distance to a vantage point, searched for many queries at once."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.root = self._build(np.arange(len(points)))

    def _far(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - point) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # The vantage point lies at the rim: the point farthest from an arbitrary one.
        vantage = self.points[rows[np.argmax(self._far(rows, self.points[rows[0]]))]]
        far = self._far(rows, vantage)
        radius = float(np.median(far))
        inner = far < radius
        if not inner.any() or inner.all():
            return rows
        return vantage, radius, self._build(rows[inner]), self._build(rows[~inner])

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, rows) of the nearest k points; an unfilled place has distance inf and row -1.

        A half whose distance bound exceeds the k-th distance divided by ``factor`` is left out;
        factor 1 loses nothing, a larger one visits less.
        """
        self.best = np.full((len(queries), k), np.inf)
        self.rows = np.full((len(queries), k), -1, dtype=np.int64)
        self.queries, self.factor, self.k = queries, factor, k
        self.square = (self.points**2).sum(axis=1)
        self._visit(self.root, np.arange(len(queries)))
        return self.best, self.rows

    def within(self, queries: np.ndarray, radius: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query numbers, rows) of all points no farther than each query's radius; pairs ordered by query.

        The radius should already cover the rounding of squared distances; that of the bounds is covered here.
        """
        square = (self.points**2).sum(axis=1)
        slack = 1e-12 * np.sqrt((queries**2).sum(axis=1) + square.max(initial=0))
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, who = todo.pop()
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                q = queries[who]
                far = (q**2).sum(axis=1)[:, None] + square[node] - 2 * q @ self.points[node].T
                at, row = np.nonzero(far <= (radius[who] ** 2)[:, None])
                pairs.append((who[at], node[row]))
                continue
            vantage, middle, inner, outer = node
            gap = np.sqrt(((queries[who] - vantage) ** 2).sum(axis=1)) - middle
            open_ = np.abs(gap) <= radius[who] / factor + slack[who]
            todo += [(inner, who[open_ | (gap < 0)]), (outer, who[open_ | (gap >= 0)])]
        who, rows = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        order = np.argsort(who, kind="stable")
        return who[order], rows[order]

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            self._scan(node, who)
            return
        vantage, radius, inner, outer = node
        gap = np.sqrt(((self.queries[who] - vantage) ** 2).sum(axis=1)) - radius
        near, far = who[gap < 0], who[gap >= 0]
        self._visit(inner, near)
        self._visit(outer, far)
        # A relative 1e-9 covers rounding of the distances.
        open_ = np.abs(gap) <= self.best[who, -1] * (1 + 1e-9) / self.factor + 1e-12
        self._visit(outer, who[open_ & (gap < 0)])
        self._visit(inner, who[open_ & (gap >= 0)])

    def _scan(self, rows: np.ndarray, who: np.ndarray) -> None:
        q = self.queries[who]
        far = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + self.square[rows] - 2 * q @ self.points[rows].T, 0))
        all_far = np.concatenate([self.best[who], far], axis=1)
        all_rows = np.concatenate([self.rows[who], np.broadcast_to(rows, far.shape)], axis=1)
        pick = np.argpartition(all_far, self.k - 1, axis=1)[:, : self.k] if all_far.shape[1] > self.k else np.tile(np.arange(all_far.shape[1]), (len(who), 1))
        near = np.take_along_axis(all_far, pick, axis=1)
        order = np.argsort(near, axis=1)
        self.best[who] = np.take_along_axis(near, order, axis=1)
        self.rows[who] = np.take_along_axis(np.take_along_axis(all_rows, pick, axis=1), order, axis=1)


def _in_shard(k: int, factor: float):
    def search(key, base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(base) and len(asked):
            vectors = np.stack(base["v"].to_list()).astype(np.float64) + 0.0
            vectors, group = np.unique(vectors, axis=0, return_inverse=True)
            # Distinct (vector, id) pairs; k + 1 ids of a vector are enough, as one may be the query's own.
            pairs = np.unique(np.column_stack([group.ravel(), base["id"].to_numpy()]), axis=0)
            cuts = np.searchsorted(pairs[:, 0], np.arange(len(vectors) + 1))
            ids = pairs[:, 1]
            sizes = np.minimum(np.diff(cuts), k + 1)
            columns = np.ascontiguousarray(vectors.T)

            def best(query: int, q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """(ids, scores) of the k best among the ids of ``rows``, the smaller id first among equals."""
                score = np.zeros(len(rows))
                for d in range(len(q)):  # in the order of the components, so equal vectors get equal scores
                    score += q[d] * columns[d, rows]
                n = sizes[rows]
                entry = np.repeat(cuts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
                near, score = ids[entry], np.repeat(score, n)
                near, score = near[near != query], score[near != query]
                order = np.lexsort((near, -score))
                near, score = near[order], score[order]
                new = np.ones(len(near), dtype=bool)
                new[1:] = (near[1:] != near[:-1]) | (score[1:] != score[:-1])
                return near[new][:k], score[new][:k]

            # The largest inner product is the smallest distance once all points have the same norm;
            # the length of a query does not change its order, so it gets that norm as well.
            top = np.abs(vectors).max()
            points = vectors / top
            own = (points**2).sum(axis=1)
            square = own.max()
            tree = VantageTree(np.column_stack([points, np.sqrt(square - own)]))
            asked_ids, queries = asked["id"].tolist(), np.stack(asked["v"].to_list()).astype(np.float64)
            longest = np.abs(queries).max(axis=1)
            probes = queries / longest[:, None]
            stretch = np.sqrt(square / (probes**2).sum(axis=1))
            probes = np.column_stack([probes * stretch[:, None], np.zeros(len(queries))])
            _, found = tree.search(probes, min(k + 9, len(vectors)), factor)
            # Those found bound the k-th score from below; whatever may reach it is then compared exactly.
            least = np.full(len(queries), -np.inf)
            for i, rows in enumerate(found):
                _, score = best(asked_ids[i], queries[i], rows[rows >= 0])
                if len(score) == k:
                    least[i] = score[-1]
            margin = 32 * (vectors.shape[1] + 8) * np.finfo(np.float64).eps * square
            radius = np.sqrt(np.maximum(2 * square - 2 * least / longest / top * stretch, 0) + margin)
            # Beyond these sizes the products may over- or underflow, so all are compared.
            radius[(longest < 1e-140) | (longest > 1e140) | (top < 1e-140) | (top > 1e140)] = np.inf
            for i in range(0, len(queries), RANGE_ROWS):
                who, rows = tree.within(probes[i: i + RANGE_ROWS], radius[i: i + RANGE_ROWS], factor)
                ends = np.searchsorted(who, np.arange(len(probes[i: i + RANGE_ROWS]) + 1))
                for j, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True), i):
                    near, score = best(asked_ids[j], queries[j], rows[lo:hi])
                    out["query_id"] += [asked_ids[j]] * len(near)
                    out["vec_id"] += near.tolist()
                    out["score"] += score.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the largest inner products.

    Vectors are dealt to shards of about 8192 rows by a hash of their id and every shard builds its
    own tree; queries go to every shard in blocks of 4096, so no group grows with the table.  The tree
    finds k and some more, then every point that may reach the k-th inner product, however many tie
    there, and these are compared exactly.  Each block returns its k best, and a query's candidates
    are k per shard.  Equal vectors of a shard are one point with its ids.

    Null, zero or non-finite vectors and null ids take no part on either side; vectors meet only
    those of their own length; a repeated id counts once per vector, on both sides, and is never its
    own neighbour.
    Ties go to the smaller id; with k or fewer candidates all are returned; empty tables give none.
    """
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    base, asked = clean(vectors).dropDuplicates(), cut(clean(queries).dropDuplicates())
    shards, blocks = int(clean(vectors).count() // SHARD_ROWS + 1), int(asked.count() // BLOCK_ROWS + 1)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    left = base.withColumns({"shard": F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)), "dim": F.size("v"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = asked.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "dim": F.size("v"), "block": block})
    keys = lambda df: df.select(F.col("shard").cast("int").alias("shard"), "dim", F.col("block").cast("int").alias("block"), "id", "v").repartition(max(shards * blocks, 2), "shard", "dim", "block").groupBy("shard", "dim", "block")
    found = keys(left).cogroup(keys(right)).applyInPandas(_in_shard(k, factor), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.repartition("query_id").dropDuplicates()
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
