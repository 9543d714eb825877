"""Reproducible shuffle into shards: a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.tables import running, spread_repeats
from strandmill.llm.texts import mix, seeds

ROUNDS = 6


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Image of row numbers under a keyed permutation of 0..n-1.

    The network permutes the next even power of two; an image of n or more is permuted again until
    it falls below n, which happens after fewer than four turns on average.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, width = np.uint64((1 << half) - 1), np.uint64(half)
    keys = seeds(f"shard{seed}", ROUNDS)
    out = np.asarray(numbers, dtype=np.uint64).copy()
    turn = np.arange(len(out))
    while len(turn):
        left, right = out[turn] >> width, out[turn] & low
        for key in keys:
            left, right = right, left ^ (mix(right + key) & low)
        out[turn] = (left << width) | right
        turn = turn[out[turn] >= n]
    return out.astype(np.int64)


def _permuted(n: int, seed: int):
    @F.pandas_udf("long")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in parts:
            yield pd.Series(permute(numbers.to_numpy(), n, seed))

    return udf


def shuffle_to_shards(docs: DataFrame, identity: list[Column], shards: int, rows: int, seed: int = 0) -> DataFrame:
    """``docs`` with _row, _shard and _slot; ``rows`` is the row count, ``identity`` tells rows apart.

    Rows are numbered in the order of a digest of their identity, in even slices, so the numbers do
    not depend on files or partitions; the permuted number p gives shard p mod shards and slot
    p div shards.  Shard sizes differ by one at most and slots have no gap.  From a row number, n
    and the seed anyone can compute where a row lies.  Rows of equal identity (nulls included) are
    numbered in any order, side by side unless they are more than a slice holds: then they are spread
    over all slices.  An empty table stays empty.
    """
    digest = F.md5(F.concat_ws("\x01", *[F.coalesce(c.cast("string"), F.lit("\x02")) for c in identity]))
    dealt = spread_repeats(docs.withColumns({"_digest": digest, "_one": F.lit(1).cast("long")}), "_digest", rows)
    numbered = running(dealt, [], "_digest", [], {"_row": "_one"}, rows)
    moved = numbered.drop("_digest", "_one").withColumn("_p", _permuted(max(rows, 1), seed)(F.col("_row")))
    return moved.withColumns({"_shard": F.pmod("_p", F.lit(shards)).cast("int"), "_slot": F.floor(F.col("_p") / shards).cast("long")}).drop("_p")
