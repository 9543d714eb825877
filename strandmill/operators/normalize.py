"""Cleaning of the declared wide row: every operator here is row-local (no shuffle)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions import arrays as A
from strandmill.functions import scalars as S
from strandmill.operators.ranking import TASK_ROWS, running_totals
from strandmill.operators.registry import DeclaredSchema, Registry

# Columns that pass the output contract without being registered features.
PASSTHROUGH = {"label", "timestamp", "user_id", "item_id"}


def clean_rows(
    df: DataFrame, schema: DeclaredSchema, clip_vocab: bool = False, training: bool = True,
    split: Mapping[int, list[tuple[str, int, int]]] | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Declared columns -> cleaned logical columns (ids, vectors, aligned sequences, label)."""
    df = schema.conform(df)
    cols: dict[str, Column] = {
        "timestamp": F.col("timestamp").cast("long"),
        "user_id": F.coalesce(F.col("user_id"), F.lit(0)).cast("long"),
        "item_id": F.coalesce(F.col("item_id"), F.lit(0)).cast("long"),
        "label": label_of(F.col("label_type")) if training else F.lit(0).cast("long"),
    }
    for side, group in (("user", schema.user_int), ("item", schema.item_int)):
        for fid, vocab, dim in group:
            limit = vocab if clip_vocab and vocab > 0 else None
            raw = F.col(f"{side}_int_feats_{fid}")
            cols[f"{side}_cat_f{fid}"] = A.clean_id(raw, limit) if dim == 1 else A.fit_ids(raw, dim, limit)
    for side, group in (("user", schema.user_dense), ("item", schema.item_dense)):
        for fid, dim in group:
            raw = F.col(f"{side}_dense_feats_{fid}")
            parts = (split or {}).get(fid) if side == "item" else None
            if parts:
                for suffix, offset, width in parts:
                    cols[f"{side}_cont_f{fid}_{suffix}"] = A.sub_vector(raw, offset, width)
            else:
                cols[f"{side}_cont_f{fid}"] = A.fit_vector(raw, dim)
    for domain in schema.domains:
        spec = schema.sequences[domain]
        lead = F.col(f"{spec.prefix}_{spec.side[0][0]}")
        length = F.coalesce(F.size(lead), F.lit(0))
        cols[f"{domain}_len"] = F.greatest(length, F.lit(0))
        for fid, _ in spec.side:
            cols[f"{domain}_f{fid}"] = A.align_to(length, F.col(f"{spec.prefix}_{fid}"))
        if spec.ts_fid is not None:
            cols[f"{domain}_ts"] = A.align_to(length, F.col(f"{spec.prefix}_{spec.ts_fid}"), keep_positive=False)
    return df.select(*keep, *[c.alias(n) for n, c in cols.items()])


def label_of(label_type: Column) -> Column:
    """Positive when the label type is 2."""
    return (F.coalesce(label_type, F.lit(0)) == 2).cast("long")


def bucket_ids(value: Column, vocab: int, threshold: int, buckets: int) -> Column:
    """Fold the ids of a large vocabulary into ``buckets - 1`` ids, 0 staying 0."""
    if threshold <= 0 or vocab <= threshold:
        return value
    if buckets == 0:
        return F.lit(0).cast("long")
    return F.when(value > 0, F.pmod(value, F.lit(buckets - 1)) + 1).otherwise(value)


@F.pandas_udf(T.LongType())
def stable_hash64(values: pd.Series) -> pd.Series:
    """8-byte blake2b mapped to 1..2^63-1; Spark has no built-in blake2b."""
    top = (1 << 63) - 1
    return values.map(
        lambda v: None if v is None
        else int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big") % top + 1)


def token_ids(value: Column, vocab: int, native: bool = False) -> Column:
    """String -> token id in ``[1, vocab)``; ``native`` uses the JVM hash instead of blake2b."""
    if vocab < 2:
        raise ValueError("vocab must be at least 2")
    hashed = F.xxhash64(value) if native else stable_hash64(value)
    return F.pmod(hashed, F.lit(vocab - 1)) + 1


def padded(values: Column, width: int | Column) -> dict[str, Column]:
    """Fixed-width export: zero-padded values and a validity mask."""
    n = F.size(values)
    return {
        "values": A.fit_ids(values, width),
        "mask": F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i < n),
    }


def export_padded(df: DataFrame, column: str, width: int | None = None) -> DataFrame:
    """Pad a sequence column to ``width``, by default the longest sequence of the table (>= 1)."""
    if width is None:
        width = max(1, int(df.agg(F.max(F.size(column))).first()[0] or 0))
    parts = padded(F.col(column), width)
    return df.withColumns({f"{column}_values": parts["values"], f"{column}_mask": parts["mask"]})


def export_padded_batches(
    df: DataFrame, key: str, column: str, batch_rows: int, batch_values: int | None = None, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Pad a sequence column batch by batch: ``batch``, ``{column}_values`` and ``{column}_mask``, as wide as the batch needs.

    Rows are put in order of length, then ``key``, and dealt by running totals: a batch ends after
    ``batch_rows`` rows, and with ``batch_values`` also where the running number of values passes a multiple of it.  So rows of
    like length share a batch, a long sequence widens its own batch alone, and no batch holds
    more than it should.  The width is the longest of the batch, at least 1.  A null sequence is an empty one.
    """
    length = F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)).cast("long")
    sized = df.withColumn("_n", length)
    dealt = running_totals(sized, [], [F.col("_n"), F.col(key)], {"_row": F.lit(1).cast("long"), "_sum": F.col("_n")}, task_rows)
    chunk = F.floor((F.col("_row") - 1) / batch_rows)
    by_values = F.floor((F.col("_sum") - F.col("_n")) / batch_values) if batch_values else F.lit(0).cast("long")
    work = dealt.withColumns({"_chunk": chunk, "_part": by_values})
    together = Window.partitionBy("_chunk", "_part")
    wide = work.withColumn("_width", F.greatest(F.max("_n").over(together), F.lit(1)).cast("int"))
    parts = padded(F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType)), F.col("_width"))
    return wide.withColumns({"batch": F.struct(F.col("_chunk").alias("chunk"), F.col("_part").alias("part")),
                             f"{column}_values": parts["values"], f"{column}_mask": parts["mask"]}).drop("_n", "_row", "_sum", "_chunk", "_part", "_width")


def export_flat(df: DataFrame, key: str, column: str) -> DataFrame:
    """Jagged export: one row per element."""
    return df.select(key, F.posexplode(column).alias("pos", "value"))


def check_contract(df: DataFrame, registry: Registry, drop: Iterable[str] = ()) -> DataFrame:
    """Drop the listed columns and refuse any other column that nobody declared."""
    dropped = set(drop)
    known = {f.column or f.name for f in registry} | PASSTHROUGH
    stray = [c for c in df.columns if c not in dropped and c not in known]
    if stray:
        raise ValueError(f"columns are neither registered nor passed through: {stray}")
    return df.drop(*[c for c in df.columns if c in dropped])


def _zero_of(field: T.StructField) -> Column:
    c, t = F.col(field.name), field.dataType
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda _: _zero_element(t.elementType))
    return F.lit(0).cast(t)


def _zero_element(t: T.DataType) -> Column:
    if isinstance(t, T.StructType):
        return F.struct(*[F.lit(0).cast(f.dataType).alias(f.name) for f in t.fields])
    return F.lit(0).cast(t)


def mask_columns(df: DataFrame, columns: Sequence[str], when: Column | None = None) -> DataFrame:
    """Zero columns (keeping lengths), for all rows or for the rows where ``when`` holds."""
    fields = {f.name: f for f in df.schema.fields}
    out = {}
    for name in columns:
        zero = _zero_of(fields[name])
        out[name] = zero if when is None else F.when(when, zero).otherwise(F.col(name))
    return df.withColumns(out)


def mask_domain(df: DataFrame, domain: str, when: Column | None = None) -> DataFrame:
    """Zero a sequence domain and its length, never its pre-truncation length."""
    hit = [c for c in df.columns
           if (c == domain or c.startswith(f"{domain}_")) and not c.endswith("_raw_len")]
    return mask_columns(df, hit, when)


def mask_at_random(
    df: DataFrame, groups: Mapping[str, Sequence[str]], probs: Mapping[str, float], key: str, seed: int,
) -> DataFrame:
    """Zero each group of columns in each row with its probability, reproducibly."""
    for name, columns in groups.items():
        p = probs.get(name, 0.0)
        if p > 0:
            hit = S.draw(seed, F.lit(name), F.col(key)) < p
            df = mask_columns(df, columns, hit)
    return df
