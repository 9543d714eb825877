"""Array column expressions: padding, alignment, small linear algebra on rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used inside a lambda is evaluated for every element, and the optimizer may inline a
    projected column into the lambda that reads it; a lambda variable is safe from both.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def clean_id(value: Column, vocab: int | None = None) -> Column:
    """Null, non-positive and (with ``vocab``) out-of-range ids become 0."""
    v = F.coalesce(value, F.lit(0)).cast("long")
    ok = v > 0
    if vocab:
        ok = ok & (v < vocab)
    return F.when(ok, v).otherwise(F.lit(0).cast("long"))


def fit_ids(values: Column, dim: int, vocab: int | None = None) -> Column:
    """Multi-slot categorical: clean each id, then fit to ``dim`` slots."""
    zero = F.lit(0).cast("long")
    base = F.coalesce(values.cast("array<bigint>"), F.array().cast("array<bigint>"))
    cleaned = F.transform(F.slice(base, 1, dim), lambda v: clean_id(v, vocab))
    return F.slice(F.concat(cleaned, F.array_repeat(zero, dim)), 1, dim)


def fit_vector(values: Column, dim: int) -> Column:
    """Dense vector: cut or zero-pad to ``dim`` doubles."""
    zero = F.lit(0.0)
    base = F.coalesce(values.cast("array<double>"), F.array().cast("array<double>"))
    kept = F.transform(F.slice(base, 1, dim), lambda v: F.coalesce(v, F.lit(0.0)))
    return F.slice(F.concat(kept, F.array_repeat(zero, dim)), 1, dim)


def sub_vector(values: Column, offset: int, dim: int) -> Column:
    """``dim`` elements starting at 0-based ``offset``."""
    return fit_vector(F.slice(values, offset + 1, dim), dim)


def align_to(length: Column, values: Column, keep_positive: bool = True) -> Column:
    """Cut or zero-pad a list column to another list's length (that may be 0)."""
    def pick(source: Column, i: Column) -> Column:
        v = F.coalesce(F.get(source, i), F.lit(0)).cast("long")
        return F.greatest(v, F.lit(0).cast("long")) if keep_positive else v

    empty = F.array().cast("array<bigint>")
    aligned = let(values, lambda source: F.transform(F.sequence(F.lit(0), length - 1), lambda i: pick(source, i)))
    return F.when(length > 0, aligned).otherwise(empty)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return F.coalesce(F.try_divide(total(values), F.size(values)), F.lit(0.0))


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def double_array(values: Sequence[float]) -> Column:
    """A literal array<double>; only for fitted state of fixed width."""
    return F.array(*[F.lit(float(v)) for v in values])
