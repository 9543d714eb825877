"""Mixtures of sources: temperature weights whose exponent is bisected, realised as whole permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.tables import cut, running, small

#: The exponent is a multiple of 1/STEPS.
STEPS = 4096
FAN = 16


def token_size(text: Column) -> Column:
    """Words of a text and one for its end, so that an empty document has a size too."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long") + 1


def exponent(sources: DataFrame, entropy: float, repeats: float) -> float:
    """Largest exponent that meets the entropy, unless the repetition limit asks for a larger one.

    ``sources`` has one row per source with its ``total``.  The entropy of the weights is a share of
    that of equal weights and falls with the exponent; so does the most often repeated source's
    number of epochs, if the least repeated one has exactly one.  Both are bisected over integers,
    sixteen candidates in one aggregate, so the sources never leave the executors.
    """
    top = sources.agg(F.sum("total").alias("all"), F.max("total").alias("most"), F.min("total").alias("least"), F.count(F.lit(1)).alias("n")).first()
    if not top["n"] or top["n"] == 1:
        return 1.0
    share = F.col("total") / F.lit(float(top["all"]))

    def meets(ks: list[int]) -> dict[int, bool]:
        sums = sources.agg(*[F.sum(F.pow(share, F.lit(k / STEPS))).alias(f"z{k}") for k in ks], *[
            F.sum(F.pow(share, F.lit(k / STEPS)) * F.ln(share)).alias(f"l{k}") for k in ks]).first()
        return {k: math.log(sums[f"z{k}"]) - k / STEPS * sums[f"l{k}"] / sums[f"z{k}"] >= entropy * math.log(top["n"]) for k in ks}

    lo, hi = 0, STEPS + 1  # meets(lo), not meets(hi)
    while hi - lo > 1:
        ks = sorted({lo + (hi - lo) * i // FAN for i in range(1, FAN)} - {lo, hi})
        for k, good in meets(ks).items():
            if k <= STEPS and good:
                lo = max(lo, k)
            else:
                hi = min(hi, k)
    spread, a, b = top["most"] / top["least"], -1, STEPS  # over the limit at a, within it at b
    while b - a > 1:
        k = (a + b) // 2
        a, b = (a, k) if spread ** (1 - k / STEPS) <= repeats else (k, b)
    return max(lo, b) / STEPS


def plan(sized: DataFrame, entropy: float, repeats: float) -> tuple[DataFrame, float, int]:
    """(one row per source: total, weight, epochs, rest; the exponent; the number of sources).

    The budget is the least that gives every source one whole epoch: ``epochs`` whole permutations
    and ``rest`` further tokens, whole / rest = (largest total / total) ** (1 - exponent).
    """
    sources = cut(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("k")).alias("total")))
    alpha = exponent(sources, entropy, repeats)
    top = sources.agg(F.max("total").alias("most"), F.sum(F.pow("total", F.lit(alpha))).alias("z"), F.count(F.lit(1)).alias("n")).first()
    passes = F.pow(F.lit(float(top["most"] or 1)) / F.col("total"), F.lit(1 - alpha))
    out = sources.withColumns({"weight": F.pow("total", F.lit(alpha)) / F.lit(float(top["z"] or 1)), "epochs": F.floor(passes).cast("long")})
    return out.withColumn("rest", F.floor((passes - F.col("epochs")) * F.col("total")).cast("long")), alpha, top["n"]


def _order(epoch: Column) -> Column:
    """Digest that orders the documents of a source in an epoch: a fresh permutation for each."""
    return F.md5(F.concat_ws(":", epoch.cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string")))


def mixture(docs: DataFrame, entropy: float, repeats: float, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per emission: id, source, epoch, size, weight, alpha, start (tokens of the source before it).

    Every document is emitted in each whole epoch of its source; the last, partial epoch is the
    part of its permutation that starts within ``rest`` tokens.  A null source is a source; null and
    empty texts have size 1; null ids and repeated rows are emitted like others.  Rows of equal id, source and size are
    ordered as one with their number, so however many they are, they lie in one place, where the budget cuts
    between them.  An empty table gives none; other columns are not read.
    """
    name = lambda c: F.col(f"`{c}`")
    sized = cut(docs.select(name(id_col).alias("id"), name(source_col).alias("source"), token_size(name(text_col)).alias("size")).groupBy(
        "id", "source", "size").agg(F.count(F.lit(1)).alias("k")))
    sources, alpha, kinds = plan(sized, entropy, repeats)
    rows = sized.count()
    quota = small(sources.withColumnRenamed("source", "_s"), kinds or 0)
    each = sized.join(quota, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    each = each.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    each = each.where((F.col("epoch") < F.col("epochs")) | (F.col("rest") > 0)).withColumn("order", _order(F.col("epoch")))
    placed = running(each.withColumn("bulk", F.col("size") * F.col("k")), ["source", "epoch"], "order", [], {"before": "bulk"}, rows, int((kinds or 0) * (repeats + 1)))
    fit = F.greatest(F.least(F.ceil((F.col("rest") - F.col("before")) / F.col("size")), F.col("k")), F.lit(0))
    sent = placed.withColumn("sent", F.when(F.col("epoch") < F.col("epochs"), F.col("k")).otherwise(fit).cast("long")).where("sent > 0")
    kept = sent.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sent") - 1)))
    return kept.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "epoch", F.col("size").alias("n_tokens"),
                       F.round("weight", 6).alias("weight"), F.lit(alpha).alias("alpha"),
                       (F.col("epoch") * F.col("total") + F.col("before") + F.col("nth") * F.col("size")).alias("start_token"))


def mixed_documents(docs: DataFrame, entropy: float, repeats: float, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mixture emits it, with their columns unchanged.

    The partial epoch is realised by the digest of its last document, one value per source, so the
    texts are neither joined by id nor shuffled.  Of equal rows at that place (they tie) the emissions go round: as
    many of them as the mixture emits there, by a running number within their digest.  Given columns may have any names.
    """
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                        F.col(f"`{source_col}`").alias("source"), token_size(F.col(f"`{text_col}`")).alias("size"))
    emitted = mixture(docs, entropy, repeats, id_col, text_col, source_col).select(
        F.col(id_col).alias("id"), F.col(source_col).alias("_s"), "epoch", F.col("n_tokens").alias("size"))
    last = emitted.withColumn("order", _order(F.col("epoch"))).groupBy("_s", "epoch", "order").agg(F.count(F.lit(1)).alias("n"))
    ends = cut(last.groupBy("_s").agg(F.max(F.struct("epoch", "order", "n")).alias("_last")))
    out = sized.join(small(ends, ends.count()), F.col("source").eqNullSafe(F.col("_s"))).withColumn("order", _order(F.col("_last.epoch")))
    # Rows at the very end are few: one digest per source.
    edge = out.where(F.col("order") == F.col("_last.order"))
    number = F.row_number().over(Window.partitionBy("_s", "order").orderBy(F.xxhash64("row")))
    turn = edge.withColumn("copies", F.col("_last.epoch") + (number <= F.col("_last.n")).cast("long"))
    rest = out.where(F.col("order") != F.col("_last.order")).withColumn("copies", F.col("_last.epoch") + (F.col("order") < F.col("_last.order")).cast("long"))
    every = rest.unionByName(turn).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1).cast("long")))).alias("copy"))
    return every.select("row.*")
