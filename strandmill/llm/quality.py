"""Quality by random Fourier features over document statistics: ridge scores, then isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.tables import cut
from strandmill.llm.texts import BLANKS, WordHasher, by_bytes, utf8
from strandmill.llm.toxicity import held_out

PART_BYTES = 2 << 20
FEATURES, WIDTH, RIDGE, BINS = 128, 3.0, 1e-4, 1000
STATISTICS = ["log_bytes", "word_bytes", "upper", "digit", "mark", "odd", "bang", "line_words", "again", "distinct", "top", "word_marks"]


def statistics(data: np.ndarray, offsets: np.ndarray, words: WordHasher) -> np.ndarray:
    """One row of STATISTICS per text; all are shares or bounded logarithms, 0 for an empty text."""
    raw = data[offsets[0]: offsets[-1]]
    starts, n = offsets[:-1] - offsets[0], np.diff(offsets)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.append(starts, len(raw))])
    upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
    letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    blank = words.cut[raw]
    plain = (raw == 44) | (raw == 46)
    odd = ~(letter | digit | blank | plain)
    hashes, counts = words.hashes(data, offsets)
    out, at = np.zeros((len(n), len(STATISTICS))), 0
    letters, lines = np.maximum(sums(letter), 1), sums(raw == 10) + 1
    out[:, 0] = np.log1p(n) / 12
    out[:, 1] = np.log1p(n / np.maximum(counts, 1)) / 4
    out[:, 2] = sums(upper) / letters
    for k, mask in ((3, digit), (4, plain), (5, odd), (6, raw == 33)):
        out[:, k] = sums(mask) / np.maximum(n, 1)
    out[:, 7] = np.log1p(counts / lines) / 7
    out[:, 11] = np.minimum(sums(odd) / np.maximum(counts, 1), 2) / 2
    for k, c in enumerate(counts.tolist()):
        if c:
            own = np.sort(hashes[at: at + c])
            edges = np.flatnonzero(own[1:] != own[:-1])
            runs = np.diff(np.concatenate([[-1], edges, [c - 1]]))
            out[k, 8] = (hashes[at + 1: at + c] == hashes[at: at + c - 1]).mean() if c > 1 else 0
            out[k, 9], out[k, 10] = len(runs) / c, runs.max() / c
        at += c
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHasher(BLANKS)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in by_bytes(offsets, PART_BYTES):
            rows = statistics(data, offsets[i: j + 1], words)
            ends = pa.array(np.arange(j - i + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1)))], names=["id", "stats"])


@dataclass
class Fourier:
    """cos(x W + b) approximates a Gaussian kernel of standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray
    ways: np.ndarray
    phase: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.ways + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([z, np.ones(len(x))])


def _normal_equations(fourier: Fourier):
    """Sums of z z' and z y over the rows of a partition, one row per cell of the upper triangle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = None, len(STATISTICS)
        for batch in batches:
            if batch.num_rows:
                z = fourier(np.asarray(batch.column(0).flatten()).reshape(-1, size))
                z = np.column_stack([z, np.asarray(batch.column(1), dtype=np.float64)])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            at = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(at[0] * len(total) + at[1]), pa.array(total[at])], names=["cell", "value"])

    return run


def _ridge_scores(fourier: Fourier, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.asarray(batch.column("stats").flatten()).reshape(-1, len(STATISTICS))
            raw = fourier(stats) @ weights if len(stats) else np.zeros(0)
            kept = [i for i, n in enumerate(batch.schema.names) if n != "stats"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(raw)], names=[*[batch.schema.names[i] for i in kept], "raw"])

    return run


def isotonic(x: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): the non-decreasing step fit to shares good / count, by pooling neighbours."""
    blocks: list[list[float]] = []
    for place, g, c in zip(x.tolist(), good.tolist(), count.tolist(), strict=True):
        blocks.append([place, g, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, g2, c2 = blocks.pop()
            blocks[-1][1] += g2
            blocks[-1][2] += c2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, score, held_out of every row of ``docs``.

    Texts become twelve statistics in one pass.  Labelled rows that are not held out give means and
    scales, then the normal equations of a ridge regression on random Fourier features, summed per
    partition and then by cell; then counts per score bin for the calibration.  All labelled rows
    count, and only sums reach the driver.

    Null and empty texts have zero statistics and are scored like others; null ids have no label;
    repeated rows get equal scores; ids labelled twice count by the larger label; other columns are
    not read.  Without labels every score is 0.5; an empty table gives none.
    """
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    measured = cut(pair.mapInArrow(_measured, "id long, stats array<double>"))
    given = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna().where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    train = cut(measured.join(given, "id").select("stats", "y"))
    cells = [F.col("stats")[i] for i in range(len(STATISTICS))]
    sums = train.agg(F.count(F.lit(1)), *[F.avg(c) for c in cells], *[F.stddev_pop(c) for c in cells]).first()
    held = held_out(F.col("id")).alias("held_out")
    if not sums[0]:
        return measured.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"), held)
    k, draw = len(STATISTICS), np.random.default_rng(20240229)
    fourier = Fourier(np.array(sums[1: k + 1], dtype=float), np.maximum(np.array(sums[k + 1:], dtype=float), 1e-3),
                      draw.normal(size=(k, FEATURES)) / WIDTH, draw.uniform(0, 2 * np.pi, FEATURES))
    got = train.mapInArrow(_normal_equations(fourier), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    size = FEATURES + 2
    full = np.zeros((size, size))
    for r in got:
        full[divmod(r["cell"], size)] = r["value"]
    full = full + np.triu(full, 1).T
    weights = np.linalg.solve(full[:-1, :-1] + RIDGE * sums[0] * np.eye(size - 1), full[:-1, -1])
    bin_ = F.least(F.greatest(F.floor((F.col("raw") + 0.5) * BINS / 2), F.lit(0)), F.lit(BINS - 1)).cast("int")
    bins = train.mapInArrow(_ridge_scores(fourier, weights), "y int, raw double").groupBy(bin_.alias("bin")).agg(
        F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    at, share = isotonic(*[np.array([r[c] for r in bins], dtype=float) for c in ("bin", "good", "n")])
    step = np.maximum(np.searchsorted(at, np.arange(BINS), "right") - 1, 0)
    values = F.array(*[F.lit(float(v)) for v in share[step]])
    scored = measured.mapInArrow(_ridge_scores(fourier, weights), "id long, raw double")
    return scored.select(F.col("id").alias(id_col), F.get(values, bin_).alias("score"), held)
