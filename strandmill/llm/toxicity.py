"""Toxicity by non-negative positive-unlabelled learning over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.sketch import Shingler
from strandmill.llm.tables import cut, small
from strandmill.llm.texts import NON_ALNUM, by_bytes, byte_table, mix, seeds, utf8

BITS, SIZES = 20, (4, 5, 6, 8)
#: The first, second, ... occurrence of an n-gram in a text are features of their own, up to this one.
LEVELS = 4
#: Bounds of the sample that the gradient steps read: confirmed toxic documents, unlabelled documents; and of the model.
#: Document rates and the cut are taken over every document that is not held out.
POSITIVE_ROWS, UNLABELLED_ROWS, FEATURES = 4000, 8000, 4096
PART_BYTES, STEPS = 1 << 18, 300
#: Share of the confirmed documents that must hold an n-gram for it to become a feature.
LEAST_SHARE = 0.01
#: Least log-likelihood ratio of a feature: beyond what chance gives to the best of so many features.
LEAST_CLEAR = float(np.log(LEVELS << BITS))
#: Copies that make up more than one in so many documents weigh as one document; whole weights, so that sums are exact.
CROWD, UNIT = 2000, 1 << 24
#: Steps of log-odds between possible cuts.
CUTS = 64


def held_out(id_: Column) -> Column:
    """Rows no label may be learned from; a null id is not held out, but has no label either."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Grams:
    """Hashed n-grams of lower-cased bytes, where every run of other characters counts as blanks."""

    def __init__(self):
        cut_, low = byte_table(NON_ALNUM)
        low[cut_] = 0x20
        self.values, self.weights = seeds("grams", 256)[low], seeds("place", max(SIZES) + 1)

    def each(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """For each size the feature of the n-gram starting at each byte, or -1 where a text ends first."""
        data = data[offsets[0]: offsets[-1]]
        ends, starts = offsets[1:] - offsets[0], offsets[:-1] - offsets[0]
        v = self.values[data]
        h = v * self.weights[0]
        for size in range(2, max(SIZES) + 1):
            if len(v) < size:
                break
            h = h[: len(v) - size + 1] + v[size - 1:] * self.weights[size - 1]
            if size in SIZES:
                x = (h ^ (h >> np.uint64(29))) * self.weights[-1]
                out = np.full(len(v), -1, dtype=np.int32)
                out[: len(x)] = (x >> np.uint64(64 - BITS)).astype(np.int32)
                for back in range(1, size):
                    out[np.maximum(ends - back, starts)[ends > starts]] = -1
                yield out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the partition hold each feature."""
    grams, seen = Grams(), np.zeros(LEVELS << BITS, dtype=np.int32)
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for k in range(batch.num_rows):
            found = [x[x >= 0] for x in grams.each(data, offsets[k: k + 2])]
            if found:
                own, times = np.unique(np.concatenate(found), return_counts=True)
                for level in range(LEVELS):
                    seen[own[times > level].astype(np.int64) * LEVELS + level] += 1
    rows = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(seen[rows], pa.int64())], names=["f", "p"])


class Minima:
    """Three minima of hashed 5-word shingles per text: near copies share most of them; without words they are 0."""

    def __init__(self):
        self.shingler, self.turns = Shingler(), seeds("turns", 3)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, 3), dtype=np.int64)
        for k, own in enumerate(self.shingler.sets(data, offsets)):
            if len(own):
                out[k] = [mix(own + t).min() >> np.uint64(1) for t in self.turns]
        return out


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minima = Minima()
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        parts = [minima(data, offsets[i: j + 1]) for i, j in by_bytes(offsets, PART_BYTES)]
        out = np.concatenate(parts) if parts else np.zeros((0, 3), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(out[:, i]) for i in range(3)]], names=["text", "positive", "m0", "m1", "m2"])


def _minima_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minima = Minima()
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for i, j in by_bytes(offsets, PART_BYTES):
            out = minima(data, offsets[i: j + 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(3, dtype=np.int32), j - i)), pa.array(out.reshape(-1))], names=["turn", "least"])


@dataclass
class Crowds:
    """The minima that large groups of copies share, sorted for each of the three, with the groups' sizes."""

    least: list[np.ndarray]
    sizes: list[np.ndarray]

    @staticmethod
    def find(texts: DataFrame) -> Crowds:
        """At most ``CROWD`` groups for each minimum pass the bound, whatever the table's size."""
        rows = texts.count()
        counts = texts.mapInArrow(_minima_alone, "turn int, least long").groupBy("turn", "least").agg(F.count(F.lit(1)).alias("n"))
        got = counts.where(F.col("n") * CROWD > F.lit(max(rows, CROWD))).orderBy("turn", "least").collect()
        each = [[r for r in got if r["turn"] == turn] for turn in range(3)]
        return Crowds([np.array([r["least"] for r in e], dtype=np.int64) for e in each], [np.array([r["n"] for r in e], dtype=np.int64) for e in each])

    def weights(self, minima: Minima, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Weight of each text in whole units: ``UNIT``, shared out among the largest group of copies that it belongs to."""
        size = np.ones(len(offsets) - 1, dtype=np.int64)
        if any(map(len, self.least)):
            own = minima(data, offsets)
            for turn, (least, sizes) in enumerate(zip(self.least, self.sizes, strict=True)):
                if len(least):
                    at = np.minimum(np.searchsorted(least, own[:, turn]), len(least) - 1)
                    size = np.maximum(size, np.where(least[at] == own[:, turn], sizes[at], 1))
        return UNIT // size


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float


class Places:
    """Place of each feature by n-gram and occurrence, from 1; 0 is none."""

    def __init__(self, features: np.ndarray):
        place = np.zeros(LEVELS << BITS, dtype=np.int32)
        place[features] = np.arange(1, len(features) + 1)
        place = place.reshape(-1, LEVELS)
        self.levels, self.known = [np.ascontiguousarray(place[:, k]) for k in range(LEVELS)], place.any(axis=1)


def _hits(grams: Grams, places: Places, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature place) of the known features of each text; place 0 is none."""
    texts = len(offsets) - 1
    # Text number and n-gram in one number; short ones sort twice as fast.
    owner = np.repeat(np.arange(texts, dtype=np.int32 if texts < 1 << (31 - BITS) else np.int64), np.diff(offsets)) << BITS
    both = [owner[:0]]
    for x in grams.each(data, offsets):
        at = np.flatnonzero(places.known[x] & (x >= 0))
        both.append(owner[at] + x[at])
    own, times = np.unique(np.concatenate(both), return_counts=True)
    text, gram = own >> BITS, own & ((1 << BITS) - 1)
    rows, known = [], []
    for level in range(LEVELS):
        at = np.flatnonzero(times > level) if level else np.arange(len(own))
        there = places.levels[level][gram[at]]
        rows.append(text[at[there > 0]])
        known.append(there[there > 0])
    return np.concatenate(rows), np.concatenate(known)


def _rates(features: np.ndarray, crowds: Crowds):
    """Weight of the partition's documents that hold each feature; feature -1 is every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, place, minima = Grams(), Places(features), Minima()
        total = np.zeros(len(features) + 1, dtype=np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in by_bytes(offsets, PART_BYTES):
                weight = crowds.weights(minima, data, offsets[i: j + 1])
                text, known = _hits(grams, place, data, offsets[i: j + 1])
                # Whole numbers below 2^53 add up exactly as doubles.
                total += np.bincount(known, weights=weight[text], minlength=len(total)).astype(np.int64)
                total[0] += weight.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, features)[at]), pa.array(total[at])], names=["f", "u"])

    return run


def _levels(model: Model, crowds: Crowds):
    """Weight of the partition's documents at each step of log-odds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, place, minima = Grams(), Places(model.features), Minima()
        total = np.zeros(80 * CUTS + 1, dtype=np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in by_bytes(offsets, PART_BYTES):
                weight = crowds.weights(minima, data, offsets[i: j + 1])
                text, known = _hits(grams, place, data, offsets[i: j + 1])
                f = np.bincount(text, weights=model.weights[known], minlength=j - i) + model.bias
                total += np.bincount(_step(f) + 40 * CUTS, weights=weight, minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at - 40 * CUTS), pa.array(total[at])], names=["step", "u"])

    return run


def _step(f: np.ndarray) -> np.ndarray:
    """Log-odds in whole steps; rounded first, so that the order of a sum does not decide."""
    return np.floor(np.round(np.clip(f, -40, 40) * CUTS, 6)).astype(np.int64)


def _rows(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, place = Grams(), Places(features)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in by_bytes(offsets, PART_BYTES):
                text, known = _hits(grams, place, data, offsets[i: j + 1])
                order = np.lexsort((known, text))
                text, known = text[order], known[order]
                cuts = np.searchsorted(text, np.arange(j - i + 1))
                lists = [known[cuts[k]: cuts[k + 1]].astype(np.int32).tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(lists, pa.binary())], names=["positive", "known"])

    return run


def fit_non_negative(rows: list[np.ndarray], positive: np.ndarray, features: int, prior: float, steps: int = STEPS, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the non-negative risk with the sigmoid loss on log-odds.

    The risk is prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]); while the second part
    is negative, its gradient is reversed, so that overfitting is undone (plain gradient steps with
    momentum and a scale per weight; all rows in every step).
    """
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    scale = positive / max(positive.sum(), 1), ~positive / max((~positive).sum(), 1)
    w, m, s = np.zeros(features + 2), np.zeros(features + 2), np.zeros(features + 2)
    w[-1] = -2.0
    for step in range(1, steps + 1):
        f = np.bincount(owner, weights=w[flat], minlength=len(rows)).astype(float) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        loss_n = -np.log(np.maximum(1 - p, 1e-12))
        rest = float((loss_n * scale[1]).sum() - prior * (loss_n * scale[0]).sum())
        slope = prior * scale[0] * (p - 1)
        side = scale[1] * p - prior * scale[0] * p
        slope = slope + side if rest >= 0 else -side
        g = np.bincount(flat, weights=slope[owner], minlength=features + 2).astype(float)
        g[-1] = slope.sum()
        g[:-1] += decay * w[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _middle(positive: np.ndarray, steps: np.ndarray, weights: np.ndarray, prior: float) -> float:
    """The cut of least non-negative risk under the 0/1 loss: both kinds of error, counted with the class prior.

    ``positive`` are steps of confirmed documents, ``weights`` those of all documents at each of ``steps``.
    """
    values = np.unique(np.concatenate([positive, steps]))
    cuts = np.append((values[1:] + values[:-1] + 1) / 2, values[-1] + 1.0 + CUTS)
    found = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    order = np.argsort(steps)
    below = np.append(0, np.cumsum(weights[order]))[np.searchsorted(steps[order], cuts)]
    flagged = 1 - below / max(below.max(), 1)
    return float(cuts[np.argmin(np.round(prior * (1 - found) + np.maximum(flagged - prior * found, 0), 9))]) / CUTS


def _clearest(candidates: np.ndarray, p: np.ndarray, n_p: float, u: np.ndarray, n_u: float, prior: float) -> np.ndarray:
    """The features that set confirmed documents apart: their rate among them beyond that among all documents."""
    a, b = p / n_p, np.minimum(u / n_u, 1.0)
    both = (p + u) / (n_p + n_u)

    def part(n: np.ndarray, rate: np.ndarray, all_: np.ndarray) -> np.ndarray:
        known = rate > 0
        return n * np.log(np.where(known, rate, 1.0) / np.where(known, all_, 1.0))

    clear = np.round(part(p, a, both) + part(u, b, both) + part(n_p - p, 1 - a, 1 - both) + part(n_u - u, 1 - b, 1 - both), 9)
    # All text holds toxic text at the rate of the prior, so this is the share of toxic text among
    # that with the feature; the least count keeps out words of a few copied documents.
    share = prior * a / (b + 2 / n_u)
    good = np.flatnonzero((a > b) & (share >= 0.5) & (clear >= LEAST_CLEAR))
    return np.sort(candidates[good[np.lexsort((candidates[good], -clear[good]))][:FEATURES]])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model | None:
    """Learn from confirmed toxic documents and unlabelled ones; None without confirmed documents.

    Only ids that are not held out are used.  The class prior is the share of toxic among all labels there.  How
    often unlabelled text holds an n-gram is counted over every document, whatever its label, and so is the share of
    documents beyond each cut; large groups of copies weigh as one document.  The gradient steps read a bounded
    sample: the ``positive_rows`` and ``unlabelled_rows`` documents of lowest id digest.  Features are the n-gram
    occurrences that set the confirmed documents apart most clearly; where chance explains them all, every text
    gets the same score.
    """
    given = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    known = docs.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    marked = cut(known.join(given, "_id", "left").groupBy("_y", "_id").agg(F.lit(1)).select("_y", "_id"))
    counts = marked.agg(F.count_if(F.col("_y") == 1).alias("p"), F.count("_y").alias("n")).first()
    if not counts["p"]:
        return None
    prior = counts["p"] / counts["n"]
    lowest = lambda df, n: df.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(n)
    sample = lowest(marked.where("_y = 1"), positive_rows).unionByName(lowest(marked.where("_y is null"), unlabelled_rows))
    chosen = cut(sample.select(F.col("_id").alias("_sid"), F.col("_y").isNotNull().alias("positive")))
    texts = docs.join(small(chosen, positive_rows + unlabelled_rows), F.col(id_col) == F.col("_sid")).select(F.col(text_col).cast("string").alias("text"), "positive")
    for key in ("m0", "m1", "m2"):  # copies of a text would lend it their number
        texts = cut(texts.select("text", "positive").mapInArrow(_least, "text string, positive boolean, m0 long, m1 long, m2 long") if key == "m0" else texts)
        texts = texts.groupBy("positive", key).agg(F.min(F.struct("text", "m0", "m1", "m2")).alias("_t")).select("positive", "_t.*")
    texts = cut(texts.select("text", "positive").repartition(6))
    confirmed = texts.where("positive").select("text")
    n_p = confirmed.count()
    often = confirmed.mapInArrow(_document_counts, "f long, p long").groupBy("f").agg(F.sum("p").alias("p")).where(F.col("p") >= max(5, LEAST_SHARE * n_p)).orderBy("f").toArrow()
    candidates, p = (often[c].to_numpy().astype(np.int64) for c in "fp")  # at most LEVELS << BITS of them
    everything = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"))
    crowds = Crowds.find(everything)
    rates = everything.mapInArrow(_rates(candidates, crowds), "f long, u long").groupBy("f").agg(F.sum("u").alias("u")).orderBy("f").toArrow()
    f, u = rates["f"].to_numpy(), rates["u"].to_numpy() / UNIT
    features = _clearest(candidates, p, n_p, np.where(np.isin(candidates, f), u[np.minimum(np.searchsorted(f, candidates), len(f) - 1)], 0.0), float(u[0]), prior)
    got = texts.mapInArrow(_rows(features), "positive boolean, known binary").collect()
    got.sort(key=lambda r: (r["positive"], bytes(r["known"])))  # sums do not depend on how rows arrive
    rows = [np.frombuffer(bytes(r["known"]), dtype=np.int32) for r in got]
    weights, bias = fit_non_negative(rows, positive := np.array([r["positive"] for r in got], dtype=bool), len(features), prior)
    model = Model(features, weights, bias)
    steps = everything.mapInArrow(_levels(model, crowds), "step long, u long").groupBy("step").agg(F.sum("u").alias("u")).orderBy("step").toArrow()
    own = _step(np.array([weights[r].sum() + bias for r, toxic in zip(rows, positive, strict=True) if toxic]))
    return Model(features, weights, bias - _middle(own, steps["step"].to_numpy(), steps["u"].to_numpy(), prior))


def _scored(model: Model | None, where: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, place = Grams(), Places(model.features if model else np.zeros(0, dtype=np.int64))
        for batch in batches:
            data, offsets = utf8(batch.column(where))
            out = np.zeros(batch.num_rows)
            for i, j in by_bytes(offsets, PART_BYTES) if model else ():
                text, known = _hits(grams, place, data, offsets[i: j + 1])
                f = np.bincount(text, weights=model.weights[known], minlength=j - i) + model.bias
                out[i:j] = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
            yield batch.append_column("_score", pa.array(out))

    return run


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with _score, from 0 to 1; without a model 0.  Null and empty texts get the bias alone."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _score double"
    return docs.mapInArrow(_scored(model, docs.columns.index(text_col)), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """``docs`` with _score, _toxic (score >= 0.5) and _held_out.

    Rows pass through in place; null ids have no label, repeated rows get equal scores, ids labelled
    twice count as toxic if one label says so, other columns are not looked at.
    """
    out = score(docs, fit(docs, labels, id_col, text_col, **bounds), text_col)
    return out.withColumns({"_toxic": F.col("_score") >= 0.5, "_held_out": held_out(F.col(id_col))})
