"""Near-duplicate groups: SetSketch bands propose, a likelihood estimate sifts, whole sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm import sketch
from strandmill.llm.components import components
from strandmill.llm.tables import Scratch, small
from strandmill.llm.texts import by_bytes, utf8

PART_BYTES = 2 << 20
#: Sets of either side that a cell holds, on average; a set counts once for each so many shingles.
CELL, SHINGLES = 256, 512
#: Steps over shared band values in which a neighbourhood finds its smallest member.
WIDER = 2


def _ragged(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _pieces(batches: Iterator[pa.RecordBatch]):
    """(ids, keys, shingle sets) of runs of texts of bounded bytes."""
    shingler = sketch.Shingler()
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for i, j in by_bytes(offsets, PART_BYTES):
            yield batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), shingler.sets(data, offsets[i: j + 1])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for ids, own, sets in _pieces(batches):
        # Sets of one or two shingles reach 0.75 only with an equal set, so they need no bands.
        large = [k for k, s in enumerate(sets) if len(s) > 2]
        found = sketch.bands(sketch.registers([sets[k] for k in large])) if large else []
        keys = [np.zeros(0, dtype=np.int64)] * len(sets)
        for k, b in zip(large, found, strict=True):
            keys[k] = b
        names = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [ids, own, pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), _ragged(keys)],
            names=["id", "key", "n_shingles", "set_id", "bands"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for _, _, sets in _pieces(batches):
        sets = [s for s in sets if len(s) > 2]
        if sets:
            levels = [r.tobytes() for r in sketch.registers(sets)]
            names = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(levels, pa.binary()), _ragged(sets)],
                names=["set_id", "n", "levels", "hashes"])


class _Block:
    """The sets of one side of a cell, each with the label of its component."""

    def __init__(self):
        self.nodes, self.labels, self.sizes, self.levels, self.sets = [], [], [], [], []

    def add(self, batch: pa.RecordBatch) -> None:
        self.nodes += batch.column("node").to_pylist()
        self.labels += batch.column("comp").to_pylist()
        self.sizes += batch.column("n").to_pylist()
        self.levels += [np.frombuffer(v, dtype=np.uint16) for v in batch.column("levels").to_pylist()]
        column = batch.column("hashes")
        flat = np.asarray(column.flatten()).view(np.uint64)
        ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy())])
        self.sets += [flat[ends[i]: ends[i + 1]].copy() for i in range(len(column))]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.labels), np.array(self.sizes), np.stack(self.levels)


def _links(left: _Block, right: _Block) -> Iterator[tuple[int, int]]:
    """Links between the sides (or within one) that join two components: fewer than there are sets."""
    labels, sizes, levels = left.arrays()
    theirs, their_sizes, their_levels = (labels, sizes, levels) if left is right else right.arrays()
    for i in range(len(labels)):
        other = np.flatnonzero(theirs != labels[i])
        other = other[other > i] if left is right else other
        same = (their_levels[other] == levels[i]).sum(axis=1)
        other = other[same >= sketch.LEAST_ESTIMATE * sketch.REGISTERS]
        if not len(other):
            continue
        near = sketch.joint_estimate(np.broadcast_to(levels[i], (len(other), sketch.REGISTERS)), their_levels[other],
                                     np.full(len(other), sizes[i]), their_sizes[other]) >= sketch.LEAST_ESTIMATE
        for j in other[near].tolist():
            old, new = theirs[j], labels[i]
            if old != new and sketch.linked(left.sets[i], right.sets[j]):
                labels[labels == old], theirs[theirs == old] = new, new
                yield left.nodes[i], right.nodes[j]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cell after cell, in order: the rows of side 0, then those of side 1 (none: side 0 meets itself)."""
    cell, sides = None, (_Block(), _Block())

    def close() -> pa.RecordBatch:
        left, right = sides
        found = list(_links(left, right if right.nodes else left)) if left.nodes else []
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("x", "y", "side")], axis=1)
        starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]]) if len(key) else [0]
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            if cell is not None and (key[i, :2] != cell).any():
                yield close()
                sides = (_Block(), _Block())
            cell = key[i, :2]
            sides[int(key[i, 2])].add(batch.slice(i, j - i))
    if cell is not None:
        yield close()


def _meet(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links found in the cells of ``rows`` (x, y, side, node, comp); each set is sent once to each of its cells."""
    cells = rows.join(sets, "node").repartition("x", "y").sortWithinPartitions("x", "y", "side")
    return cells.select("x", "y", "side", "node", "comp", "n", "levels", "hashes").mapInArrow(_met, "a long, b long")


def _weight(n: Column) -> Column:
    return F.ceil(n / F.lit(SHINGLES))


def _parts(weight: Column) -> Column:
    return F.floor(weight / CELL) + 1


def _stars_met(members: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each set against the smallest one that shares a band value with it."""
    lead = members.where("node != lead").groupBy("node").agg(F.min("lead").alias("x")).join(sizes, "node")
    parts = lead.groupBy("x").agg(_parts(F.sum(_weight(F.col("n")))).cast("long").alias("parts"))
    right = lead.join(parts, "x").select("x", F.pmod(F.xxhash64("node"), "parts").alias("y"), F.lit(1).alias("side"), "node")
    left = parts.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("y"), F.lit(0).alias("side"), F.col("x").alias("node"))
    return _meet(left.unionByName(right).withColumn("comp", F.col("node")), sets)


def _blocks_met(members: DataFrame, sets: DataFrame, sizes: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """All sets of different components that share a band value, block against block.

    ``members`` has bucket, node, lead and comp.  A block holds sets of one neighbourhood (the smallest lead a few steps away), about
    CELL of them; components larger than that have blocks of their own, which never meet each other.
    """
    sides = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
    open_ = scratch.keep(members.join(sides, "bucket"))
    named = open_.select("bucket", "node", "comp", "lead")
    for _ in range(WIDER):  # the least lead among the neighbours: a crowd gets one name, so its blocks are full
        least = named.groupBy("node").agg(F.min("lead").alias("lead"))
        lead = open_.select("bucket", "node").join(least, "node").groupBy("bucket").agg(F.min("lead").alias("lead"))
        named = open_.select("bucket", "node", "comp").join(lead, "bucket")
    near = scratch.keep(named.groupBy("node", "comp").agg(F.min("lead").alias("lead")).join(sizes, "node").withColumn("w", _weight(F.col("n"))))
    large = near.groupBy("lead", "comp").agg(F.sum("w").alias("of_comp")).where(F.col("of_comp") > CELL).select("lead", "comp", F.col("comp").alias("alone"))
    placed = near.join(large, ["lead", "comp"], "left")
    parts = placed.groupBy("lead", "alone").agg(_parts(F.sum("w")).cast("long").alias("parts")).select(
        F.col("lead").alias("l"), F.col("alone").alias("o"), "parts")
    placed = scratch.keep(placed.join(parts, (F.col("lead") == F.col("l")) & F.col("alone").eqNullSafe(F.col("o"))).select(
        "node", "comp", "alone", F.xxhash64("lead", "alone", F.pmod(F.xxhash64("node"), "parts")).alias("block")))
    held = scratch.keep(open_.select("bucket", "node").join(placed.select("node", "block", "alone"), "node").select("bucket", "block", "alone").distinct())
    x, y = held.alias("x"), held.alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") <= F.col("y.block")) & F.coalesce(
        F.col("x.alone") != F.col("y.alone"), F.lit(True))).select(F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct()
    pairs = scratch.keep(pairs)
    left = pairs.join(placed.select(F.col("block").alias("x"), "node", "comp"), "x").withColumn("side", F.lit(0))
    right = pairs.where("x != y").join(placed.select(F.col("block").alias("y"), "node", "comp"), "y").withColumn("side", F.lit(1))
    columns = ["x", "y", "side", "node", "comp"]
    return _meet(left.select(*columns).unionByName(right.select(*columns)), sets), [open_, near, placed, held, pairs]


def _labelled(docs: DataFrame) -> DataFrame:
    """``docs`` (id, key, text) without text: n_shingles, set_id and component_id of every row."""
    scratch = Scratch(docs.sparkSession)
    banded = scratch.keep(docs.mapInArrow(_banded, "id long, key string, n_shingles long, set_id binary, bands array<long>"))
    named = banded.where(F.col("set_id").isNotNull() & F.col("id").isNotNull())
    reps = scratch.keep(named.groupBy("set_id").agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))

    first = named.where(F.size("bands") > 0).join(
        reps.select(F.col("rep").alias("id"), "set_id", "node"), ["id", "set_id"]).select("node", F.explode("bands").alias("bucket"))
    shared = first.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead != last").select("bucket", "lead")
    members = scratch.keep(first.join(shared, "bucket").distinct())
    asked = reps.join(members.select("node").distinct(), "node")
    asked = scratch.keep(asked)
    few = small(asked.select(F.col("rep").alias("id")).distinct(), asked.count())
    sets = scratch.keep(docs.join(few, "id", "left_semi").mapInArrow(_full, "set_id binary, n long, levels binary, hashes array<long>").join(
        asked.select("set_id", "node"), "set_id").dropDuplicates(["set_id"]).drop("set_id"))
    sizes = sets.select("node", "n")

    edges = scratch.keep(_stars_met(members, sets, sizes))
    found = components(edges, scratch)
    labelled = scratch.keep(members.join(found, "node", "left").select("bucket", "node", "lead", F.coalesce("component", "node").alias("comp")))
    scratch.drop(members, found, asked)
    more, used = _blocks_met(labelled, sets, sizes, scratch)
    more = scratch.keep(more)
    scratch.drop(labelled, sets, *used)
    found = components(edges.unionByName(more), scratch)
    nodes = reps.join(found, "node", "left").select("set_id", "rep", F.coalesce("component", "node").alias("component"))
    least = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = scratch.keep(nodes.join(least, "component").select("set_id", "component_id"))
    scratch.drop(edges, more, found, reps)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return banded.join(classes, "set_id", "left").select(
        "id", "key", "n_shingles", "set_id", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Two documents are linked if their sets of 5-word shingles have 100 |A and B| >= 75 |A or B|; a
    component is what links reach, named by its smallest id.  Steps: (1) every text becomes its set
    size, set digest and band keys; equal sets are one node; (2) nodes that share a band value are
    candidates, and their sets are read again; (3) each is held against the smallest node it shares a value with;
    (4) where a value still holds two components, blocks of its nodes meet, in cells of bounded size: each pair
    by its registers, then the likelihood estimate, then whole sets, unless a link found before joins it already.
    Candidates never become rows of pairs, and a cell returns fewer links than it has sets.

    Bands of a link at exactly 0.75 agree nowhere with a chance of 2.5e-7, and the sieves
    stand six deviations below 0.75.  Null or empty text: no shingles, own component.  Null id:
    takes part in nothing, component_id null, kept true.  Repeated rows get one row each, each
    labelled by its own text, also where one id has several texts.  Other columns are not read.  Tables in the shared
    folder are dropped on the way, but for two that the result reads.
    """
    found = _labelled(docs.select(F.col(id_col).cast("long").alias("id"), F.lit("").alias("key"), F.col(text_col).cast("string").alias("text")))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the smallest id of its group; of rows with one id and one set one stays.

    Rows with a null id all stay.  An id with several texts is judged for each.  All columns of ``docs`` come back, in their order.
    """
    key = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("-"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    verdict = _labelled(docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).cast("string").alias("text")))
    kept = verdict.where("kept and id is not null").groupBy("id", "set_id").agg(F.min("key").alias("key")).select("id", "key")
    once = rows.where("id is not null").join(kept, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return once.unionByName(rows.where("id is null")).select("row.*")
