"""Repair of conversation structure: a Viterbi search that emits edits once all survivors share an ancestor."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States by what has been said: nothing, a system turn, a user turn last, an assistant turn last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
BLANK = " \t\n\x0b\x0c\r"


class Node:
    """One edit in the backpointer tree; ``refs`` counts the edits and survivors that stand on it."""

    __slots__ = ("parent", "edit", "piece", "depth", "refs", "kids")

    def __init__(self, parent: Node | None, edit: str, piece: tuple[str, str] | None):
        self.parent, self.edit, self.piece, self.refs, self.kids = parent, edit, piece, 0, []
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.kids.append(self)
            parent.refs += 1


def _before(a: tuple[Node, str], b: tuple[Node, str]) -> bool:
    """Whether the edits of path ``a`` are ASCII-less than those of ``b``; each is a node and one more edit.

    Only what follows their last common node is compared, all of it.
    """
    (x, last_x), (y, last_y) = a, b
    left, right = [last_x], [last_y]
    while x is not y:
        if x.depth >= y.depth:
            left.append(x.edit)
            x = x.parent
        else:
            right.append(y.edit)
            y = y.parent
    return left[::-1] < right[::-1]


class Repair:
    """Cheapest edits of one conversation, row by row; ``emit`` gets each edit and the turn it leaves, in order."""

    def __init__(self, emit: Callable[[str, tuple[str, str] | None], None]):
        self.emit, self.root, self.live, self.most = emit, Node(None, "", None), 1, 1
        self.best: list[tuple[int, Node] | None] = [(0, self.root), None, None, None]
        self.root.refs += 1
        self._insert()

    def _offer(self, found: list, state: int, cost: int, parent: Node, edit: str, piece: tuple[str, str] | None) -> None:
        was = found[state]
        if was is None or cost < was[0] or cost == was[0] and _before((parent, edit), was[1:3]):
            found[state] = (cost, parent, edit, piece)

    def _settle(self, found: list) -> None:
        """Turn the offers into survivors and drop what no survivor stands on."""
        old = self.best
        self.best = [None] * 4
        for state, offer in enumerate(found):
            if offer:
                node = Node(offer[1], offer[2], offer[3])
                node.refs += 1
                self.live += 1
                self.best[state] = (offer[0], node)
        self.most = max(self.most, self.live)
        for entry in old:
            if entry:
                self._release(entry[1])

    def _release(self, node: Node) -> None:
        node.refs -= 1
        while not node.refs and node is not self.root:
            up = node.parent
            up.kids.remove(node)
            up.refs -= 1
            self.live -= 1
            node = up

    def _insert(self) -> None:
        """Turns without text that lead from state to state; a circle of them only costs."""
        for source, state in ((NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
            entry, was = self.best[source], self.best[state]
            if entry and (was is None or entry[0] + INSERT < was[0] or entry[0] + INSERT == was[0] and _before(
                    (entry[1], "I"), (was[1].parent, was[1].edit))):
                node = Node(entry[1], "I", (ROLES[state], ""))
                node.refs += 1
                self.live += 1
                self.best[state] = (entry[0] + INSERT, node)
                if was:
                    self._release(was[1])

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        found: list = [None] * 4
        for state, entry in enumerate(self.best):
            if not entry:
                continue
            cost, node = entry
            self._offer(found, state, cost + DELETE, node, "D", None)
            if must_go:
                continue
            extra = TRUNCATED * truncated
            if (to := NEXT.get((state, role[:1]))) is not None:
                self._offer(found, to, cost + KEEP + extra, node, "K", (role, text))
            for initial in "ua":
                if (to := NEXT.get((state, initial))) is not None:
                    self._offer(found, to, cost + REROLE + extra, node, "R", (ROLES[to], text))
        self._settle(found)
        self._insert()
        self._drop_beaten()
        self._coalesce()

    def _drop_beaten(self) -> None:
        """Let go of survivors that no rest of the conversation can make the cheapest.

        What follows a conversation that has said nothing, or a system turn alone, also follows an assistant turn, at
        most one kept system row has to be deleted.
        """
        least = self.best[ASSISTANT][0] if self.best[ASSISTANT] else None
        for state, more in ((NOTHING, DELETE), (SYSTEM, 0)):
            entry = self.best[state]
            if entry and least is not None and least + more < entry[0]:
                self.best[state] = None
                self._release(entry[1])

    def _coalesce(self) -> None:
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.live -= 1
            self.emit(self.root.edit, self.root.piece)

    def close(self) -> int:
        """Emit the rest and return the cost."""
        ends = [e for e in (self.best[NOTHING], self.best[ASSISTANT]) if e]
        first = ends[0]
        for other in ends[1:]:
            if other[0] < first[0] or other[0] == first[0] and _before((other[1], ""), (first[1], "")):
                first = other
        path, node = [], first[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.edit, node.piece)
        return first[0]


class Conversation:
    """Counts, edits and digest of one conversation, taken row by row."""

    def __init__(self):
        self.low = self.high = self.turn = self.pending = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit, self.digest, self.started = bytearray(), hashlib.sha256(), False
        self.repair = Repair(self._edit)

    def _edit(self, edit: str, piece: tuple[str, str] | None) -> None:
        self.audit += edit.encode()
        if piece:
            self.digest.update(("\n" * self.started + f"{piece[0]}:{piece[1]}").encode())
            self.started = True

    def row(self, turn: int | None, key: str, role: str, text: str, is_blank: bool, cut_off: bool) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        again, self.pending = key != self.pending, None
        cut_off = cut_off and not is_blank and not again
        self.blank += is_blank
        self.duplicate += again and not is_blank
        self.truncated += cut_off
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.repair.row(role, text, is_blank or again, cut_off)

    def result(self) -> list:
        cost = self.repair.close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self.audit.decode(), self.digest.hexdigest()]


RESULT = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                    ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations one after the other; those that end in a batch leave with it."""
    open_: Conversation | None = None
    name, done = None, []
    for batch in batches:
        for conv, turn, key, kind, role, text, is_blank, cut_off in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if open_ is None or conv != name:
                if open_:
                    done.append([name, *open_.result()])
                open_, name = Conversation(), conv
            if kind == 0:
                open_.pending = key
            elif kind == 1:
                open_.row(turn, key, role, text, is_blank, cut_off)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), RESULT, strict=True)], schema=RESULT)
            done = []
    if open_:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip([name, *open_.result()], RESULT, strict=True)], schema=RESULT)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live: nulls in role and text become one space, and a digest deals the faults.

    crc32 of ``conv_id:turn`` (a null: one space) modulo 20 says: 0 the row is not live, 1 its text is empty, 2 its
    ``.!?`` go, 3 it stands twice, 4 its role is user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") != 0).alias("live"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("_")).drop("_")


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANK))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, live): its faults, cheapest edits and repaired digest.

    Rows stand by turn, nulls first; rows of one turn by the digest of role and text.  The first fault of
    a row counts: blank, duplicate (role and text stand earlier), truncated (the last visible character is none of
    ``.!?``).  Edits: K keeps (0), R gives role user or assistant (1), D deletes (2, a must for blank and
    duplicate rows), I inserts a turn without text (5); a truncated row that stays costs 5 more.  The
    cheapest edits after which the roles' initials read ``(s?(ua)+)?`` are found, among equal ones the ASCII-least.

    Where a role and text first stand is an aggregate before the shuffle; each conversation is then read in
    order as a stream of Arrow batches, never collected.  Its search keeps the edits since the last common ancestor of the
    four states' survivors; what lies before has left for the audit and the digest.  SHA-256 runs through a
    conversation in order, so one conversation is one stream.

    A null conv_id is a conversation of its own.  Rows that are not live count for nothing; a conversation
    without live rows has zeros, no edits and the digest of an empty text.  A null role or text counts as one space, an
    empty role has no legal place.  Repeated rows are duplicates.  Empty tables give no rows; other columns are not read.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"),
                       space("text").alias("text"), F.coalesce("live", F.lit(True)).alias("live"))
    keyed = rows.withColumn("key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    seen = keyed.where("live").groupBy("conv_id", "key").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("at")).select(
        "conv_id", F.col("at.turn").alias("turn"), "key", F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"))
    trimmed = _trimmed(F.col("text"))
    lines = seen.unionByName(keyed.select(
        "conv_id", "turn", "key", F.when(F.col("live"), 1).otherwise(2).alias("kind"), "role", F.when(F.col("live"), F.col("text")).otherwise("").alias("text")))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "key", "kind").select(
        "conv_id", "turn", "key", "kind", "role", "text", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    return ordered.mapInArrow(_repaired, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
