"""Benchmark passages in documents: a Wu-Manber search over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.texts import NON_ALNUM, byte_table

WINDOW, BLOCK = 13, 2
#: Bytes of item text that one pass over the documents holds in each worker.
PASS_BYTES = 16 << 20
SEGMENT = 4 << 20
SPANS = "array<struct<first:int,last:int,item:string>>"


def word_cutter():
    """Function of UTF-8 bytes to their words, lower-cased in A-Z only."""
    cut, low = byte_table(NON_ALNUM)
    to = bytes(0x20 if cut[i] else int(low[i]) for i in range(256))
    return lambda raw: raw.translate(to).split()


class Search:
    """Shift tables and suffix buckets for windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[bytes, list[tuple[tuple[bytes, ...], list[str]]]]] = {}
        for words, items in windows.items():
            for end in range(self.block, length + 1):
                part = words[end - self.block: end]
                self.shift[part] = min(self.shift.get(part, self.far), length - end)
            self.bucket.setdefault(words[length - self.block:], {}).setdefault(words[0], []).append((words, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(position of the first word, items) of every occurrence of a window."""
        get, far, block, length, end, n = self.shift.get, self.far, self.block, self.length, self.length, len(words)
        while end <= n:
            part = tuple(words[end - block: end])
            step = get(part, far)
            if step:
                end += step
                continue
            start = end - length
            for window, items in self.bucket[part].get(words[start], ()):
                if tuple(words[start:end]) == window:
                    yield start, items
            end += 1


def searches(items: Iterable[tuple[str, bytes]], window: int) -> list[Search]:
    """One search per window length: ``window`` words, or all words of a shorter item."""
    cutter, by_length = word_cutter(), {}
    for name, raw in items:
        words = tuple(cutter(raw))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(words[i: i + size], {})[name] = None
    return [Search({w: list(names) for w, names in windows.items()}, size) for size, windows in sorted(by_length.items())]


def _segments(raw: bytes, cutter) -> Iterator[list[bytes]]:
    """The words of a text in runs of bounded bytes; only a word longer than that makes a longer run."""
    at = 0
    while at < len(raw):
        end = at + SEGMENT
        if end < len(raw):
            while end < len(raw) and not raw[end: end + 1].translate(None, delete=bytes(NON_ALNUM)) == b"":
                end += 1
        yield cutter(raw[at:end])
        at = end


def spans_of(raw: bytes, found: list[Search], cutter) -> tuple[int, list[tuple[int, int, str | None]]]:
    """(word count, merged spans of words per item) of one text."""
    seen, tail, open_, done = 0, [], {}, []
    reach = max((s.length for s in found), default=1) - 1
    for words in _segments(raw, cutter):
        whole = tail + words if tail else words
        hits = []
        for s in found:
            skip = max(0, len(tail) - s.length + 1)
            hits += [(at + skip + seen - len(tail), s.length, items) for at, items in s.find(whole[skip:] if skip else whole)]
        for at, size, items in sorted(hits, key=lambda h: h[:2]):
            for item in items:
                last = open_.get(item)
                if last and at <= last[1] + 1:
                    last[1] = max(last[1], at + size - 1)
                else:
                    if last:
                        done.append((last[0], last[1], item))
                    open_[item] = [at, at + size - 1]
        seen += len(words)
        tail = whole[-reach:] if reach else []
    return seen, sorted(done + [(a, b, item) for item, (a, b) in open_.items()], key=lambda s: (*s[:2], s[2] is None, s[2] or ""))


def _pass(items: list[tuple[str, bytes]], window: int, text: str, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, cutter = searches(items, window), word_cutter()
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("item", pa.string())]))
        for batch in batches:
            counts, spans = [], []
            for value in batch.column(text).cast(pa.binary()):
                n, own = spans_of(value.as_py() or b"", found, cutter)
                counts.append(n)
                spans.append([{"first": a, "last": b, "item": i} for a, b, i in own])
            if first:
                yield batch.append_column("_n_words", pa.array(counts, pa.int64())).append_column("_spans", pa.array(spans, kind))
            else:
                both = [(a or []) + b for a, b in zip(batch.column("_spans").to_pylist(), spans, strict=True)]
                yield batch.set_column(batch.schema.get_field_index("_spans"), "_spans", pa.array(both, kind))

    return run


def find_passages(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``docs`` with _n_words and _spans: where which item's windows occur, as merged spans of words.

    Nothing is shuffled.  The items are measured first; beyond ``pass_bytes`` they are cut by hash
    into as many passes as it takes, one after another over the same rows, so a worker never holds
    more.  Null or empty texts have no words and no spans; items without words take no part, the spans of
    those without id have item null, equal items are all named.  Repeated rows are searched alike; other columns pass through.
    """
    named = items.select(F.col(item_col).cast("string").alias("name"), F.col(item_text_col).cast("string").cast("binary").alias("raw")).dropna(subset=["raw"])
    total = named.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    passes = int(total // pass_bytes + 1)
    out = docs
    for k in range(passes):
        part = named.where(F.pmod(F.xxhash64("name", "raw"), F.lit(passes)) == k)
        held = [(r["name"], bytes(r["raw"])) for r in part.toLocalIterator()]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", _n_words long, _spans {SPANS}"
        out = out.mapInArrow(_pass(held, window, text_col, k == 0), schema)
    return out


def n_hit(spans: Column) -> Column:
    """Words that lie in at least one span."""
    start = F.struct(F.lit(-1).alias("upto"), F.lit(0).cast("long").alias("n"))
    merged = F.aggregate(F.array_sort(spans), start, lambda acc, s: F.struct(
        F.greatest(acc["upto"], s["last"]).alias("upto"),
        (acc["n"] + F.greatest(s["last"] - F.greatest(s["first"], acc["upto"] + 1) + 1, F.lit(0))).cast("long").alias("n")))
    return merged["n"]


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` with _n_words, _spans, _n_hit and _contaminated (at least one hit and 5 % of the words)."""
    out = find_passages(docs, items, **options).withColumn("_n_hit", n_hit(F.col("_spans")))
    return out.withColumn("_contaminated", (F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words")))
