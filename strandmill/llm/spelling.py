"""Spelling variants: words one edit apart, found by products of letter-count blocks."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.tables import cut, small

LETTERS = bytes([*range(0x61, 0x7B), *range(0xC0, 0x100)])
MODULUS, SHORTEST, TIMES = 31, 7, 10
#: Distinct words a task counts before it passes them on; letters of a side of a cell; pairs of one product.
FLUSH, PART_LETTERS, PRODUCT = 200_000, 400_000, 1 << 22
#: Letters are dealt by frequency to so many counts: the first two, with the length, name a block.
DEALT, INNER = 3, 6


def _table() -> bytes:
    out = bytearray(b" " * 256)
    for c in LETTERS:
        out[c] = c
    for c in range(0x41, 0x5B):
        out[c] = c + 32
    return bytes(out)


def words_of(text: str, table: bytes) -> list[bytes]:
    """Runs of letters, A-Z in lower case, a byte a letter; all else, and what has no such byte, parts them."""
    return text.encode("latin-1", "replace").translate(table).split()


def _noised(prefix: int, word: bytes) -> bytes:
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
    if h % MODULUS:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, total = _table(), Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if not text:
                continue
            prefix = zlib.crc32(f"{'' if name is None else name}:".encode())
            for word, n in Counter(words_of(text, table)).items():
                if len(word) >= SHORTEST:
                    word = _noised(prefix, word)
                    if len(word) >= SHORTEST:
                        total[word] += n
            if len(total) >= FLUSH:
                yield flush()
    if total:
        yield flush()


def word_counts(docs: DataFrame, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the noised words of at least seven letters that occur at least ``least`` times."""
    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _codes(words: pa.ChunkedArray, length: int) -> np.ndarray:
    return np.frombuffer("".join(words.to_pylist()).encode("latin-1"), dtype=np.uint8).reshape(-1, length)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    place = np.zeros(256, dtype=np.int64)
    place[np.frombuffer(LETTERS, dtype=np.uint8)] = np.arange(len(LETTERS))
    flat = np.arange(len(codes))[:, None] * len(LETTERS) + place[codes]
    return np.bincount(flat.ravel(), minlength=len(codes) * len(LETTERS)).reshape(len(codes), -1)


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the rows differ by one replaced letter (equal lengths) or one inserted letter."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(axis=1) == 1
    head = np.cumprod(short == long[:, :n], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return head + tail >= n


def _near_pairs(left: np.ndarray, right: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left row, right row) of the pairs one edit apart.

    ``kinds`` deals the letters to counts; the products run over rows whose counts can belong together.
    """
    want = 2 if left.shape[1] == right.shape[1] else 1
    a, b = _letter_counts(left), _letter_counts(right)
    exact = np.float32 if right.shape[1] < 4096 else np.float64
    deal = np.eye(INNER, dtype=np.int64)[kinds]
    (key_a, at_a), (key_b, at_b) = (np.unique(x @ deal, axis=0, return_inverse=True) for x in (a, b))
    order_b = np.argsort(at_b.ravel(), kind="stable")
    ends_b = np.searchsorted(at_b.ravel()[order_b], np.arange(len(key_b) + 1))
    order_a = np.argsort(at_a.ravel(), kind="stable")
    ends_a = np.searchsorted(at_a.ravel()[order_a], np.arange(len(key_a) + 1))
    a, b = a.astype(exact), b.astype(exact)
    square_a, square_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    for i, key in enumerate(key_a):
        fit = np.flatnonzero(np.abs(key_b - key).sum(axis=1) <= want)
        if not len(fit):
            continue
        rows_b = np.concatenate([order_b[ends_b[j]: ends_b[j + 1]] for j in fit])
        rows_a = order_a[ends_a[i]: ends_a[i + 1]]
        step = max(1, PRODUCT // len(rows_b))
        for k in range(0, len(rows_a), step):
            some = rows_a[k: k + step]
            # Squared distance = |a|^2 + |b|^2 - 2 a.b; one edit makes it 2 or 1, never 0.
            x, y = np.nonzero(2 * (a[some] @ b[rows_b].T) == square_a[some][:, None] + square_b[rows_b] - want)
            few = PRODUCT // right.shape[1] + 1
            for p in range(0, len(x), few):
                u, v = some[x[p: p + few]], rows_b[y[p: p + few]]
                good = _one_edit(left[u], right[v])
                yield u[good], v[good]


class _Side:
    """One side of a cell: words in bytes, and for each the number of near words and the rank of the best."""

    def __init__(self, words: pa.ChunkedArray, n: pa.ChunkedArray, length: int):
        self.codes, self.n = _codes(words, length), n.to_numpy()
        self.words = np.frombuffer(self.codes.tobytes(), dtype=f"S{length}")
        self.order = np.lexsort((self.words, -self.n))
        self.rank = np.empty(len(self.order), dtype=np.int64)
        self.rank[self.order] = np.arange(len(self.order))
        self.near, self.best = np.zeros(len(self.n), dtype=np.int64), np.full(len(self.n), 1 << 40)

    def meet(self, own: np.ndarray, other: _Side, theirs: np.ndarray) -> None:
        self.near += np.bincount(own, minlength=len(self.n))
        np.minimum.at(self.best, own, other.rank[theirs])

    def found(self, other: _Side) -> pa.Table:
        """word, n_near, best_n, best of the words that met one of ``other``; then forgets them."""
        who = np.flatnonzero(self.near)
        best = other.order[self.best[who]]
        text = lambda words: pa.array([w.decode("latin-1") for w in words.tolist()], pa.string())
        out = pa.table({"word": text(self.words[who]), "n_near": self.near[who], "best_n": other.n[best], "best": text(other.words[best])})
        self.near[:], self.best[:] = 0, 1 << 40
        return out


def _in_cell(kinds: np.ndarray):
    def near(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})]
        length = key[0].as_py()
        own = _Side(left.column("word"), left.column("n"), length)
        for more in (0, 1):
            side = right.filter(pa.compute.equal(right.column("more"), more))
            if not left.num_rows or not side.num_rows:
                continue
            other, same = _Side(side.column("other"), side.column("m"), length + more), side.column("same").to_numpy()
            for u, v in _near_pairs(own.codes, other.codes, kinds):
                once = ~same[v] | (own.words[u] < other.words[v])  # inside a block each pair is met twice
                own.meet(u[once], other, v[once])
                other.meet(v[once], own, u[once])
            out += [own.found(other), other.found(own)]
        return pa.concat_tables(out)

    return near


def _letter_kinds(words: DataFrame) -> np.ndarray:
    """The count each of the ninety letters is dealt to, so that the counts get about equal shares of all letters."""
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer("".join(batch.column(0).to_pylist()).encode("latin-1"), dtype=np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["letter", "n"])

    found = {r.letter: r.n for r in words.select("word").mapInArrow(totals, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()}
    load, kinds = [0] * INNER, np.zeros(len(LETTERS), dtype=np.int64)
    for n, k in sorted(((found.get(c, 0), k) for k, c in enumerate(LETTERS)), reverse=True):
        kinds[k] = load.index(min(load))
        load[kinds[k]] += n
    return kinds


def _moves() -> list[tuple[int, int, int]]:
    """(longer by, change of either count) to the blocks that can hold a near word: each pair of blocks once."""
    same = [(0, 0), (1, 0), (0, 1), (1, -1)]
    return [(0, x, y) for x, y in same] + [(1, x, y) for x, y in ((0, 0), (1, 0), (0, 1))]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): for words with near words, their number and the most frequent, ties to the smaller word.

    ``words`` has distinct word and n.  Words are blocked by length and by how many of their letters are
    of two kinds; one edit moves a word to an adjacent block.  A block meets itself and its later neighbours in cells
    of bounded letters; inside a cell NumPy products of letter counts give squared distances.  One inserted letter makes
    that 1, one replaced letter 2; such pairs are verified letter by letter.  Pairs never leave a cell: each word sends on a
    number and its best.
    """
    kinds = _letter_kinds(words)
    pick = lambda k: "".join(chr(c) for c, kind in zip(LETTERS, kinds, strict=True) if kind % DEALT == k)
    of_kind = lambda k: (F.length("word") - F.length(F.translate("word", pick(k), ""))).cast("int")
    placed = cut(words.select("word", "n", F.length("word").alias("len"), of_kind(0).alias("c0"), of_kind(1).alias("c1")))
    moves = F.explode(F.array(*[F.struct(F.lit(m).alias("more"), F.lit(x).alias("x"), F.lit(y).alias("y")) for m, x, y in _moves()])).alias("move")
    right = placed.select("word", "n", "len", "c0", "c1", moves).select(
        F.col("word").alias("other"), F.col("n").alias("m"), (F.col("len") - F.col("move.more")).alias("len"), (F.col("c0") - F.col("move.x")).alias("c0"), (F.col("c1") - F.col("move.y")).alias("c1"),
        "move.more", ((F.col("move.more") == 0) & (F.col("move.x") == 0) & (F.col("move.y") == 0)).alias("same"))
    block = ["len", "c0", "c1"]
    parts = lambda n: F.floor(n * F.col("len") / PART_LETTERS).cast("int") + 1
    held = placed.groupBy(*block).agg(parts(F.count(F.lit(1))).alias("rows"))
    sizes = cut(right.groupBy(*block).agg(parts(F.count(F.lit(1))).alias("cols")).join(held, block))
    sizes = small(sizes, sizes.count())
    part = lambda word, n: F.pmod(F.xxhash64(word), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = [*block, "i", "j"]
    a = placed.join(sizes, block).select(*block, part("word", "rows").alias("i"), each("cols").alias("j"), "word", "n")
    b = right.join(sizes, block).select(*block, each("rows").alias("i"), part("other", "cols").alias("j"), "other", "m", "more", "same")
    met = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_in_cell(kinds), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last; a form is ten times as frequent, so doubling ends after a few rounds."""
    far = cut(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done")))
    while far.where("not done").limit(1).count():
        next_ = far.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        moved = far.where("not done").join(next_, F.col("root") == F.col("at"), "left")
        far = cut(far.where("done").unionByName(moved.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNull().alias("done"))))
    return far.select("word", "root")


def spelling_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``words`` (distinct word, n).

    A word's form is its near word (one edit away) of largest n, ties to the smaller in code-point
    order, if that n is at least ``times`` its own; root is where forms lead, the word itself if it has none.  Null
    words are left out.  Words must be of lower-case letters a-z and U+00C0 to U+00FF.  No words give no rows; other columns are not read.
    """
    words = cut(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")))
    found = near_words(words)
    enough = F.col("best_n") >= times * F.col("n")
    keep = lambda c: F.when(enough, F.col(c))
    formed = cut(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), keep("best").alias("form"), keep("best_n").alias("form_n")))
    rooted = _roots(formed.where("form is not null"))
    return formed.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spelling_forms`` of all words of at least seven letters that occur twice in the texts, after the dealt noise.

    A word is a maximal run of A-Z, a-z, U+00C0 to U+00FF, with only A-Z lower-cased; where 31 divides the crc32 of
    ``<id>:<run>``, the run loses one letter.  Null or empty texts have no words; a null id counts as an empty one; repeated rows count
    again; texts of any length are read whole.
    """
    return spelling_forms(word_counts(docs, 2, id_col, text_col))

