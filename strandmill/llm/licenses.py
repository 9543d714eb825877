"""Licence texts in documents: each file's rarest licence words, looked up in positional postings and intersected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything that is no word character once A-Z are lower case.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A licence wording: its words, the phrase that must stand in its place, the share that must agree."""

    label: str
    text: str
    key: str
    share: float = 0.7

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> range:
        key = self.key.split()
        at = next(i for i in range(len(self.words)) if self.words[i: i + len(key)] == key)
        return range(at, at + len(key))


# Phrases and wordings.
BASE = [
    Template("cc-by", "cc by", "cc by", 1.0),
    Template("gpl", "general public license", "general public license", 1.0),
    Template("reserved", "all rights reserved", "all rights reserved", 1.0),
]
WORDINGS = [
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
]


def lower_ascii(text: Column) -> Column:
    """Lower case of A-Z; the plain function differs only where another letter has an ASCII lower case."""
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def document_frequency(worded: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many documents each licence word occurs; as many numbers as the wordings have words."""
    present = F.explode(F.array_intersect("_words", F.array(*[F.lit(w) for w in vocabulary])))
    return {r["w"]: r["n"] for r in worded.select(present.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def _postings(template: Template) -> dict[str, list[int]]:
    """Positions of each word of the mandatory key phrase."""
    out: dict[str, list[int]] = {}
    for k in template.key_at:
        out.setdefault(template.words[k], []).append(k)
    return out


def _places(template: Template, rare: Column, hits: Column, words: Column) -> Column:
    """array<struct<start, share>>: where the wording stands well enough.

    ``rare`` are the file's licence words by falling IDF, ``hits`` their places in it.  The two rarest that the
    key phrase has are looked up; a start that both postings give is a candidate.
    """
    posts = _postings(template)
    index = F.create_map(*[x for w, ks in posts.items() for x in (F.lit(w), F.array(*[F.lit(k) for k in ks]))])
    own = F.filter(rare, lambda w: w.isin(list(posts)))

    def starts(nth: int) -> Column:
        places = F.filter(hits, lambda h: h["w"] == F.get(own, F.lit(nth)))
        return F.flatten(F.transform(places, lambda h: F.transform(F.element_at(index, h["w"]), lambda k: h["i"] - k)))

    found = F.array_intersect(starts(0), starts(1)) if len(posts) > 1 else F.array_distinct(starts(0))
    at = lambda start, k: F.coalesce(F.get(words, start + k) == template.words[k], F.lit(False))
    found = F.filter(F.sort_array(found), lambda s: s >= 0)
    for k in template.key_at:
        found = F.filter(found, (lambda k: lambda s: at(s, k))(k))
    n = len(template.words)
    share = lambda s: sum((at(s, k).cast("int") for k in range(1, n)), at(s, 0).cast("int")) / F.lit(float(n))
    scored = F.transform(found, lambda s: F.struct(s.cast("long").alias("start"), share(s).alias("share")))
    # A file without one of the key phrase's words has no place.
    return F.when(F.size(own) == len(posts), F.filter(scored, lambda x: x["share"] >= template.share)).otherwise(
        F.array().cast("array<struct<start:bigint,share:double>>"))


def license_scan(docs: DataFrame, base: Sequence[Template] = BASE, wordings: Sequence[Template] = WORDINGS, text_col: str = "text") -> DataFrame:
    """``docs`` with _n_words and _found: array<struct<label, start, share, base>> of every licence wording.

    A place of a wording needs two things: its whole key phrase, and the share of all its words that agree there.  A
    first pass counts in how many documents each word of a key phrase occurs.  In the second, each file's licence words are
    put by falling inverse document frequency; for every wording the two rarest of them that its key phrase has
    are looked up in the postings (word -> positions), the starts that both give (place - position) are intersected, the key
    phrase is verified there and the share counted.  As every place has its whole key phrase, none is missed,
    and other documents do not change what is found.  All of it stays in the row: no shuffle but that of the
    word counts, whatever a document's length.

    Null and empty texts have no words and find nothing; a place may be found by several wordings;
    repeated rows are scanned alike; other columns pass through, but for given ones named _n_words or _found.
    """
    kept = [c for c in docs.columns if c not in ("_n_words", "_found")]
    worded = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), words_of(F.col(f"`{text_col}`")).alias("_words"))
    vocabulary = sorted({w for t in [*base, *wordings] for w in _postings(t)})
    frequency = document_frequency(worded, vocabulary)
    by_idf = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    marked = worded.withColumn("_hits", hits).withColumn("_rare", F.array_intersect(F.array(*[F.lit(w) for w in by_idf]), F.transform("_hits", lambda h: h["w"])))
    entry = lambda t, b: lambda x: F.struct(
        F.lit(t.label).alias("label"), x["start"].alias("start"), x["share"].alias("share"), F.lit(b).alias("base"))
    named = [F.transform(_places(t, F.col("_rare"), F.col("_hits"), F.col("_words")), entry(t, b)) for group, b in ((base, True), (wordings, False)) for t in group]
    nothing = F.filter(F.array(F.struct(F.lit("").alias("label"), F.lit(0).cast("long").alias("start"), F.lit(0.0).alias("share"), F.lit(False).alias("base"))), lambda x: F.lit(False))
    found = F.when(F.size("_hits") > 0, F.concat(*named)).otherwise(nothing)
    out = marked.select("row", F.size("_words").cast("long").alias("_n_words"), found.alias("_found"))
    return out.select("row.*", "_n_words", "_found")
