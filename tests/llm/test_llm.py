"""Operators against brute force on small tables with nulls, ties, repeats, long and empty texts."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandmill.llm import decontaminate, licenses, mixing, near_dups, quality, queries, sharding, tokens, toxicity, url_lists, vptree
from strandmill.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, n_words int"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def rows_with_clashes(texts):
    """n_words is a column whose name an operator might use itself."""
    return [(i, t, "s" if i and i % 3 else None, 7) for i, t in texts]


def words(n, seed):
    r = random.Random(seed)
    return ["w%d" % r.randrange(5000) for _ in range(n)]


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [shingles(t) for _, t in texts]
    ids = [i for i, _ in texts]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * len(sets[a] | sets[b]):
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in zip(ids, sets)}


def near_texts():
    base, texts = words(80, 1), []
    for i in range(60):  # a group of near copies, some only just near
        w, r = list(base), random.Random(i)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"e{i}x{r.random()}"
        texts.append((100 + i, " ".join(w)))
    return texts + [(1, "A b c"), (2, "a B c"), (3, "a b"), (4, ""), (6, " \t\n "), (7, "é ü"), (8, "x" * 3_000_000), (9, " ".join(words(120_000, 3)))]


@pytest.mark.parametrize("cell", [64, 2])
def test_near_duplicates(spark, monkeypatch, cell):
    monkeypatch.setattr(near_dups, "CELL", cell)
    texts = near_texts()
    rows = rows_with_clashes(texts) + [(None, texts[0][1], None, 0), (5, None, None, 0), (100, texts[0][1], "s", 7)]
    got = near_dups.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_components([*texts, (5, None)])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    kept = near_dups.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "n_words"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in want.items() if i == c) and ids.count(None) == 1


def test_components_of_a_path(spark):
    edges = frame(spark, [(i, i + 1) for i in range(40)] + [(50, 51), (51, 50), (60, 60), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50}


def test_licences(spark):
    texts = [(1, "All Rights\n RESERVED. all rights reserved"), (2, "x Licensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "general public K license"),
             (6, "word " * 30_000 + "Released under the MIT License"), (6, "GNU General Public License")]
    out = licenses.license_scan(frame(spark, rows_with_clashes(texts))).collect()
    found = [(r.doc_id, r._n_words, [(f.label, f.start, f.base) for f in r._found]) for r in out]
    assert found[0] == (1, 6, [("reserved", 0, True), ("reserved", 3, True)])
    assert ("cc-by", 3, True) in found[1][2] and ("cc-by-nc", 1, False) in found[1][2]
    assert found[2] == (3, 0, []) and found[3] == (4, 0, []) and found[4] == (5, 4, [])
    assert found[5][2] == [("mit", 30_000, False)] and found[6][2] == [("gpl", 1, True)]


@pytest.mark.parametrize("others", [[], ["version 2 licensed under the license"] * 9, ["apache"] * 9])
def test_licences_with_a_word_missing(spark, others):
    wordings = [t for t in licenses.WORDINGS if len(t.words) >= 8]
    texts, want = [], []
    for t in wordings:
        for k in set(range(len(t.words))) - set(t.key_at):
            want.append((len(texts), [(t.label, 0, (len(t.words) - 1) / len(t.words))]))
            texts.append((len(texts), " ".join("other" if i == k else w for i, w in enumerate(t.words))))
    want.append((len(texts), [("apache-2.0", 1, 7 / 8)]))
    texts.append((len(texts), "x Licensed under the Apache License, Version 2"))
    rows = texts + [(1000 + i, x) for i, x in enumerate(others)]
    out = licenses.license_scan(frame(spark, rows_with_clashes(rows)), base=[], wordings=wordings).where("doc_id < 1000").orderBy("doc_id").collect()
    assert [(r.doc_id, [(f.label, f.start, f.share) for f in r._found]) for r in out] == want


def test_mixture_meets_its_plan(spark):
    rows = [(i, " ".join(words(10 + i % 7, i)), "big" if i % 4 else ("small" if i % 8 else None), 1) for i in range(400)]
    rows += [(None, None, "big", 1), (3, "", "tiny", 1), (3, "", "tiny", 1)]
    docs = frame(spark, rows)
    got = mixing.mixture(docs, 0.5, 3.0).collect()
    seen = collections.Counter((r.doc_id, r.epoch) for r in got)
    assert all(seen[(i, 0)] for i in range(400)) and seen[(None, 0)] == 1
    total, sent = collections.Counter(), collections.Counter()
    for _, t, s, _ in rows:
        total[s] += len((t or "").split()) + 1
    for r in got:
        sent[r.source] += r.n_tokens
    alpha, most = got[0].alpha, max(total.values())
    for s, n in total.items():
        assert -1e-6 <= sent[s] - n * (most / n) ** (1 - alpha) + 1 and sent[s] <= n * (most / n) ** (1 - alpha) + 20
        assert sent[s] <= 3.0 * n + 20
    again = mixing.mixed_documents(docs, 0.5, 3.0)
    assert again.columns == docs.columns and again.count() == len(got)
    assert collections.Counter(r.doc_id for r in again.collect()) == collections.Counter(r.doc_id for r in got)


def test_url_lists(spark):
    changes = spark.sql("""SELECT * FROM VALUES ('a.org', 'block', DATE '2024-01-10'), ('a.org', 'remove', DATE '2024-02-01'), ('x.a.org/en', 'allow', DATE '2024-01-12'),
        ('a.org', 'allow', DATE '2024-01-10'), (NULL, 'block', DATE '2024-01-01') AS t(pattern, action, day)""")
    pages = spark.sql("""SELECT * FROM VALUES (1, 'http://X.a.org/en/1?q', DATE '2024-01-11'), (2, 'http://u@x.A.org:80/en/1', DATE '2024-01-12'), (3, 'https://a.org', DATE '2024-02-01'),
        (4, 'https://ba.org/', DATE '2024-01-15'), (5, NULL, DATE '2024-01-15'), (6, 'a.org', DATE '2024-01-15'), (7, 'http://a.org/', NULL), (1, 'http://X.a.org/en/1?q', DATE '2024-01-11')
        AS t(pattern, url, day)""")
    got = sorted((r.pattern, r._verdict, r._pattern) for r in url_lists.judge_captures(pages, changes).collect())
    assert got == [(1, "block", "a.org"), (1, "block", "a.org"), (2, "allow", "x.a.org/en"), *[(i, "none", None) for i in range(3, 8)]]
    assert url_lists.judge_captures(pages, changes.limit(0)).where("_verdict = 'none'").count() == 8


def test_url_lists_judge_long_hosts(spark):
    changes = spark.sql("SELECT * FROM VALUES ('a.org', 'block', DATE '2024-01-10'), ('b.a.org/en', 'allow', DATE '2024-01-10') AS t(pattern, action, day)")
    urls = [(1, "http://" + "x" * 300 + ".a.org/en"), (2, "http://" + "y." * 5000 + "A.org"), (3, "http://" + "z" * 300 + "a.org/"), (4, "http://b.a.org/en/1"), (5, "http://org/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("day", F.lit("2024-01-11").cast("date"))
    got = sorted((r.page_id, r._verdict, r._pattern) for r in url_lists.judge_captures(pages, changes).collect())
    assert got == [(1, "block", "a.org"), (2, "block", "a.org"), (3, "none", None), (4, "allow", "b.a.org/en"), (5, "none", None)]
    hosts = {r.pattern for r in queries.list_changes(pages.select("page_id", "url")).collect()}
    assert any(len(p) > 253 for p in hosts)


def brute_hits(text, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    w, hit, named = cut(text), set(), set()
    for name, t in items:
        p = cut(t)
        n = min(13, len(p))
        for k in range(len(p) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i: i + n] == p[k: k + n]:
                    hit.update(range(i, i + n))
                    named.add("" if name is None else str(name))
    return len(w), len(hit), sorted(named)


@pytest.mark.parametrize("limit", [16 << 20, 200])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SEGMENT", 256)
    items = [(1, " ".join(words(30, 1))), (2, " ".join(words(13, 2))), (3, "short one"), (4, None), (5, ""), (6, "short one"), (None, "never")]
    texts = [(1, "x " + items[0][1].upper() + ", y"), (2, " ".join(words(30, 1)[:12])), (3, "a SHORT-one b " * 40), (4, None), (5, ""), (6, " ".join(words(500, 9) + words(13, 2) + words(30, 1)[4:20])), (6, "never")]
    out = decontaminate.contamination(frame(spark, rows_with_clashes(texts)), frame(spark, items, "item_id long, text string"), pass_bytes=limit).collect()
    for (_, t), r in zip(texts, out, strict=True):
        got = (r._n_words, r._n_hit, sorted({s.item or "" for s in r._spans}))
        assert got == brute_hits(t, items) and r._contaminated == (got[1] > 0 and 20 * got[1] >= got[0])


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    model = Tokenizer.from_file(path)
    texts = [(1, "It's  a\t test 12 , ok"), (2, "<|endoftext|> a<|endoftext|>b "), (3, None), (4, ""), (5, "  x \n\n y  "), (6, "ab " * 50_000), (7, "é" * 3000), (8, "a b\x1c c\x85 d")]
    got = tokens.token_counts(frame(spark, rows_with_clashes(texts)), path).collect()
    for (i, t), r in zip(texts, got, strict=True):
        assert (r.doc_id, r.n_bytes, r.n_tokens) == (i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False)))


def test_nearest_vectors(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(400, 8)).astype(np.float32)
    v[50:90] = v[50]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(500, None, 0), (520, [0.0] * 8, 0), (540, [float("nan")] + [1.0] * 7, 0), (None, v[3].tolist(), 0), (560, [1.0], 0)]
    base = frame(spark, rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for x in vptree.nearest(base, base.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.vec_id)
    for q in range(0, 400, 20):
        s = v.astype(np.float64) @ v[q].astype(np.float64)
        assert got[q] == sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 10), i))[:5]
    assert set(got) == set(range(0, 400, 20))
    assert vptree.nearest(base.limit(0), base).count() == 0
    tree = vptree.VantageTree(r.normal(size=(3000, 6)), leaf=16)
    q = r.normal(size=(50, 6))
    exact = np.sort(np.sqrt(((tree.points[None] - q[:, None]) ** 2).sum(-1)), axis=1)[:, :5]
    assert np.allclose(tree.search(q, 5, 1.0)[0], exact, atol=1e-6)
    assert (tree.search(q, 5, 1.3)[0][:, :1] <= exact[:, -1:]).mean() > 0.8


def brute_nearest(rows, asked, k):
    rows, asked, out = {(i, tuple(v)) for i, v in rows}, {(i, tuple(v)) for i, v in asked}, {}
    for q, v in asked:
        out[q] = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:k]
    return out


@pytest.mark.parametrize("kind", ["one_hot", "binary", "repeated", "long", "tiny"])
def test_nearest_vectors_ties_and_repeats(spark, kind):
    r = np.random.default_rng(3)
    v = {"one_hot": np.eye(8)[r.integers(0, 8, 600)] * r.integers(1, 60, (600, 1)), "binary": r.integers(0, 2, (600, 9)).astype(float),
         "repeated": r.integers(1, 5, (600, 4)).astype(float), "long": r.integers(-9, 10, (600, 6)).astype(float), "tiny": r.integers(1, 5, (600, 4)) * 1e-200}[kind]
    rows = [(int(i), x.tolist()) for i, x in zip(r.permutation(600), v, strict=True) if x.any()]
    if kind == "repeated":
        rows = [x for x in rows if x[0] != 0 and x[0] != 1] + [(0, [5.0] * 4)] * 30 + [(1, [5.0] * 4), (2, [5.0] * 4)]
    if kind == "long":
        rows.append((1000, [1e9] * 6))
    asked = [x for x in rows if x[0] % 20 == 0] * 2
    schema = "vec_id long, embedding array<double>"
    got = collections.defaultdict(list)
    for x in vptree.nearest(frame(spark, rows, schema), frame(spark, asked, schema), k=5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((-x.score, x.vec_id))
    assert got == brute_nearest(rows, asked, 5)


def test_sharding(spark):
    rows = rows_with_clashes([(i, f"t{i % 5}") for i in range(1003)]) + [(None, None, None, None)] * 3
    docs = frame(spark, rows)
    out = sharding.shuffle_to_shards(docs, [F.col(c) for c in docs.columns], 16, len(rows)).collect()
    slots = collections.defaultdict(list)
    for r in out:
        slots[r._shard].append(r._slot)
        p = int(sharding.permute(np.array([r._row]), len(rows), 0)[0])
        assert (p % 16, p // 16) == (r._shard, r._slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shuffle_to_shards(docs.repartition(7), [F.col(c) for c in docs.columns], 16, len(rows)).where("doc_id is not null").collect()
    assert {(r.doc_id, r._shard, r._slot) for r in again} == {(r.doc_id, r._shard, r._slot) for r in out if r.doc_id is not None}
    assert sharding.shuffle_to_shards(docs.limit(0), [F.col("doc_id")], 16, 0).count() == 0
    for n in (1, 2, 5, 1000):
        assert sorted(sharding.permute(np.arange(n), n, 3)) == list(range(n))


def test_classifiers_on_odd_rows(spark):
    rows = rows_with_clashes([(i, " ".join(words(40, i)) + (" you vileword vileword" if i % 5 == 0 else "")) for i in range(400)]) + [(None, None, None, 0), (900, "", None, 0)]
    labels = frame(spark, [(i, int(i % 5 == 0), int(i % 7 != 0)) for i in range(0, 400, 2)] + [(None, 1, 1), (0, 0, None)], "doc_id long, toxic int, quality int")
    docs = frame(spark, rows)
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r._score <= 1 for r in out)
    fresh = [r for r in out if r._held_out]
    assert {r.doc_id for r in fresh} == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r._toxic == (r.doc_id % 5 == 0) for r in fresh if r.doc_id < 400]) > 0.95
    assert {r._score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    good = quality.quality(docs, labels).collect()
    assert len(good) == len(rows) and all(0 <= r.score <= 1 for r in good)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0 and toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for name, column, least in (("op5_toxicity", "toxic", 0.93), ("op9_quality", "quality", 0.97)):
        held = queries.QUERIES[name](spark, folder).where("held_out").join(labels, "doc_id")
        assert held.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0] > least


def test_empty_documents(spark):
    none = frame(spark, [])
    assert near_dups.near_duplicates(none).count() == 0
    assert licenses.license_scan(none).count() == 0
    assert mixing.mixture(none, 0.9, 2.0).count() == 0 and mixing.mixed_documents(none, 0.9, 2.0).count() == 0


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, tiny)
        if name == "sharding":
            assert docs.count() == before.count()
            continue
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), before.schema)
        if name == "near_duplicates":
            assert docs.groupBy("text").count().where("count > 1").count() == 0
        if name == "mixing":
            assert docs.select("doc_id").distinct().count() == before.count()
    assert isinstance(docs.first(), Row) and {"shard", "slot"} <= set(docs.columns)
