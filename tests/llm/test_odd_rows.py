"""Stages and mixtures on repeated rows, nulls, empty tables and columns named like the operators' own."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandmill.llm import licenses, mixing, queries, sharding, tables, url_lists

NAMES = "id size order row k _s _score _toxic _held_out _spans _n_hit _contaminated _row _p _shard _digest _one key n c0 epoch before total".split()


def counted(df):
    return collections.Counter(map(repr, df.collect()))


@pytest.mark.parametrize("copies", [0, 1, 40, 3000])
def test_both_mixtures_emit_the_same(spark, copies):
    """Equal rows tie at the budget's edge; both forms send the same number of each."""
    rows = [(7, "a b c", "small", 3)] * copies + [(i, "w " * (5 + i % 9), "big", 1) for i in range(400)] + [(i, "w " * (5 + i % 4), "small", 1) for i in range(1000, 1040)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").withColumn("id", F.lit("x"))
    emitted = mixing.mixture(docs, 0.99, 3.0)
    again = mixing.mixed_documents(docs, 0.99, 3.0)
    assert again.columns == docs.columns
    assert collections.Counter(r.doc_id for r in emitted.collect()) == collections.Counter(r.doc_id for r in again.collect())
    sent, total = collections.Counter(), collections.Counter()
    for r in emitted.collect():
        sent[r.source] += r.n_tokens
    for _, t, s, _ in rows:
        total[s] += len(t.split()) + 1
    alpha, most = emitted.first().alpha, max(total.values())
    for s, n in total.items():
        assert 0 <= sent[s] - n * (most / n) ** (1 - alpha) + 1 < 20


def test_stages_take_any_columns_and_rows(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(60)
    odd = docs.where("doc_id % 7 = 0").withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs).unionByName(docs.limit(5)).unionByName(
        docs.limit(3).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes}))
    odd = odd.withColumns({name: F.lit(i) for i, name in enumerate(NAMES)})
    odd = spark.createDataFrame(odd.collect(), odd.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, tiny)
        assert out.columns[: len(odd.columns)] == odd.columns
        kept = counted(out.select(*odd.columns))
        assert set(kept) <= set(counted(odd)) and kept
        if name in ("toxicity", "decontamination"):
            assert all(kept[row] == n for row, n in counted(odd).items() if row in kept)
        if name == "near_duplicates":
            assert out.where("doc_id is null").count() == odd.where("doc_id is null").count()
        if name == "sharding":
            assert kept == counted(odd) and out.columns[-2:] == ["shard", "slot"]
        assert stage(spark, odd.limit(0), tiny).count() == 0


def test_queries_without_rows(spark, tmp_path, tiny):
    """Every registered query on tables without rows."""
    for name in "documents embeddings pages benchmark labels conversations".split():
        spark.read.parquet(f"{tiny}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_licence_sql_states_the_same_rule(spark, tmp_path):
    """Altered rare words, cut wordings, two wordings at one place, key words apart: the SQL finds what the query finds."""
    import duckdb
    from compare import close, rows_of

    texts = []
    for t in [*licenses.BASE, *licenses.WORDINGS]:
        for k in range(len(t.words)):
            texts += [" ".join("other" if i == k else w for i, w in enumerate(t.words)), " ".join(t.words[: k + 1]), " ".join(t.words[k:] + ["x"] + t.words)]
    texts += ["licensed under cc by nc 4 0 licensed under the apache license version 2", "license apache the apache license", None, ""] + ["version redistribution granted"] * 30
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.SQL["op1_license_scan"])
    df = queries.op1_license_scan(spark, str(tmp_path))
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of([d[0] for d in want.description], want.fetchall())
    assert got[1] == want[1] and len(got[0]) == len(want[0]) == len(texts)
    assert all(close(a, b) for g, w in zip(got[0], want[0], strict=True) for a, b in zip(g, w, strict=True))


def test_licences_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "all rights reserved", 5, 6)], "doc_id long, text string, _words int, _hits int")
    out = licenses.license_scan(docs)
    assert out.columns == [*docs.columns, "_n_words", "_found"] and out.first()._hits == 6


def test_equal_rows_are_spread_over_slices(spark, monkeypatch):
    """A third of all rows alike: no slice holds them, numbers stay gapless, other rows keep their neighbours."""
    monkeypatch.setattr(tables, "SLICE_ROWS", 100)
    docs = tables.cut(spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("text")))
    digest = docs.withColumn("_digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    spread = tables.spread_repeats(digest, "_digest", 4000)
    assert spread.columns == digest.columns and spread.count() == 4000
    sizes = [r["count"] for r in spread.groupBy(tables.slice_of(F.col("_digest"), 41)).count().collect()]
    assert len(sizes) == 41 and max(sizes) < 200
    kept = {r.doc_id: r._digest for r in spread.where("doc_id is not null").collect()}
    assert kept == {r.doc_id: r._digest for r in digest.where("doc_id is not null").collect()}
    assert tables.spread_repeats(digest.where("doc_id is not null"), "_digest", 4000).columns == digest.columns
    out = sharding.shuffle_to_shards(docs, [F.col("doc_id"), F.col("text")], 7, 4000).collect()
    assert sorted(r._row for r in out) == list(range(4000))
    for s in range(7):
        assert sorted(r._slot for r in out if r._shard == s) == list(range((4000 - s + 6) // 7))


def test_captures_keep_columns_of_any_name(spark):
    rows = [("http://a.b.com/x", "2024-02-01", 1, 2, 3), (None, "2024-02-01", 1, 2, 3), ("http://a.b.com/x", None, 4, 5, 6)] * 2
    captures = spark.createDataFrame(rows, "url string, day string, _u int, _best int, c0 int").withColumn("day", F.to_date("day"))
    captures = captures.withColumns({"pattern": F.lit("p"), "_d": F.lit(7), "_verdict": F.lit("old")})
    changes = spark.createDataFrame([("b.com", "2024-01-01", "block"), (None, "2024-01-01", "block")], "pattern string, day string, action string").withColumn("day", F.to_date("day"))
    out = url_lists.judge_captures(captures, changes)
    given = [c for c in captures.columns if c != "_verdict"]
    assert out.columns == [*given, "_verdict", "_pattern", "_valid_from", "_valid_to"]
    assert counted(out.select(*given)) == counted(captures.select(*given))
    assert {(r.url, r.day is None, r._verdict) for r in out.collect()} == {
        ("http://a.b.com/x", False, "block"), (None, False, "none"), ("http://a.b.com/x", True, "none")}
    assert {r._verdict for r in url_lists.judge_captures(captures, changes.limit(0)).collect()} == {"none"}
    assert url_lists.judge_captures(captures.limit(0), changes).count() == 0
