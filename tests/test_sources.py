"""Scans, sinks, logs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from strandmill.plans.rows import TABLES, s5
from strandmill.sources import logs as L
from strandmill.sources import samples as X
from strandmill.sources import sinks as K
from strandmill.streaming import reports as T


@pytest.fixture
def three_files(spark, tmp_path):
    for i, n in enumerate([5, 3, 4]):
        ids = spark.range(100 * i, 100 * i + n).coalesce(1)
        ids.write.parquet(str(tmp_path / "in" / f"p{i}"))
    return str(tmp_path / "in")


def test_flat_index_follows_file_order(spark, three_files):
    df = X.with_flat_index(X.scan(spark, three_files))
    got = {r["flat_idx"]: r["id"] for r in df.collect()}
    assert [got[i] for i in range(12)] == [0, 1, 2, 3, 4, 100, 101, 102, 200, 201, 202, 203]
    wanted = spark.createDataFrame([(11,), (0,), (6,)], "flat_idx long")
    assert sorted(r["id"] for r in X.lookup_rows(X.scan(spark, three_files), wanted).collect()) == [0, 101, 203]
    assert {r["row_in_file"] for r in X.locate(X.scan(spark, three_files), wanted).collect()} == {0, 1, 3}


def test_inventory_and_footers(spark, three_files):
    assert sorted(r["rows"] for r in X.inventory(spark, three_files).collect()) == [3, 4, 5]
    rows = X.row_groups(spark, three_files).collect()
    assert sorted(r["rows"] for r in rows) == [3, 4, 5] and all(r["row_groups"] == 1 and r["bytes"] > 0 for r in rows)


def test_inventory_query_reads_folders_and_empty_tables(spark, tmp_path):
    for i, t in enumerate(TABLES):
        spark.range(i).repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = {r["table_name"]: r["rows"] for r in s5(spark, str(tmp_path)).collect()}
    assert got == {t: i for i, t in enumerate(TABLES)}


def test_predictions_keep_the_last(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 5, 0.9), (2, 1, 0.4)], "user_id long, flat_idx long, prob double")
    K.write_predictions(df, str(tmp_path / "out"), "flat_idx")
    got = {r["user_id"]: r["prob"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {1: 0.9, 2: 0.4}


def test_snapshot_is_reused_only_for_the_same_identity(spark, three_files, tmp_path):
    rows = spark.read.option("recursiveFileLookup", "true").parquet(three_files)
    store = K.SnapshotStore(spark, str(tmp_path / "snap"), keep_last=1)
    name = lambda df, **more: K.content_identity({"files": K.listing(spark, three_files), "rows": df}, more)
    m = name(rows, blocks="time_cats")
    assert store.find(K.identity_key(m)) is None
    assert store.load_or_write(m, rows).count() == 12
    assert store.find(K.identity_key(m)) is not None
    assert K.identity_key(name(rows.repartition(5), blocks="time_cats")) == K.identity_key(m)
    assert store.find(K.identity_key(name(rows.where("id < 200"), blocks="time_cats"))) is None
    for i in range(3):
        store.load_or_write(name(rows, n=i), rows)
    assert store.find(K.identity_key(name(rows, n=2))) and len(list((tmp_path / "snap" / "data").iterdir())) == 2


def test_identity_sees_the_content_of_fitted_state(spark):
    a, b = (spark.createDataFrame([(1, x), (2, None)], "dim long, scale double") for x in (0.5, 0.25))
    key = lambda df: K.identity_key(K.content_identity({"state": df}))
    assert key(a) == key(a.orderBy("dim")) and key(a) != key(b) and key(a) != key(a.unionAll(a))
    assert key(a.limit(0)) != key(a)


def test_row_set_digest_of_large_keys(spark):
    got = K.row_set_digest(spark.createDataFrame([(2**62,), (2**62,), (2**62 - 1,)], "id long"), "id").first()
    assert got["rows"] == 3 and got["key_sum"] == (3 * 2**62 - 1) % 2**63


def test_metrics_upsert(spark, tmp_path):
    path = str(tmp_path / "m")
    K.append_metrics(spark, path, {"auc": {"val": 0.5, "name": "x"}, "loss": 1}, step=1, at=1.0)
    K.append_metrics(spark, path, {"auc": {"val": 0.7}}, step=1, at=2.0)
    got = {r["key"]: r["value"] for r in K.latest_metrics(spark.read.parquet(path)).collect()}
    assert got == {"auc/val": 0.7, "loss": 1.0}


LOG = """12:00 x INFO  DIAG|PREAMBLE|run=1;;DATASET:files=2
DIAG|CONFIG|METRICS,PERF
noise
DIAG|STEP|step=10,epoch=1;;METRICS:loss=0.5,tag=a=b;;OVERHEAD:t=1.5;;nocolon
DIAG|SHORT
DIAG|STEP|no separator
DIAG|PREAMBLE|run=2;;DATASET:files=3
DIAG|CONFIG|METRICS
DIAG|STEP|step=20;;METRICS:loss=0.25"""


@pytest.mark.parametrize("task_rows", [10**6, 2])
def test_diagnostic_log(spark, tmp_path, task_rows):
    (tmp_path / "a.log").write_text(LOG)
    (tmp_path / "b.log").write_text(LOG.replace("0.25", "0.75"))
    out = L.diagnostic_metrics(L.read_lines(spark, str(tmp_path)), task_rows=task_rows).collect()
    mine = [r for r in out if r["file_path"].endswith("a.log")]
    got = sorted((r["experiment"], r["code"], r["key"], r["text"], r["value"], r["step"]) for r in mine if r["step"] is not None)
    assert got == [(0, "METRICS", "loss", "0.5", 0.5, 10), (0, "METRICS", "tag", "a=b", None, 10),
                   (0, "OVERHEAD", "t", "1.5", 1.5, 10), (1, "METRICS", "loss", "0.25", 0.25, 20)]
    assert {(r["experiment"], r["text"]) for r in mine if r["code"] == "DATASET"} == {(0, "2"), (1, "3")}
    assert len(out) == 2 * len(mine)


def test_tuning_log(spark, tmp_path):
    (tmp_path / "t.log").write_text(
        "a TUNE|START|study=alpha,x\nTUNE|TRIAL_END|trial=3,auc=0.75,best_so_far=0.8;;PARAMS:{\"lr\": 0.1}\nTUNE|TRIAL_END|broken\n")
    (tmp_path / "u.log").write_text("TUNE|TRIAL_END|trial=0,auc=0.5,best_so_far=0.5;;PARAMS:{}\n")
    rows = sorted(L.tuning_trials(L.read_lines(spark, str(tmp_path))).collect(), key=lambda r: r["number"])
    assert [(r["study"], r["number"], r["value"]) for r in rows] == [("tune", 0, 0.5), ("alpha", 3, 0.75)]
    assert json.loads(rows[1]["params"]) == {"lr": 0.1}


@pytest.fixture
def event_files(spark, tmp_path):
    rows = [(u, 1_700_000_000 + 700 * i + 13 * u, (i + u) % 2, ((i * 37 + u * 11) % 100) / 100.0) for u in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, s long, label long, prob double").select(
        "user_id", F.timestamp_seconds("s").alias("event_time"), "label", "prob", (1 - F.col("prob")).alias("loss"))
    path = str(tmp_path / "ev")
    df.orderBy("event_time").coalesce(1).write.option("maxRecordsPerFile", 60).parquet(path)
    return path


@pytest.mark.parametrize(("build", "keys", "finish"), [
    (T.label_rates, ["window_start"], None),
    (T.score_histogram, ["window_start", "bin"], T.auc_from_histogram),
    (T.counts_per_second, ["user_id", "second"], T.recency_counters),
])
def test_stream_equals_batch(spark, event_files, build, keys, finish):
    batch = build(spark.read.parquet(event_files))
    batch = finish(batch) if finish else batch
    stream = spark.readStream.schema(spark.read.parquet(event_files).schema).option("maxFilesPerTrigger", 2).parquet(event_files)
    out = T.run_available(spark, build(stream), "update", keys, finish)

    def rounded(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())

    assert rounded(out) == rounded(batch)


def test_sessions_close_behind_the_watermark(spark, event_files):
    batch = T.user_sessions(spark.read.parquet(event_files)).collect()
    stream = spark.readStream.schema(spark.read.parquet(event_files).schema).option("maxFilesPerTrigger", 1).parquet(event_files)
    closed = T.run_available(spark, T.user_sessions(stream)).collect()
    assert {tuple(r) for r in closed} <= {tuple(r) for r in batch}
    newest = max(r["session_end"] for r in batch) - 3600 * 10**6
    assert {tuple(r) for r in batch if r["session_end"] <= newest - 600 * 10**6} == {tuple(r) for r in closed}


def test_live_counters_equal_counts_as_of(spark, event_files):
    from strandmill.operators.history import counts_as_of

    log = spark.read.parquet(event_files).select("user_id", F.unix_seconds("event_time").alias("ts"), F.lit("d").alias("domain"), F.expr("uuid()").alias("event_id"))
    probes = log.groupBy("user_id").agg(F.max("ts").alias("ts")).withColumn("sample_id", F.col("user_id"))
    at = {"now": F.col("ts") + 1, **{f"w{w}": F.col("ts") - w for w in (3600, 86400)}}
    want = {r["sample_id"]: (r["now_d"], r["now_d"] - r["w3600_d"], r["now_d"] - r["w86400_d"])
            for r in counts_as_of(probes, log, ["user_id"], at, ["d"]).collect()}
    stream = spark.readStream.schema(spark.read.parquet(event_files).schema).option("maxFilesPerTrigger", 1).parquet(event_files)
    live = T.run_available(spark, T.counts_per_second(stream), "update", ["user_id", "second"], T.recency_counters)
    assert {r["user_id"]: (r["n_events"], r["n_t0"], r["n_t1"]) for r in live.collect()} == want
