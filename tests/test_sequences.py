"""Quirks and row operators of the sequence features against small restatements."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandmill.functions import scalars as S
from strandmill.operators import sequence_rows as R
from strandmill.operators import sequences as Q

EVENT = "array<struct<ts:bigint,action:bigint,item:bigint,category:bigint,campaign:bigint,advertiser:bigint>>"


def events(*rows):
    return [tuple(r) for r in rows]


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("gap", "bucket"), [
    (0, 1), (5, 1), (6, 2), (60, 12), (61, 13), (31536000, 63), (31536001, 63), (-50, 1)])
def test_time_bucket_edges(spark, gap, bucket):
    assert one(spark, Q.time_bucket(F.col("t"), F.lit(10**9)), t=10**9 - gap) == bucket


def test_time_bucket_missing(spark):
    assert one(spark, Q.time_bucket(F.col("t"), F.lit(100)), t=0) == 0


@pytest.mark.parametrize(("count", "bucket"), [(1, 1), (2, 2), (4, 2), (5, 3), (9, 3), (10, 4), (199, 7), (200, 8), (5000, 8)])
def test_run_bucket_edges(spark, count, bucket):
    assert one(spark, Q.run_bucket(F.col("c")), c=count) == bucket


def test_edges_passed_is_searchsorted(spark):
    import numpy as np

    edges = [1, 3, 3, 7, 10]
    for side in ("left", "right"):
        for v in range(0, 12):
            assert one(spark, S.edges_passed(F.col("v"), edges, side), v=v) == int(np.searchsorted(edges, v, side))


def test_weekday_is_thursday_first(spark):
    assert one(spark, S.weekday_id(F.col("t")), t=0) == 1  # 1970-01-01 08:00 local, a Thursday
    assert one(spark, S.weekday_id(F.col("t")), t=16 * 3600) == 2
    assert one(spark, S.hour_id(F.col("t")), t=0) == 9
    assert one(spark, S.weekend_from_weekday(S.weekday_id(F.col("t"))), t=2 * 86400) == 2


def wide(spark, seqs, imp=10_000, item=5):
    rows = [(i, imp, item, s) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, f"sample_id long, ts long, item_id long, seq_a {EVENT}")


def test_target_evidence_rules(spark):
    df = wide(spark, [[], events((9000, 2, 5, 1, 1, 1), (0, 40, 5, 1, 1, 1)), events((9000, 2, 6, 1, 1, 1)), events((0, 3, 5, 1, 1, 1))])
    cols = Q.target_evidence(F.col("seq_a"), F.col("ts"), F.col("item_id"), "item", F.col("item_id"), missing_value=0.7)
    got = [r.asDict() for r in df.select("sample_id", *[c.alias(n) for n, c in cols.items()]).orderBy("sample_id").collect()]
    assert all(v == 0 for k, v in got[0].items() if k != "sample_id")       # empty history: nothing, not even missing
    assert got[1]["flag"] == 1 and got[1]["gap_missing"] == 0 and got[1]["recent_1"] == 1
    assert got[1]["last_action"] == 1.0                                      # last by position, capped at 32
    assert got[2]["gap_missing"] == 0.7 and got[2]["last_gap_log"] == 0 and got[2]["flag"] == 0
    assert got[3]["flag"] == 1 and got[3]["gap_missing"] == 0.7              # a match without a time


def test_truncate_is_stable(spark):
    seq = events(*[(t, i, i, 1, 1, 1) for i, t in enumerate([5, 9, 5, 9, 7])])
    out = Q.truncate(wide(spark, [seq, []]), {"seq_a": 4}).orderBy("sample_id").collect()
    assert [e["item"] for e in out[0]["seq_a"]] == [1, 3, 4, 0]
    assert (out[0]["seq_a_raw_len"], out[0]["seq_a_len"], out[1]["seq_a_raw_len"]) == (5, 4, 0)


@pytest.fixture(scope="module")
def random_sequences(spark):
    rng = random.Random(5)
    seqs = []
    for _ in range(120):
        n = rng.choice([0, 1, 2, 5, 12, 30])
        seqs.append(events(*[(rng.randrange(1, 15), rng.randrange(3), rng.randrange(2), rng.randrange(1, 4),
                              rng.randrange(1, 4), rng.randrange(1, 3)) for _ in range(n)]))
    return seqs, wide(spark, seqs).cache()


@pytest.mark.parametrize("protect", [0, 3])
def test_run_length_against_loop(random_sequences, protect):
    seqs, df = random_sequences
    rows = R.run_length_compress(R.explode_events(df, "seq_a"), protect_recent=protect).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["sample_id"], r["new_pos"])):
        got.setdefault(r["sample_id"], []).append((r["pos"], r["run_count"]))
    for sid, seq in enumerate(seqs):
        order = sorted(range(len(seq)), key=lambda i: (seq[i][0], i))
        runs = []
        for place, i in enumerate(order):
            same = runs and seq[runs[-1][-1]][1:3] == seq[i][1:3]
            free = len(seq) <= protect or place < len(seq) - protect
            if same and (free or protect == 0):
                runs[-1].append(i)
            else:
                runs.append([i])
        assert got.get(sid, []) == [(run[-1], len(run)) for run in runs]
        assert sum(c for _, c in got.get(sid, [])) == len(seq)


def spread_slots(counts, newest, budget):
    """One slot per group and round; later rounds serve the fullest groups first."""
    groups = sorted(counts)
    given = dict.fromkeys(groups, 0)
    if budget < len(groups):
        for g in sorted(groups, key=lambda g: (-newest[g], g))[:budget]:
            given[g] = 1
        return given
    for g in groups:
        given[g] = 1
    left = budget - len(groups)
    while left > 0:
        room = [g for g in groups if counts[g] > given[g]]
        if not room:
            break
        room.sort(key=lambda g: (-(counts[g] - given[g]), -newest[g], g))
        for g in room[:left]:
            given[g] += 1
        left -= min(left, len(room))
    return given


@pytest.mark.parametrize(("cap", "protect"), [(6, 0), (8, 3), (2, 0), (5, 5), (11, 1)])
def test_budget_against_loop(random_sequences, cap, protect):
    seqs, df = random_sequences
    rows = R.budget_compress(R.explode_events(df, "seq_a"), ["category"], "campaign", cap, protect).collect()
    got = {}
    for r in rows:
        got.setdefault(r["sample_id"], []).append(r)
    for sid, seq in enumerate(seqs):
        mine = sorted(got.get(sid, []), key=lambda r: r["new_pos"])
        assert len(mine) == min(len(seq), cap)
        if len(seq) <= cap:
            assert [r["pos"] for r in mine] == list(range(len(seq)))
            continue
        order = sorted(range(len(seq)), key=lambda i: (seq[i][0], i))
        old, tail = order[: len(seq) - protect], order[len(seq) - protect:]
        counts, newest, pair = {}, {}, {}
        for i in old:
            g = seq[i][3]
            counts[g] = counts.get(g, 0) + 1
            newest[g] = max(newest.get(g, 0), seq[i][0])
            pair[g, seq[i][4]] = max(pair.get((g, seq[i][4]), 0), seq[i][0])
        given = spread_slots(counts, newest, cap - protect) if cap > protect else {}
        lo, hi = min(seq[i][0] for i in old), max(seq[i][0] for i in old)
        kept = set(tail)
        for g in counts:
            ranked = sorted((i for i in old if seq[i][3] == g), key=lambda i: (
                -(2.0 * (seq[i][0] == pair[g, seq[i][4]]) + ((seq[i][0] - lo) / (hi - lo) if hi > lo else 0.0)), order.index(i)))
            kept |= set(ranked[: given.get(g, 0)])
        assert {r["pos"] for r in mine} == kept
        assert [r["ets"] for r in mine] == sorted(r["ets"] for r in mine)


def test_sessions_against_loop(spark, random_sequences):
    rng = random.Random(8)
    rows = [(s, p, rng.choice([0, 1, 5, 13, 30, 31, 32, 47, 60]), rng.randrange(0, 3)) for s in range(80) for p in range(rng.randrange(0, 25))]
    df = spark.createDataFrame(rows, "sample_id long, pos int, time_bucket int, category long")
    got = {(r["sample_id"], r["pos"]): r for r in R.session_state(df, category="category").collect()}
    upper = [0, *Q.RECENCY_EDGES]
    by_sample = {}
    for s, p, b, c in rows:
        by_sample.setdefault(s, []).append((b, c))
    pos_bucket = lambda n: [None, 1, 2, 3, 4, 4, 5, 5, 5, 5, 5][n] if n <= 10 else 6
    len_bucket = lambda n: next(k for k, top in enumerate([1, 2, 4, 8, 16, 10**9], 1) if n <= top)
    for s, seq in by_sample.items():
        session, ids, starts = 0, [], []
        for i, (b, _) in enumerate(seq):
            new = b > 0 and (i == 0 or abs(upper[b] - upper[seq[i - 1][0]]) > 3600)
            session += new
            starts.append(new)
            ids.append(session)
        for i, (b, c) in enumerate(seq):
            r = got[s, i]
            assert r["gap"] == (0 if i == 0 else min(abs(b - seq[i - 1][0]), 63))
            if b == 0:
                assert (r["ss_prev"], r["ss_next"], r["ss_bnd"], r["ss_pos"], r["ss_len"]) == (0,) * 5
                continue
            nth = sum(1 for j in range(i + 1) if ids[j] == ids[i] and seq[j][0] > 0)
            size = sum(1 for j in range(len(seq)) if ids[j] == ids[i] and seq[j][0] > 0)
            go_on = i + 1 < len(seq) and seq[i + 1][0] > 0 and not starts[i + 1]
            assert r["ss_prev"] == (1 if starts[i] else 2) and r["ss_next"] == (2 if go_on else 1)
            assert r["ss_bnd"] == (2 if starts[i] or not go_on else 1)
            assert (r["ss_pos"], r["ss_len"]) == (pos_bucket(nth), len_bucket(size))
            prev = seq[i - 1][1] if i else 0
            assert r["cat_change"] == (0 if c == 0 or prev == 0 else 2 if c != prev else 1)


def test_chunk_ratio_solves_the_length(spark):
    df = spark.createDataFrame([(1000.0,), (50.0,)], "n double")
    r = [x["r"] for x in df.select(R.chunk_ratio(F.col("n"), 5, 8).alias("r")).collect()]
    assert r[0] == pytest.approx(3.0278, abs=1e-4)
    assert 8 * (r[1] ** 5 - 1) / (r[1] - 1) == pytest.approx(50, abs=1e-6)


def test_pooling_keeps_every_event(random_sequences):
    seqs, df = random_sequences
    out = R.recency_pool(df, "seq_a", ["item"], chunks=2, tokens=4, buckets=["category"]).collect()
    for sid, seq in enumerate(seqs):
        mine = [r for r in out if r["sample_id"] == sid]
        assert sum(r["n_pooled"] for r in mine) == len(seq)
        if len(seq) <= 8:
            assert sorted(r["slot"] for r in mine) == list(range(len(seq)))


def test_rewrite_domain_keeps_empty_rows_and_columns(random_sequences):
    seqs, df = random_sequences
    out = R.rewrite_domain(df, "seq_a", lambda rows, key: R.run_length_compress(rows, key=key)).collect()
    assert len(out) == len(seqs)
    for r in out:
        assert (r["ts"], r["item_id"]) == (10_000, 5)
        assert (len(r["seq_a"]) == 0) == (len(seqs[r["sample_id"]]) == 0)
        assert [e["ts"] for e in r["seq_a"]] == sorted(e["ts"] for e in r["seq_a"])


@pytest.mark.parametrize("protect", [0, 3])
def test_wide_and_row_compression_agree(random_sequences, protect):
    _, df = random_sequences
    rows = R.run_length_compress(R.explode_events(df, "seq_a"), protect_recent=protect).select("sample_id", "new_pos", "ets", "item", "run_bucket")
    flat = Q.compress_runs(df, "seq_a", "action", "item", protect).select("sample_id", F.posexplode("seq_a").alias("p", "e"))
    wide_rows = flat.select("sample_id", "p", "e.ts", "e.item", "e.run_bucket")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, wide_rows.collect()))
    assert Q.compress_runs(df, "seq_a", "action", "item", protect).count() == df.count()


def test_wide_and_row_sessions_agree(random_sequences):
    _, df = random_sequences
    seq = F.transform("seq_a", lambda e: e.withField("time_bucket", F.when(e["item"] == 0, 0).otherwise(e["ts"] * 4)))
    df = df.withColumn("seq_a", seq)
    names = ["gap", "ss_prev", "ss_next", "ss_bnd", "ss_pos", "ss_len", "cat_same_prev", "cat_same_next", "cat_change"]
    rows = R.session_state(R.explode_events(df, "seq_a"), category="category").select("sample_id", "pos", *names)
    flat = Q.add_session_state(df, "seq_a", category="category").select("sample_id", F.posexplode("seq_a").alias("pos", "e"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, flat.select("sample_id", "pos", *[f"e.{n}" for n in names]).collect()))


def test_wide_and_row_truncation_agree(random_sequences):
    _, df = random_sequences
    wide_rows = Q.truncate(df, {"seq_a": 7}).select("sample_id", F.posexplode("seq_a").alias("p", "e")).select("sample_id", "p", "e.ts", "e.item")
    rows = R.top_recent(R.explode_events(df, "seq_a"), 7).select("sample_id", "new_pos", "ets", "item")
    assert sorted(map(tuple, wide_rows.collect())) == sorted(map(tuple, rows.collect()))
