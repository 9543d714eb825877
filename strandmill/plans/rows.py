"""Queries: scans, sinks, row normalisation, filters and lookups (S, P, F, J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import arrays as A
from strandmill.operators import fit as fits
from strandmill.operators import normalize as N
from strandmill.operators import sequences as Q
from strandmill.operators.evaluate import drop_nan_scores
from strandmill.operators.registry import DeclaredSchema, Feature, Registry, bare_glob, concat_features, write_back
from strandmill.operators.splits import time_split
from strandmill.operators.target_history import first_seen_from_log, target_history
from strandmill.plans.adapters import DOMAINS, domain_events, event_log, impressions, samples_from_events, table
from strandmill.plans.base import EV, FULL_HIST, HIST, IMP, LENS, SPLIT, query, samples
from strandmill.sources import logs as L
from strandmill.sources import samples as X
from strandmill.sources import sinks as K

# The sample table in the declared layout: a cut-down schema with columns the files do not have.
LAYOUT = {
    "user_int": [[1, 50, 1], [15, 60, 5], [99, 10, 1]],
    "item_int": [[5, 11, 1], [6, 101, 1]],
    "user_dense": [[61, 4]],
    "item_dense": [[129, 6]],
    "seq": {
        "seq_a": {"prefix": "domain_a_seq", "ts_fid": 39, "features": [[38, 101], [39, 0], [42, 11]]},
        "seq_c": {"prefix": "domain_c_seq", "ts_fid": 27, "features": [[47, 101], [27, 0], [29, 21], [37, 8]]},
    },
}
ITEM_VECTOR_PARTS = {129: [("emb", 0, 4), ("count", 4, 1)]}


def declared_layout(df: DataFrame) -> DataFrame:
    """Samples under their declared column names; side features are shorter than the first one."""
    def field(domain: str, name: str):
        return F.transform(domain, lambda e: e[name])

    half = F.floor(F.size("seq_a") / 2).cast("int")
    return df.select(
        "sample_id", F.col("ts").alias("timestamp"), F.when(F.col("user_id") % 11 != 0, F.col("user_id")).alias("user_id"),
        "item_id", (F.col("label") * 2).cast("int").alias("label_type"),
        (F.col("item_id") - 20).cast("int").alias("user_int_feats_1"),
        field("seq_b", "item").cast("array<int>").alias("user_int_feats_15"),
        F.col("category").cast("int").alias("item_int_feats_5"), F.col("item_id").cast("int").alias("item_int_feats_6"),
        F.array("score", "logit", "prob").cast("array<float>").alias("user_dense_feats_61"),
        F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (i * F.col("item_id")).cast("float")).alias("item_dense_feats_129"),
        field("seq_a", "item").cast("array<int>").alias("domain_a_seq_38"),
        F.slice(field("seq_a", "ts"), F.lit(1), F.greatest(F.size("seq_a") - 1, F.lit(0))).alias("domain_a_seq_39"),
        F.slice(field("seq_a", "category"), F.lit(1), half).cast("array<int>").alias("domain_a_seq_42"),
        field("seq_c", "item").cast("array<int>").alias("domain_c_seq_47"), field("seq_c", "ts").alias("domain_c_seq_27"),
        field("seq_c", "campaign").cast("array<int>").alias("domain_c_seq_29"),
        field("seq_c", "advertiser").cast("array<int>").alias("domain_c_seq_37"))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return N.clean_rows(declared_layout(samples(spark, sf)), DeclaredSchema(LAYOUT), clip_vocab=True,
                        split=ITEM_VECTOR_PARTS, keep=["sample_id"])


@query("s1_sample_scan", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_in_file FROM events")
def s1(spark, sf):
    return X.scan(spark, f"{sf}/events.parquet", columns=["event_id"]).select("event_id", "row_in_file")


@query("s2_declared_schema", f"""WITH {IMP} SELECT sample_id, CAST(item_id - 20 AS INTEGER) AS user_int_feats_1,
  CAST(NULL AS INTEGER) AS user_int_feats_99 FROM imp""")
def s2(spark, sf):
    schema = DeclaredSchema(LAYOUT)
    return schema.conform(declared_layout(samples(spark, sf))).select("sample_id", "user_int_feats_1", "user_int_feats_99")


@query("s3_row_lookup", """WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS flat_idx FROM events)
SELECT e.flat_idx, e.event_id FROM e JOIN customer ON c_custkey = flat_idx""")
def s3(spark, sf):
    events = X.scan(spark, f"{sf}/events.parquet", columns=["event_id"])
    return X.lookup_rows(events, table(spark, sf, "customer"), "c_custkey").select("flat_idx", "event_id")


@query("s4_pruned_fit_scan", f"""WITH {IMP}{SPLIT} SELECT count(*) AS n_train, sum(label)::BIGINT AS pos, avg(score) AS mean_score,
  max(ts) AS newest FROM imp, cut WHERE ts < cutoff""")
def s4(spark, sf):
    df = time_split(samples(spark, sf), "ts", 0.2).withColumn("is_train", ~F.col("is_valid"))
    return X.fit_scan(df, [["label", "score"], ["ts", "score"]]).agg(
        F.count(F.lit(1)).alias("n_train"), F.sum("label").alias("pos"), F.avg("score").alias("mean_score"), F.max("ts").alias("newest"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("s5_inventory", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS \"rows\" FROM {t}" for t in TABLES))
def s5(spark, sf):
    """Rows per table, which is one file or a folder of files, maybe without rows."""
    files = reduce(DataFrame.unionByName, [
        X.inventory(spark, f"{sf}/{t}.parquet").select(F.lit(t).alias("table_name"), "rows") for t in TABLES])
    known = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in TABLES])).alias("table_name"))
    counted = files.groupBy("table_name").agg(F.sum("rows").alias("rows"))
    return known.join(counted, "table_name", "left").fillna(0, ["rows"])


@query("s5_row_groups")
def s5_groups(spark, sf):
    return X.row_groups(spark, sf)


@query("s6_last_prediction", f"""WITH {IMP} SELECT user_id, arg_max(prob, sample_id) AS prob FROM imp GROUP BY user_id""")
def s6(spark, sf):
    return K.last_prediction(samples(spark, sf), "sample_id")


@query("s7_row_set_digest", f"""WITH {IMP}{SPLIT} SELECT count(*) AS "rows", sum(sample_id)::BIGINT AS key_sum,
  bit_xor(sample_id) AS key_xor FROM imp, cut WHERE ts >= cutoff""")
def s7(spark, sf):
    valid = time_split(samples(spark, sf).select("sample_id", "ts"), "ts", 0.2).where("is_valid")
    return K.row_set_digest(valid, "sample_id").drop("hash_xor")


@query("s8_latest_metrics", f"""WITH {EV} SELECT event_type AS key, user_id AS step, arg_max(value, event_id) AS value
  FROM ev GROUP BY event_type, user_id""")
def s8(spark, sf):
    rows = event_log(spark, sf).select(F.col("event_type").alias("key"), F.col("user_id").alias("step"), "event_id", "value")
    return K.latest_metrics(rows, at="event_id")


def diagnostic_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines written from the events: one file per event type, in event order.

    The explode makes each line a stored value, as in a file, rather than a formula every parser step repeats.
    """
    log = event_log(spark, sf)
    c = {n: F.col(n).cast("string") for n in ("event_id", "user_id", "item")}
    v = F.format_string("%.2f", F.col("value"))
    step = F.concat(
        F.lit("12:00:00 run INFO  DIAG|STEP|step="), c["event_id"], F.lit(",epoch="), c["user_id"], F.lit(";;METRICS:loss="), v,
        F.lit(",tag=x"), c["item"], F.lit(";;PERF:samples="), c["item"], F.lit(",data_s=0.25,fwd_s=0.5,bwd_s=0.125,total_s="), v)
    line = F.when(F.col("item") % 25 == 1, F.lit("DIAG|CONFIG|METRICS,PERF")).when(
        F.col("item") % 25 == 2, F.lit("DIAG|PREAMBLE|run=1;;DATASET:files=1,free text")).when(
        F.col("item") % 25 == 3, F.concat(F.lit("loss is "), v)).otherwise(step)
    return log.select(F.col("event_type").alias("file_path"), F.lit(0).cast("long").alias("block"),
                      F.col("event_id").alias("line_no"), F.explode(F.array(line)).alias("line"))


DIAG_SQL = EV + """,
lines AS (SELECT *, event_type AS file_path, sum(CASE WHEN item % 25 = 1 THEN 1 ELSE 0 END)
  OVER (PARTITION BY event_type ORDER BY event_id) AS configs FROM ev),
numbered AS (SELECT *, coalesce(max(CASE WHEN item % 25 = 2 THEN configs END)
  OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS experiment FROM lines),
kv AS (
  SELECT file_path, event_id AS line_no, experiment, 'STEP' AS event, code, user_id AS epoch, event_id AS step, key, text
  FROM numbered, LATERAL (VALUES ('METRICS', 'loss', printf('%.2f', value)), ('METRICS', 'tag', 'x' || item),
    ('PERF', 'samples', item::VARCHAR), ('PERF', 'data_s', '0.25'), ('PERF', 'fwd_s', '0.5'), ('PERF', 'bwd_s', '0.125'),
    ('PERF', 'total_s', printf('%.2f', value))) AS t(code, key, text)
  WHERE item % 25 NOT IN (1, 2, 3)
  UNION ALL
  SELECT file_path, event_id, experiment, 'PREAMBLE', 'DATASET', NULL, NULL, 'files', '1' FROM numbered WHERE item % 25 = 2)"""


@query("s9_diagnostic_log", f"WITH {DIAG_SQL} SELECT *, TRY_CAST(text AS DOUBLE) AS value FROM kv")
def s9(spark, sf):
    return L.diagnostic_metrics(diagnostic_lines(spark, sf)).drop("block")


@query("e34_throughput", f"""WITH {DIAG_SQL}, w AS (SELECT file_path, experiment,
  avg(CASE WHEN key = 'samples' THEN text::DOUBLE END) AS n, avg(CASE WHEN key = 'total_s' THEN text::DOUBLE END) AS t
  FROM kv WHERE code = 'PERF' GROUP BY file_path, experiment)
SELECT file_path, experiment, n / t AS sps, 1.0 / t AS st_ps, 0.25::DOUBLE AS data_s, 0.5::DOUBLE AS fwd_s, 0.125::DOUBLE AS bwd_s,
  greatest(0.0, t - 0.875) AS misc_s, t AS total_s FROM w""")
def e34(spark, sf):
    m = L.diagnostic_metrics(diagnostic_lines(spark, sf)).where(F.col("code") == "PERF")
    return L.throughput_report(m, ("file_path", "experiment"))


@query("s10_tuning_trials", f"""WITH {EV}, s AS (SELECT event_type, arg_min('s' || user_id, event_id) AS study FROM ev
  WHERE item % 10 = 0 GROUP BY event_type)
SELECT ev.event_type AS file_path, study, event_id AS number, round(value / 500, 4) AS value, '{{"lr": ' || item || '}}' AS params
FROM ev JOIN s USING (event_type) WHERE item % 10 <> 0""")
def s10(spark, sf):
    log = event_log(spark, sf)
    auc = F.format_string("%.4f", F.round(F.col("value") / 500, 4))
    line = F.when(F.col("item") % 10 == 0, F.concat(F.lit("x TUNE|START|study=s"), F.col("user_id"), F.lit(", n=5"))).otherwise(
        F.concat(F.lit("TUNE|TRIAL_END|trial="), F.col("event_id"), F.lit(",auc="), auc, F.lit(",best_so_far=0.9;;PARAMS:{\"lr\": "),
                 F.col("item"), F.lit("}")))
    return L.tuning_trials(log.select(
        F.col("event_type").alias("file_path"), F.lit(0).cast("long").alias("block"), F.col("event_id").alias("line_no"), line.alias("line")))


@query("p1_scalar_category", f"""WITH {EV} SELECT event_id, CASE WHEN item - 20 > 0 AND item - 20 < 60 THEN item - 20 ELSE 0 END AS id,
  CASE WHEN item - 20 > 0 THEN item - 20 ELSE 0 END AS unclipped FROM ev""")
def p1(spark, sf):
    raw = F.col("item") - 20
    return event_log(spark, sf).select("event_id", A.clean_id(raw, 60).alias("id"), A.clean_id(raw).alias("unclipped"))


@query("p2_multi_slot_category", f"""WITH {HIST} SELECT i.sample_id, s.slot AS pos,
  CASE WHEN h.item < 60 THEN h.item ELSE 0 END::BIGINT AS value
FROM imp i CROSS JOIN (SELECT unnest(range(5))::INTEGER AS slot) s
LEFT JOIN hist h ON h.sample_id = i.sample_id AND h.dom = 'seq_b' AND h.pos = s.slot""")
def p2(spark, sf):
    return N.export_flat(cleaned(spark, sf), "sample_id", "user_cat_f15")


@query("p3_dense_vector", """WITH v AS (SELECT vec_id, unnest(embedding[1:80])::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
g AS (SELECT vec_id, unnest(range(80)) AS pos FROM embeddings)
SELECT g.vec_id, g.pos::INTEGER AS pos, coalesce(v.x, 0.0) AS value FROM g LEFT JOIN v USING (vec_id, pos)""")
def p3(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", A.fit_vector(F.col("embedding"), 80).alias("v"))
    return N.export_flat(df, "vec_id", "v")


@query("p4_vector_split", """SELECT vec_id, list_sum(CAST(embedding[1:48] AS DOUBLE[])) AS emb_sum,
  embedding[49]::DOUBLE AS cnt, 48::INTEGER AS emb_dim FROM embeddings""")
def p4(spark, sf):
    df = table(spark, sf, "embeddings").withColumns({
        "emb": A.sub_vector(F.col("embedding"), 0, 48), "one": A.sub_vector(F.col("embedding"), 48, 1)})
    return df.select("vec_id", A.total(F.col("emb")).alias("emb_sum"), F.get("one", F.lit(0)).alias("cnt"), F.size("emb").alias("emb_dim"))


@query("p5_sequence_alignment", f"""WITH {HIST} SELECT sample_id, pos::INTEGER AS pos, item,
  CASE WHEN pos < least(raw_len, 64) // 2 THEN category ELSE 0 END AS category FROM hist WHERE dom = 'seq_a'""")
def p5(spark, sf):
    df = cleaned(spark, sf).select("sample_id", F.posexplode(F.arrays_zip("seq_a_f38", "seq_a_f42")).alias("pos", "e"))
    return df.select("sample_id", "pos", F.col("e.seq_a_f38").alias("item"), F.col("e.seq_a_f42").alias("category"))


@query("p6_sequence_time", f"""WITH {LENS} SELECT l.sample_id, l.seq_a_len::INTEGER AS seq_a_len,
  coalesce(sum(CASE WHEN h.pos < l.seq_a_len - 1 THEN h.ts ELSE 0 END), 0)::BIGINT AS ts_sum
FROM lens l LEFT JOIN hist h ON h.sample_id = l.sample_id AND h.dom = 'seq_a' GROUP BY l.sample_id, l.seq_a_len""")
def p6(spark, sf):
    ts = F.aggregate("seq_a_ts", F.lit(0).cast("long"), lambda a, x: a + x)
    return cleaned(spark, sf).select("sample_id", "seq_a_len", ts.alias("ts_sum"))


@query("p7_label_and_ids", f"WITH {IMP} SELECT sample_id, label, CASE WHEN user_id % 11 = 0 THEN 0 ELSE user_id END AS user_id, item_id FROM imp")
def p7(spark, sf):
    return cleaned(spark, sf).select("sample_id", "label", "user_id", "item_id")


@query("p8_id_buckets", f"""WITH {EV} SELECT event_id, item % 16 + 1 AS bucketed, 0::BIGINT AS zeroed, item AS small FROM ev""")
def p8(spark, sf):
    item = F.col("item")
    return event_log(spark, sf).select(
        "event_id", N.bucket_ids(item, 101, 50, 17).alias("bucketed"), N.bucket_ids(item, 101, 50, 0).alias("zeroed"),
        N.bucket_ids(item, 40, 50, 17).alias("small"))


@query("p9_stable_tokens")
def p9(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", N.token_ids(F.col("props"), 1000).alias("token"), N.token_ids(F.col("props"), 1000, native=True).alias("native_token"))


@query("p10_feature_concat", f"""WITH {IMP} SELECT sample_id, pos::INTEGER AS pos, value, prob AS back FROM imp,
  LATERAL (VALUES (0, score), (1, logit), (2, prob)) AS t(pos, value)""")
def p10(spark, sf):
    df = samples(spark, sf).withColumn("pair", F.array("logit", "prob"))
    vec = concat_features(["score", "pair"], {"score"})
    back = write_back(F.col("vec"), {"score": 1, "pair": 2})
    out = df.select("sample_id", vec.alias("vec")).withColumn("back", F.get(back["pair"], F.lit(1)))
    return out.select("sample_id", "back", F.posexplode("vec").alias("pos", "value"))


@query("p11_padded_export", f"""WITH {LENS}, m AS (SELECT greatest(max(seq_b_len), 1) AS w FROM lens)
SELECT l.sample_id, g.pos::INTEGER AS pos, coalesce(h.item, 0) AS value, (g.pos < l.seq_b_len)::BOOLEAN AS mask
FROM lens l CROSS JOIN (SELECT unnest(range(w)) AS pos FROM m) g
LEFT JOIN hist h ON h.sample_id = l.sample_id AND h.dom = 'seq_b' AND h.pos = g.pos""")
def p11(spark, sf):
    df = samples(spark, sf).select("sample_id", F.transform("seq_b", lambda e: e["item"]).alias("b"))
    out = N.export_padded(df, "b")
    rows = out.select("sample_id", F.posexplode(F.arrays_zip("b_values", "b_mask")).alias("pos", "e"))
    return rows.select("sample_id", "pos", F.col("e.b_values").alias("value"), F.col("e.b_mask").alias("mask"))


@query("p11_padded_batches", f"""WITH {LENS}, r AS (SELECT *, row_number() OVER (ORDER BY seq_b_len, sample_id) - 1 AS i, sum(seq_b_len) OVER (ORDER BY seq_b_len, sample_id) - seq_b_len AS upto FROM lens),
b AS (SELECT sample_id, seq_b_len, i // 64 AS chunk, upto // 200 AS part FROM r),
w AS (SELECT *, greatest(max(seq_b_len) OVER (PARTITION BY chunk, part), 1) AS width FROM b),
g AS (SELECT *, unnest(range(width)) AS pos FROM w)
SELECT g.sample_id, g.chunk::BIGINT AS chunk, g.part::BIGINT AS part, g.pos::INTEGER AS pos, coalesce(h.item, 0) AS value, (g.pos < g.seq_b_len)::BOOLEAN AS mask
FROM g LEFT JOIN hist h ON h.sample_id = g.sample_id AND h.dom = 'seq_b' AND h.pos = g.pos""")
def p11_batches(spark, sf):
    df = samples(spark, sf).select("sample_id", F.transform("seq_b", lambda e: e["item"]).alias("b"))
    out = N.export_padded_batches(df, "sample_id", "b", batch_rows=64, batch_values=200)
    rows = out.select("sample_id", "batch.*", F.posexplode(F.arrays_zip("b_values", "b_mask")).alias("pos", "e"))
    return rows.select("sample_id", "chunk", "part", "pos", F.col("e.b_values").alias("value"), F.col("e.b_mask").alias("mask"))


@query("p12_flat_export", f"WITH {HIST} SELECT sample_id, pos::INTEGER AS pos, item AS value FROM hist WHERE dom = 'seq_d'")
def p12(spark, sf):
    return N.export_flat(samples(spark, sf).select("sample_id", F.transform("seq_d", lambda e: e["item"]).alias("v")), "sample_id", "v")


@query("p13_output_contract", f"WITH {IMP} SELECT label, user_id, item_id, score FROM imp")
def p13(spark, sf):
    registry = Registry([Feature("score", "numerical", "user", 1, source="derived")])
    df = samples(spark, sf).select("label", "user_id", "item_id", "score", "prob")
    return N.check_contract(df, registry, drop=["prob"])


@query("p14_domain_mask", f"""WITH {LENS} SELECT i.sample_id, 0::BIGINT AS item_sum, 0::BIGINT AS seq_a_len,
  l.seq_a_len AS n_kept, coalesce(max(h.raw_len), 0) AS seq_a_raw_len
FROM imp i JOIN lens l USING (sample_id) LEFT JOIN hist h ON h.sample_id = i.sample_id AND h.dom = 'seq_a' GROUP BY i.sample_id, l.seq_a_len""")
def p14(spark, sf):
    df = samples(spark, sf).withColumn("seq_a_len", F.size("seq_a").cast("long"))
    out = N.mask_domain(df, "seq_a")
    total = F.aggregate("seq_a", F.lit(0).cast("long"), lambda a, e: a + e["item"] + e["ts"])
    return out.select("sample_id", total.alias("item_sum"), "seq_a_len", F.size("seq_a").cast("long").alias("n_kept"), "seq_a_raw_len")


@query("p15_random_mask", f"""WITH {IMP} SELECT sample_id,
  CASE WHEN CAST('0x' || substr(md5('7|scores|' || sample_id), 1, 13) AS BIGINT) / 4503599627370496.0 < 0.3 THEN 0.0 ELSE score END AS score,
  prob FROM imp""")
def p15(spark, sf):
    out = N.mask_at_random(samples(spark, sf), {"scores": ["score"], "never": ["prob"]}, {"scores": 0.3}, "sample_id", 7)
    return out.select("sample_id", "score", "prob")


def _feature_counts(spark: SparkSession, sf: str, predicate: str) -> DataFrame:
    """Non-zero values of the cleaned features a predicate selects."""
    registry = DeclaredSchema(LAYOUT).registry(ITEM_VECTOR_PARTS)
    picked = registry.select(spark, predicate)
    df = cleaned(spark, sf)
    kinds = dict(df.dtypes)
    counts = {
        f.name: F.size(F.filter(f.name, lambda v: v != 0)) if kinds[f.name].startswith("array") else (F.col(f.name) != 0).cast("int")
        for f in picked}
    sums = df.agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n")) for n in counts])))


@query("f1_feature_predicate", f"""WITH {HIST} SELECT 'seq_c_f29' AS feature, count(*) AS n FROM hist WHERE dom = 'seq_c'
UNION ALL SELECT 'seq_c_f37', count(*) FROM hist WHERE dom = 'seq_c'
UNION ALL SELECT 'item_cat_f5', count(*) FROM imp""")
def f1(spark, sf):
    return _feature_counts(spark, sf, "dtype = 'CATEGORICAL' and source = 'original' and vocab_size <= 21 "
                                      "and (domain = 'seq_c' or entity in ('ITEM')) and name != 'seq_a_f42'")


@query("f2_bare_glob", f"WITH {IMP} SELECT 'item_cat_f5' AS feature, count(*) AS n FROM imp UNION ALL SELECT 'item_cat_f6', count(*) FROM imp WHERE item_id < 101")
def f2(spark, sf):
    return _feature_counts(spark, sf, bare_glob("item_cat_*"))


@query("f3_valid_events", f"""WITH {HIST} SELECT i.sample_id, count(h.item) AS n FROM imp i LEFT JOIN hist h ON h.sample_id = i.sample_id
  AND h.dom = 'seq_a' AND h.item % 7 <> 0 GROUP BY i.sample_id""")
def f3(spark, sf):
    df = samples(spark, sf).withColumn("seq_a", F.transform("seq_a", lambda e: e.withField("ts", F.when(e["item"] % 7 == 0, 0).otherwise(e["ts"]))))
    return df.select("sample_id", F.size(Q.valid_events(F.col("seq_a"))).cast("long").alias("n"))


@query("f4_nan_scores", f"WITH {IMP} SELECT count(*) AS n, avg(logit) AS mean_logit FROM imp WHERE item_id % 9 <> 0")
def f4(spark, sf):
    df = samples(spark, sf).withColumn("logit", F.when(F.col("item_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("logit")))
    return drop_nan_scores(df).agg(F.count(F.lit(1)).alias("n"), F.avg("logit").alias("mean_logit"))


RARE_SQL = """,
freq AS (SELECT item, count(*) AS n FROM (SELECT DISTINCT sample_id, item FROM hist JOIN imp USING (sample_id), cut
    WHERE dom = 'seq_c' AND imp.ts < cutoff) GROUP BY item),
ifreq AS (SELECT item_id, count(*) AS n FROM imp, cut WHERE ts < cutoff GROUP BY item_id)"""


@query("f5_rare_zeroing", f"""WITH {HIST}{SPLIT}{RARE_SQL} SELECT i.sample_id,
  CASE WHEN coalesce(f.n, 0) < 20 AND i.item_id < 90 THEN 0 ELSE i.item_id END AS item_id,
  (SELECT count(*) FROM hist h LEFT JOIN freq g ON g.item = h.item WHERE h.sample_id = i.sample_id AND h.dom = 'seq_c'
    AND (coalesce(g.n, 0) >= 60 OR h.item >= 95)) AS n_kept
FROM imp i LEFT JOIN ifreq f ON f.item_id = i.item_id""")
def f5(spark, sf):
    df = samples(spark, sf).withColumn("items", F.transform("seq_c", lambda e: e["item"]))
    df = df.select("sample_id", "ts", "item_id", "items")
    train = time_split(df, "ts", 0.2).where(~F.col("is_valid"))
    counts = fits.category_counts(train, {"item_id": 90}, {"items": 95})
    frequent = counts.where(F.when(F.col("feature") == "items", F.col("n") >= 60).otherwise(F.col("n") >= 20) & (F.col("value") > 0))
    out = fits.zero_rare_scalars(df, frequent, {"item_id": 90})
    out = fits.zero_rare_list(out, frequent, "items", 95, "sample_id")
    return out.select("sample_id", "item_id", F.size(F.filter("items", lambda v: v != 0)).cast("long").alias("n_kept"))


FIRST_SEEN_SQL = """,
seen AS (SELECT h.item, arg_min(h.campaign, h.sample_id * 1000000 + h.pos) AS campaign,
    arg_min(h.advertiser, h.sample_id * 1000000 + h.pos) AS advertiser
  FROM hist h, cut WHERE h.dom = 'seq_c' AND h.imp_ts < cutoff AND h.item > 0 GROUP BY h.item)"""


def item_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """item -> campaign and advertiser as first seen in the whole histories of the training impressions."""
    log = event_log(spark, sf)
    train = time_split(impressions(log).select("sample_id", "user_id", "ts"), "ts", 0.2).where(~F.col("is_valid"))
    ads = domain_events(log).where("domain = 'seq_c'")
    return first_seen_from_log(train, ads, ["user_id"], "item", ["campaign", "advertiser"], "sample_id", "event_id")


def targeted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(impressions with their target campaign and advertiser, events of all domains), both of the whole log."""
    log = event_log(spark, sf)
    mapping = item_mapping(spark, sf).withColumnRenamed("item", "item_id")
    known = impressions(log).select("sample_id", "ts", "user_id", "item_id", "category")
    return fits.attach_mapping(known, mapping, "item_id", {"campaign": "t_campaign", "advertiser": "t_advertiser"}), domain_events(log)


def past_of(imp: DataFrame, events: DataFrame, targets: dict[str, tuple[str, str]], windows: dict[str, int], domains: list[str], **more) -> DataFrame:
    """``target_history`` of a user's log: probes now and ``windows`` seconds before."""
    at = {"now": F.col("ts"), **{name: F.col("ts") - w for name, w in windows.items()}}
    return target_history(imp, events, ["user_id"], targets, at, domains, "event_id", **more)


@query("j1_item_lookup", f"""WITH {FULL_HIST}{SPLIT}{FIRST_SEEN_SQL} SELECT i.sample_id, coalesce(s.campaign, 0) AS t_campaign,
  coalesce(s.advertiser, 0) AS t_advertiser FROM imp i LEFT JOIN seen s ON s.item = i.item_id""")
def j1(spark, sf):
    return targeted(spark, sf)[0].select("sample_id", "t_campaign", "t_advertiser")


def target_sql(hist: str) -> str:
    return f"""WITH {hist} SELECT i.sample_id, EXISTS(SELECT 1 FROM hist h WHERE h.sample_id = i.sample_id
  AND h.dom = 'seq_a' AND h.item = i.item_id) AS hit FROM imp i"""


@query("j2_target_in_history", target_sql(HIST))
def j2(spark, sf):
    return samples(spark, sf).select("sample_id", Q.in_history(F.col("seq_a"), F.col("item_id")).alias("hit"))


@query("j2_target_in_log", target_sql(FULL_HIST))
def j2_log(spark, sf):
    log = event_log(spark, sf)
    imp = impressions(log)
    past = past_of(imp, domain_events(log).where("domain = 'seq_a'"), {"item": ("item", "item_id")}, {}, ["seq_a"])
    return imp.select("sample_id").join(past, "sample_id", "left").select("sample_id", F.coalesce(F.col("now_seq_a") > 0, F.lit(False)).alias("hit"))


@query("j3_target_matches", f"""WITH {FULL_HIST} SELECT h.sample_id, h.dom, count(*) AS n, max(h.ts) AS newest FROM hist h JOIN imp i USING (sample_id)
  WHERE h.category = i.category GROUP BY h.sample_id, h.dom""")
def j3(spark, sf):
    log = event_log(spark, sf)
    past = past_of(impressions(log), domain_events(log), {"category": ("category", "category")}, {}, DOMAINS)
    each = F.array(*[F.struct(F.lit(d).alias("dom"), F.col(f"now_{d}").alias("n"), F.col(f"last_{d}.ts").alias("newest")) for d in DOMAINS])
    return past.select("sample_id", F.inline(each)).where("n > 0")



@query("j4_build_samples", f"""WITH {HIST} SELECT i.sample_id, i.label, d.dom, count(h.item) AS n, coalesce(max(h.raw_len), 0) AS raw_len,
  coalesce(sum(h.item * (h.pos + 1)), 0)::BIGINT AS checksum
FROM imp i CROSS JOIN doms d LEFT JOIN hist h ON h.sample_id = i.sample_id AND h.dom = d.dom GROUP BY i.sample_id, i.label, d.dom""")
def j4(spark, sf):
    df = samples_from_events(spark, sf)
    def checksum(d):
        return F.aggregate(F.transform(d, lambda e, i: e["item"] * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    parts = F.array(*[F.struct(F.lit(d).alias("dom"), F.size(d).cast("long").alias("n"), F.col(f"{d}_raw_len").alias("raw_len"),
                               checksum(d).alias("checksum")) for d in DOMAINS])
    return df.select("sample_id", "label", F.inline(parts))


@query("j5_latest_event", f"""WITH {HIST} SELECT i.sample_id, max(h.ts) AS newest, i.ts - max(h.ts) AS gap FROM imp i
  LEFT JOIN hist h ON h.sample_id = i.sample_id AND h.dom = 'seq_d' GROUP BY i.sample_id, i.ts""")
def j5(spark, sf):
    df = samples(spark, sf)
    newest = F.array_max(F.transform(Q.valid_events(F.col("seq_d")), lambda e: e["ts"]))
    return df.select("sample_id", newest.alias("newest"), Q.last_gap(F.col("seq_d"), F.col("ts")).alias("gap"))
