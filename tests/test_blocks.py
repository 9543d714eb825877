"""Registry, normalisation, block chains and their state."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandmill.functions import arrays as A
from strandmill.operators import fit as fits
from strandmill.operators import fit_pass as once
from strandmill.operators import normalize as N
from strandmill.operators.registry import DeclaredSchema, Feature, Registry, bare_glob, glob_to_regex
from strandmill.plans.blocks import FeatureChain

LAYOUT = {
    "user_int": [[1, 10, 1], [2, 10, 3], [9, 5, 1]],
    "item_int": [],
    "user_dense": [[7, 4]],
    "seq": {"seq_a": {"prefix": "dom_a", "ts_fid": 39, "features": [[38, 100], [39, 0], [40, 50]]}},
}


def raw(spark):
    schema = ("sample_id long, timestamp long, user_id long, item_id long, label_type int, user_int_feats_1 int, "
              "user_int_feats_2 array<int>, user_dense_feats_7 array<float>, dom_a_38 array<int>, dom_a_39 array<long>, dom_a_40 array<int>")
    rows = [
        (0, 100, None, None, None, None, None, None, None, None, None),
        (1, 100, 3, 4, 2, 10, [1, -1, 10, 4], [1.0, 2.0, 3.0, 4.0, 5.0], [5, 0, 7], [90, 91], [1, 2, 3, 4]),
        (2, 100, 3, 4, 1, -1, [9], [], [], [], [1]),
        (3, 100, 3, 4, 2, 9, [], [1.5], [500], [0], [-2]),
    ]
    return spark.createDataFrame(rows, schema)


def test_clean_rows(spark):
    schema = DeclaredSchema(LAYOUT)
    out = N.clean_rows(raw(spark), schema, clip_vocab=True, keep=["sample_id"]).orderBy("sample_id").collect()
    assert [r["label"] for r in out] == [0, 1, 0, 1]
    assert [r["user_cat_f1"] for r in out] == [0, 0, 0, 9]
    assert [r["user_cat_f2"] for r in out] == [[0, 0, 0], [1, 0, 0], [9, 0, 0], [0, 0, 0]]
    assert [r["user_cat_f9"] for r in out] == [0] * 4
    assert out[1]["user_cont_f7"] == [1, 2, 3, 4] and out[3]["user_cont_f7"] == [1.5, 0, 0, 0] and out[0]["user_cont_f7"] == [0] * 4
    assert (out[1]["seq_a_f38"], out[1]["seq_a_ts"], out[1]["seq_a_f40"]) == ([5, 0, 7], [90, 91, 0], [1, 2, 3])
    assert out[2]["seq_a_f40"] == [] and out[2]["seq_a_len"] == 0
    assert out[3]["seq_a_f38"] == [500] and out[3]["seq_a_f40"] == [0]  # sequences are not clipped to the vocabulary
    assert (out[0]["user_id"], out[0]["item_id"], out[0]["seq_a_len"]) == (0, 0, 0)


def test_missing_sequence_column_is_an_error(spark):
    with pytest.raises(ValueError, match="dom_a_40"):
        DeclaredSchema(LAYOUT).conform(raw(spark).drop("dom_a_40"))


def test_registry_predicates(spark):
    reg = DeclaredSchema(LAYOUT).registry()
    def names(p):
        return [f.name for f in reg.select(spark, p)]

    assert names("entity = 'USER' and dtype = 'Numerical' and scope = 'static' and source != 'metadata'") == ["user_cont_f7"]
    assert names("domain = 'seq_a' and source in ('ORIGINAL')") == ["seq_a_f38", "seq_a_f40"]
    assert names("name matches '*_f?' and not vocab_size > 5") == ["user_cat_f9", "user_cont_f7"]
    assert names("domain = '' and dim >= 3") == ["user_cat_f2", "user_cont_f7"]
    assert names(bare_glob("user_cat_*")) == ["user_cat_f1", "user_cat_f2", "user_cat_f9"]
    with pytest.raises(ValueError, match="no value"):
        names("dtype = 'vector'")
    with pytest.raises(Exception, match="(?i)colour"):
        names("colour = 'red'")
    assert Registry.from_json(reg.to_json())["seq_a_f38"] == reg["seq_a_f38"]


def test_glob_is_anchored(spark):
    import re

    assert re.match(glob_to_regex("seq_?"), "seq_a") and not re.match(glob_to_regex("seq_?"), "seq_ab")


def test_stable_hash_is_blake2b(spark):
    words = ["a", "ü", "click|7"]
    got = [r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(N.stable_hash64("w").alias("h")).collect()]
    want = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % ((1 << 63) - 1) + 1 for w in words]
    assert got == want


def test_contract(spark):
    df = spark.createDataFrame([(1, 2, 3)], "label long, extra long, known long")
    reg = Registry([Feature("known", "numerical", "user", 1)])
    assert N.check_contract(df, reg, ["extra"]).columns == ["label", "known"]
    with pytest.raises(ValueError, match="extra"):
        N.check_contract(df, reg)


def test_chain_rules():
    with pytest.raises(ValueError, match="unknown blocks"):
        FeatureChain({"nothing": {}})
    with pytest.raises(ValueError, match="no parameters"):
        FeatureChain({"time_bucket": {"domains": ["a"], "colour": 1}})
    with pytest.raises(ValueError, match="must come before"):
        FeatureChain({"seq_truncate": {"max_seq_lens": {"a": 3}}, "time_bucket": {"domains": ["a"]}})
    with pytest.raises(ValueError, match="does not list"):
        FeatureChain({"time_cats": {}, "sample_weight": {}}, order=["time_cats"])
    ordered = FeatureChain({"assembly": {}, "time_cats": {}, "sample_weight": None})
    assert [b.key for b in ordered.blocks] == ["time_cats", "assembly"]
    assert "time_hour" in ordered.registry
    with pytest.raises(ValueError, match="cap"):
        FeatureChain({"seq_compress": {"budget_domains": {"a": {"group_key": ["g"], "prefer_diverse": "x", "cap": 2}}, "protect_recent": {"a": 3}}})


def test_chain_state_survives_a_round_trip(spark, tmp_path):
    rows = [(i, 1000 + i, float(i), [float(i), float(i % 3)], i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id long, ts long, x double, v array<double>, c long")
    cfg = {"rssc": {"columns": {"v": 2}}, "sample_weight": {}, "freq_filter": {"scalars": {"c": 10}, "min_count": 11},
           "l2_norm": {"columns": ["v"]}, "signal_engineering": {"pca_features": [{"feature": "v", "n_components": 1}]}}
    chain = FeatureChain(cfg)
    state = chain.fit(df)
    chain.save(state, str(tmp_path))
    loaded = FeatureChain.load(spark, str(tmp_path), {k: list(t) for k, t in state.items()})
    a = chain.transform(df, state).orderBy("sample_id").collect()
    b = FeatureChain(cfg).transform(df, loaded).orderBy("sample_id").collect()
    assert a == b
    assert {r["c"] for r in a} == {0}  # each value occurs ten times, below the minimum of eleven
    assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-9 or r["v"] == [0.0, 0.0] for r in a)


def test_fit_reads_the_training_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i, 7200 * i, [float(i), None, float(i % 3)], i % 4, [i % 4, i % 4, 9], [(i % 6, i % 5, i % 3), (i % 2, 0, 1)]) for i in range(60)]
    schema = "sample_id long, ts long, v array<double>, c long, l array<long>, seq_c array<struct<item:long,campaign:long,advertiser:long>>"
    plain = spark.createDataFrame(rows, schema)
    df = plain.mapInArrow(look, schema)
    chain = FeatureChain({"rssc": {"columns": {"v": 3}}, "sample_weight": {}, "c_target": {}, "temporal_dynamics": {"domains": ["seq_c"]},
                          "freq_filter": {"scalars": {"c": 10}, "lists": {"l": 8}, "min_count": 11}})
    state = chain.fit(df)
    got = {k: {n: sorted(map(tuple, t.collect()), key=repr) for n, t in s.items()} for k, s in state.items()}
    assert seen.value == 60
    want = {
        "rssc": {"v": fits.robust_scaler_fit(plain, "v", 3)},
        "sample_weight": {"weight": fits.recency_weight_fit(plain)},
        "c_target": {"map": fits.first_seen(plain, "seq_c", "item", ["campaign", "advertiser"], "sample_id")},
        "temporal_dynamics": {"map": fits.first_seen(plain, "seq_c", "item", ["advertiser"], "sample_id")},
        "freq_filter": {"frequent": fits.frequent_values(fits.category_counts(plain, {"c": 10}, {"l": 8}), 11)},
    }
    assert got == {k: {n: sorted(map(tuple, t.collect()), key=repr) for n, t in s.items()} for k, s in want.items()}


def test_scales_from_counts_at_any_task_size(spark):
    df = spark.createDataFrame([([float(i % 50), -0.0 if i % 2 else 0.0],) for i in range(900)], "v array<double>")
    table = once.gather(df, {"a": once.number_entries("a", "v", 2)}).where("stat = 'a'")
    small, large = ({r["dim"]: (r["median"], r["scale"]) for r in once.scaler(table, n).collect()} for n in (10**6, 16))
    assert small == large == {0: (24.5, 25.0), 1: (0.0, 1.0)}
    assert once.scaler(table.where("false")).collect() == []


def test_random_mask_is_repeatable(spark):
    df = spark.range(2000).withColumnRenamed("id", "sample_id").withColumn("x", F.lit(1.0))
    a = N.mask_at_random(df, {"g": ["x"]}, {"g": 0.25}, "sample_id", 3).agg(F.sum("x")).first()[0]
    b = N.mask_at_random(df.repartition(9), {"g": ["x"]}, {"g": 0.25}, "sample_id", 3).agg(F.sum("x")).first()[0]
    assert a == b and 1400 < a < 1600


def test_fit_ids_lengths(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "a array<int>")
    assert [r[0] for r in df.select(A.fit_ids(F.col("a"), 2)).collect()] == [[1, 2], [0, 0], [0, 0]]


def test_stages_of_a_pipeline_survive_saving(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import SQLTransformer

    from strandmill.plans.ml import FeatureBlocks, FeatureBlocksModel

    rows = [(i, 1000 + i, [float(i), float(i % 3)], i % 4 + (i > 30)) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id long, ts long, v array<double>, c long")
    stages = [FeatureBlocks({"rssc": {"columns": {"v": 2}}, "freq_filter": {"scalars": {"c": 10}, "min_count": 10}}),
              SQLTransformer(statement="SELECT *, c * 2 AS twice FROM __THIS__"),
              FeatureBlocks({"l2_norm": {"columns": ["v"]}, "sample_weight": {}}, order=["sample_weight", "l2_norm"])]
    pipe = Pipeline(stages=stages)
    pipe.write().save(f"{tmp_path}/unfitted")
    fitted = Pipeline.load(f"{tmp_path}/unfitted").fit(df)
    fitted.write().save(f"{tmp_path}/fitted")
    loaded = PipelineModel.load(f"{tmp_path}/fitted")
    assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages] and isinstance(loaded.stages[0], FeatureBlocksModel)
    assert list(loaded.stages[0].state) == list(fitted.stages[0].state) and loaded.stages[2].getOrDefault("order") == ["sample_weight", "l2_norm"]
    sort = lambda d: sorted(map(tuple, d.collect()), key=repr)
    got = sort(loaded.transform(df))
    assert got == sort(fitted.transform(df)) == sort(pipe.fit(df).transform(df)) and len(got) == 40
    first = FeatureChain({"rssc": {"columns": {"v": 2}}, "freq_filter": {"scalars": {"c": 10}, "min_count": 10}})
    then = FeatureChain({"sample_weight": {}, "l2_norm": {"columns": ["v"]}})
    middle = first.transform(df, first.fit(df)).withColumn("twice", F.col("c") * 2)
    assert got == sort(then.transform(middle, then.fit(middle)))
    fitted.write().overwrite().save(f"{tmp_path}/fitted")
    assert fitted.stages[0].copy().transform(df.limit(0)).count() == 0
    for wrong, why in (({"nothing": {}}, "unknown blocks"), ({"time_cats": {3: 4}}, "not text"), ({"time_cats": {"a": df}}, "cannot be saved")):
        with pytest.raises(ValueError, match=why):
            FeatureBlocks(wrong)
