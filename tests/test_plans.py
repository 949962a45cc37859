"""Descriptions of networks, stored models and the command line, on fixed small cases."""

import pytest
from pyspark.sql import functions as F

from tesserae import queries
from tesserae.functions import expressions as X
from tesserae.operators import tiling, weights
from tesserae.plans import networks
from tesserae.sources import models, tensors

NEW_PLANS = {
    "configurations": {"3d_fullres": {"patch_size": [16, 16, 16]}},
    "network_arch_class_name": "some.package.ResidualEncoderUNet",
    "network_arch_init_kwargs": {
        "n_stages": 3, "features_per_stage": [4, 8, 8], "kernel_sizes": [[1, 3, 3], 3, 3], "strides": [1, [1, 2, 2], 2], "n_blocks_per_stage": [1, 2, 1], "n_conv_per_stage_decoder": [1, 1],
        "conv_bias": True, "stem_channels": 6, "norm_op_kwargs": {"eps": 1e-3}, "nonlin_kwargs": {"inplace": True},
    },
}


def block(key, o, i, kernel=(3, 3, 3)):
    return {f"{key}.conv.weight": [o, i, *kernel], f"{key}.conv.bias": [o], f"{key}.norm.weight": [o], f"{key}.norm.bias": [o]}


def test_layers_of_a_description_with_network_arguments():
    name = "encoder.stages.{}.blocks.{}.{}".format
    flat, one = (1, 3, 3), (1, 1, 1)
    want = block("encoder.stem.convs.0", 6, 1, flat)
    want |= block(name(0, 0, "conv1"), 4, 6, flat) | block(name(0, 0, "conv2"), 4, 4, flat) | block(name(0, 0, "skip"), 4, 6, one)
    want |= block(name(1, 0, "conv1"), 8, 4) | block(name(1, 0, "conv2"), 8, 8) | block(name(1, 0, "skip"), 8, 4, one)
    want |= block(name(1, 1, "conv1"), 8, 8) | block(name(1, 1, "conv2"), 8, 8) | block(name(2, 0, "conv1"), 8, 8) | block(name(2, 0, "conv2"), 8, 8)
    want |= {"decoder.transpconvs.0.weight": [8, 8, 2, 2, 2], "decoder.transpconvs.0.bias": [8], "decoder.seg_layers.0.weight": [3, 8, 1, 1, 1], "decoder.seg_layers.0.bias": [3]} | block("decoder.stages.0.convs.0", 8, 16)
    want |= {"decoder.transpconvs.1.weight": [8, 4, 1, 2, 2], "decoder.transpconvs.1.bias": [4], "decoder.seg_layers.1.weight": [3, 4, 1, 1, 1], "decoder.seg_layers.1.bias": [3]} | block("decoder.stages.1.convs.0", 4, 8, flat)
    assert {k: list(s) for k, _, s in networks.from_plans(NEW_PLANS, 1, 3).layers()} == want


def test_layers_of_many_networks_are_those_of_each(spark):
    given = [(n, n, 8 * n, 100, 3 + n) for n in (1, 2, 4, 6)]
    found = networks.layer_rows(spark.createDataFrame(given, "model int, n int, base int, most int, classes int")).collect()
    for model, n, base, most, classes in given:
        arch = networks.Architecture(1, classes, networks.stage_features(n, base, most), [[3, 3, 3]] * n, [[1, 1, 1]] + [[2, 2, 2]] * (n - 1), [2] * n, [2] * (n - 1))
        assert {(r["key"], r["kind"], tuple(r["shape"])) for r in found if r["model"] == model} == {(k, kind, tuple(s)) for k, kind, s in arch.layers()}


def test_sums_of_layers_are_those_of_their_rows(spark):
    given = [(n, n, 8 * n, 100, 3 + n) for n in (1, 2, 4, 6)] + [(9, 3, 8, 64, None), (None, 2, 8, 64, 5), (10, None, 8, 64, 5)]
    nets = spark.createDataFrame(given, "model int, n int, base int, most int, classes int")
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    want = networks.layer_rows(nets).groupBy("model", "kind").agg(F.count("*"), F.sum(size)).collect()
    found = networks.layer_sums(nets).groupBy("model", "kind").agg(F.sum("tensors"), F.sum("parameters")).collect()
    assert {tuple(r) for r in found} == {tuple(r) for r in want} and len(found) == len(want) == 3 + 5 * 5
    heads = networks.layer_rows(nets, kinds=("head",)).collect()
    assert {str(r) for r in heads} == {str(r) for r in networks.layer_rows(nets).where("kind = 'head'").collect()} and len(heads) == 12


@pytest.mark.parametrize("name", ["network_layers", "param_count", "deep_supervision_order"])
def test_networks_are_grouped_in_tasks_of_a_bounded_number_of_them(spark, tmp_path, monkeypatch, name):
    """One file of one row group: its task must not hold a group for each of its networks."""
    monkeypatch.setattr(networks, "ROWS", 500, raising=False)
    parts = spark.range(4000).select((F.col("id") % 3900).alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))  # the first 100 twice, of the same size
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = queries.queries()[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]
    held = found.groupBy(F.spark_partition_id()).agg(F.count_distinct("model").alias("n")).collect()
    assert sum(r["n"] for r in held) == 3900 and max(r["n"] for r in held) < 1000
    if name != "deep_supervision_order":  # both networks of a key count
        rows = {r["model"]: r["parameters"] for r in found.groupBy("model").agg(F.sum("parameters").alias("parameters")).where("model IN (7, 107)").collect()}
        assert rows[7] == 2 * rows[107]


def test_defaults_of_descriptions(spark):
    texts = [(0, "{}"), (1, '{"class_name": "ResidualEncoderUNet", "base": 16, "conv_bias": false}'), (2, '{"nonlin_kwargs": {"inplace": true, "negative_slope": 0.2}, "most": 512}'), (3, '{"nonlin_kwargs": {"inplace": true}}')]
    got = networks.defaulted(spark.createDataFrame(texts, "id int, json string")).drop("json").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, "PlainConvUNet", False, 32, 320, True, 0.01, 0), (1, "ResidualEncoderUNet", True, 16, 320, False, 0.01, 0), (2, "PlainConvUNet", False, 32, 512, True, 0.2, 1), (3, "PlainConvUNet", False, 32, 320, True, 0.01, 0)]


def test_positions_and_mirrored_passes(spark):
    for image, tile in ((255, 128), (178, 128), (256, 128), (253, 128), (40, 32), (128, 64), (31, 32), (10, 32), (128, 128), (2000, 32)):
        (found,) = spark.range(1).select(X.steps(F.lit(image), tile, 0.5)).first()
        assert found == tiling.positions(image, tile, 0.5)
    assert tiling.axis_subsets((0, 1, 2)) == [(), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]


def test_pending_conversions(spark):
    paths = ["m/fold_0/checkpoint_final.pth", "m/fold_1/checkpoint_final.pth", "m/fold_1/checkpoint_final.safetensors", "m/fold_2/checkpoint_best.pth", "m/fold_3/checkpoint_final.safetensors"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r["path"] for r in weights.pending(df, df).collect()) == [paths[0], paths[3]]


def test_store_of_models_in_the_environment(monkeypatch):
    monkeypatch.delenv(models.WEIGHTS, raising=False)
    with pytest.raises(FileNotFoundError):
        models.weights_dir()
    monkeypatch.setenv(models.WEIGHTS, "/some/where")
    assert models.weights_dir() == "/some/where"


def test_command_line(spark, tmp_path, capsys):
    given = spark.createDataFrame([("a.weight", [2, 2], [1.0, 2.0, 3.0, 4.0]), ("b", [1], [5.0])], "key string, shape array<int>, data array<float>")
    for fold in (0, 1):
        given.coalesce(1).write.parquet(f"{tmp_path}/fold_{fold}/checkpoint_final.parquet")
    one = f"{tmp_path}/fold_0/checkpoint_final.parquet"
    said = []
    for args in ([one, "-o", f"{tmp_path}/out.safetensors"], [one, "-o", f"{tmp_path}/out.safetensors"], [str(tmp_path), "--all"], [str(tmp_path), "--all"], [str(tmp_path), "--all", "--force"]):
        assert models.main(args) == 0
        said.append(capsys.readouterr().out.splitlines()[-1])
    assert said == ["1 files written", "0 files written", "2 files written", "0 files written", "2 files written"]
    assert {(r["key"], tuple(r["data"])) for r in tensors.read_safetensors(spark, f"{tmp_path}/out.safetensors").collect()} == {("a.weight", (1.0, 2.0, 3.0, 4.0)), ("b", (5.0,))}


def test_models_are_converted_when_a_task_is_loaded(spark, tmp_path):
    import json

    from tesserae import ModelBundle

    folder = tmp_path / "Dataset003_x" / "T__plans__3d"
    folder.mkdir(parents=True)
    (folder / "plans.json").write_text(json.dumps({"configurations": {}}))
    (folder / "dataset.json").write_text(json.dumps({"labels": {"0": "a"}, "channel_names": {"0": "CT"}}))
    spark.createDataFrame([("a", [2], [1.0, 2.0])], "key string, shape array<int>, data array<float>").write.parquet(f"{folder}/fold_0/checkpoint_final.parquet")
    with pytest.raises(FileNotFoundError):
        ModelBundle.from_task(spark, 3, root=str(tmp_path), auto_convert=False)
    assert [tuple(r["data"]) for r in ModelBundle.from_task(spark, 3, root=str(tmp_path)).weights.collect()] == [(1.0, 2.0)]
    assert ModelBundle.from_task(spark, 3, root=str(tmp_path), auto_convert=False).weights.count() == 1
