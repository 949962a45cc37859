"""Golden values and invariants of the volume operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import expressions as X
from tesserae.operators import blend, forward, layers, normalize, tiling, weights
from tesserae.plans import networks
from tesserae.queries import PatchNorm
from tesserae.sources import models, tensors, volumes
from tesserae.streaming import rolling

STEPS = {(255, 128): [0, 64, 127], (178, 128): [0, 50], (256, 128): [0, 64, 128], (253, 128): [0, 62, 125], (40, 32): [0, 8], (128, 64): [0, 32, 64], (31, 32): [0], (10, 32): [], (1, 1): [0]}


def volume(spark, array, volume_id="v"):
    cells = [(volume_id, 0, *map(int, at), float(array[at])) for at in np.ndindex(array.shape)]
    return spark.createDataFrame(cells, "volume_id string, c int, z int, y int, x int, v double")


def dense(df, value, shape, key=None):
    out = np.full(shape, np.nan)
    for row in df.collect():
        at = (row["z"], row["y"], row["x"])
        out[(row[key], *at) if key else at] = row[value]
    return out


@pytest.mark.parametrize("size", STEPS)
def test_positions(spark, size):
    assert tiling.positions(*size, 0.5) == STEPS[size]
    assert spark.range(1).select(X.steps(F.lit(size[0]), size[1], 0.5)).first()[0] == STEPS[size]


@pytest.mark.parametrize("image,tile", [(255, 128), (253, 128), (40, 32), (33, 32), (64, 64), (7, 4)])
def test_covering_is_the_range_join(spark, image, tile):
    found = {r["id"]: r["c"] for r in spark.range(image).select("id", X.covering(F.col("id").cast("int"), F.lit(image), tile, 0.5).alias("c")).collect()}
    starts = tiling.positions(image, tile, 0.5)
    assert found == {z: [i for i, s in enumerate(starts) if s <= z < s + tile] for z in range(image)}


def test_gaussian(spark):
    got = [r["w"] for r in tiling.gaussian_map(spark, (8, 1, 1), scale=10.0).orderBy("d0").collect()]
    want = [0.003354626, 0.111089965, 1.353352832, 6.065306597, 10, 6.065306597, 1.353352832, 0.111089965]
    assert np.allclose(got, want, atol=1e-8)
    floored = [r["w"] for r in tiling.gaussian_map(spark, (101, 1, 1), sigma_scale=1 / 400).collect()]
    assert sum(w == min(floored) for w in floored) >= 82 and math.isclose(min(floored), 1.3253090144e-276, rel_tol=1e-9)


def test_norms(spark):
    v = lambda xs: spark.createDataFrame([("a", 0, i, 0, 0, x) for i, x in enumerate(xs)], "volume_id string, c int, z int, y int, x int, v double")
    values = lambda df: [r["v"] for r in df.orderBy("z").collect()]
    assert values(normalize.ct(v([-500.0, -100.0, 0.0, 50.0, 200.0, 999.0]), 50, 25, -100, 200)) == [-6, -6, -2, 0, 6, 6]
    assert np.allclose(values(normalize.zscore(v([0.0, 2.0, 4.0, 0.0, 6.0]))), [-2.449489743, -1.224744871, 0, -2.449489743, 1.224744871])
    assert values(normalize.zscore(v([0.0, 0.0]))) == [0, 0]
    assert math.isnan(values(normalize.ct(v([float("nan")]), 0, 1, -1, 1))[0])


def test_padding(spark):
    assert tiling.padding((7, 40, 31), (32, 32, 32)) == [(12, 13), (0, 0), (0, 1)]
    image = np.arange(1.0, 13).reshape(3, 2, 2)
    padded, box = tiling.pad(volume(spark, image), image.shape, (4, 5, 2))
    got = dense(padded, "v", box)
    assert np.array_equal(got, np.pad(image, [(0, 1), (1, 2), (0, 0)]))
    assert np.array_equal(dense(tiling.crop(padded, image.shape, (4, 5, 2)), "v", image.shape), image)


def blended_by_numpy(image, patch, step, network, classes):
    sums, total = np.zeros((classes, *image.shape)), np.zeros(image.shape)
    bells = [np.exp(-((np.arange(p) - p // 2) ** 2) / (2 * (p / 8) ** 2)) for p in patch]
    w = 10 * bells[0][:, None, None] * bells[1][None, :, None] * bells[2][None, None, :]
    for s in itertools.product(*[tiling.positions(n, p, step) for n, p in zip(image.shape, patch)]):
        box = tuple(slice(a, a + p) for a, p in zip(s, patch))
        sums[(slice(None), *box)] += w * network(image[box][None])
        total[box] += w
    return sums / total


def norm_head(box):
    a = forward.leaky(forward.normed(box))[0]
    return np.stack([a * 0.8 + 0.1, a * -0.5 + 0.2, a * 0.3 - 0.1])


def test_predict_and_blend_against_numpy(spark):
    image, patch = np.random.default_rng(1).standard_normal((9, 6, 7)), (4, 4, 4)
    scores = forward.predict_patches(volume(spark, image), image.shape, patch, 0.5, PatchNorm()).cache()
    want = blended_by_numpy(image, patch, 0.5, norm_head, 3)
    got = blend.blend_arrays(scores, 3, patch).select("z", "y", "x", F.posexplode("ls").alias("k", "l"))
    assert np.allclose(dense(got, "l", want.shape, "k"), want)
    long = scores.select("volume_id", "pid", "z", "y", "x", "d0", "d1", "d2", F.posexplode("ls").alias("k", "l"))
    for other in (blend.blend(long, patch), rolling.rolling_batch(long, patch), blend.strict_blend(long, patch)):
        assert np.allclose(dense(other, "l", want.shape, "k"), want)
    seg = blend.segment(scores, patch).collect()
    best = {}
    for row in scores.orderBy("pid").collect():
        d = (row["d0"], row["d1"], row["d2"])
        w = 10 * np.prod([math.exp(-((a - 2) ** 2) / (2 * 0.5**2)) for a in d])
        s = np.array(row["ls"]) * w
        order = sorted(range(3), key=lambda k: (-s[k], k))
        at = (row["z"], row["y"], row["x"])
        if at not in best or s[order[0]] > best[at][1] + 1e-12:
            best[at] = (order[0], s[order[0]], order[1], s[order[1]])
    assert len(seg) == image.size
    assert all(r["label1"] == best[r["z"], r["y"], r["x"]][0] and math.isclose(r["score1"], best[r["z"], r["y"], r["x"]][1], rel_tol=1e-9) for r in seg)


def test_top_two_ties(spark):
    pick = lambda xs: tuple(spark.range(1).select(X.top_two(F.array(*map(F.lit, xs))).alias("t")).first()["t"])
    assert pick([5.0, 5.0, 1.0]) == (0, 5.0, 1, 5.0)
    assert pick([2.5]) == (0, 2.5, 0, float("-inf"))


def test_segment_first_patch_wins_ties_and_keeps_its_pair(spark):
    cells = [("v", p, 0, 0, 0, 1, 1, 1, s) for p, s in [(0, [9.0, 8.0, 0.0, 0.0]), (1, [0.0, 9.0, 8.5, 0.0])]]
    df = spark.createDataFrame(cells, "volume_id string, pid long, z int, y int, x int, d0 int, d1 int, d2 int, ls array<double>")
    assert tuple(blend.segment(df, (2, 2, 2), uniform=True).first())[4:] == (0, 9.0, 1, 8.0)
    cells[1] = (*cells[1][:-1], [0.0, 0.0, 10.0, 1.0])
    df = spark.createDataFrame(cells, df.schema)
    assert tuple(blend.segment(df, (2, 2, 2), uniform=True).first())[4:] == (2, 10.0, 3, 1.0)


def test_softmax(spark):
    got = spark.range(1).select(X.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))).first()[0]
    assert np.allclose(got, [0.090030573, 0.244728471, 0.665240956])


@pytest.mark.parametrize("size,stride", [((3, 3, 3), (1, 1, 1)), ((3, 1, 3), (2, 1, 2)), ((1, 1, 1), (1, 1, 1))])
def test_convolution_both_ways(spark, size, stride):
    rng = np.random.default_rng(2)
    image, w = rng.standard_normal((6, 4, 4)), rng.standard_normal((2, *size, 1))
    rows = [(o, 0, a, b, c, float(w[o, a, b, c, 0])) for o in range(2) for a, b, c in np.ndindex(size)]
    kernel = spark.createDataFrame(rows, "o int, i int, dz int, dy int, dx int, w double")
    want = forward.conv(image[None], w, stride=stride)
    got = layers.conv3d(volume(spark, image), kernel, image.shape, size, stride)
    assert layers.conv_shape(image.shape, size, stride) == want.shape[1:]
    assert np.allclose(dense(got, "v", want.shape, "c"), want)
    naive = np.zeros(want.shape)
    padded = np.pad(image, [((k - 1) // 2,) * 2 for k in size])
    for o, z, y, x in np.ndindex(want.shape):
        cut = padded[z * stride[0] :, y * stride[1] :, x * stride[2] :][: size[0], : size[1], : size[2]]
        naive[o, z, y, x] = (cut * w[o, ..., 0]).sum()
    assert np.allclose(want, naive)


def test_mirrored_mean_of_equivariant_network_changes_nothing():
    box = np.random.default_rng(3).standard_normal((1, 4, 3, 5))
    assert np.allclose(forward.mirrored(norm_head, (0, 1, 2))(box), norm_head(box))
    lopsided = lambda x: forward.conv(x, np.array([1.0, 0, -2]).reshape(1, 1, 1, 3, 1))
    assert not np.allclose(forward.mirrored(lopsided, (2,))(box), lopsided(box))
    assert len(tiling.axis_subsets((0, 1, 2))) == 8


def test_unet_equals_relational_layers(spark):
    """A two-stage network on a whole patch and as joins."""
    from tesserae import queries as q

    features, k = np.random.default_rng(4).standard_normal(q.BOX), (3, 3, 3)
    want = q._unet(spark, volume(spark, features), False)
    arch = networks.Architecture(1, 3, [2, 3], [[3, 3, 3]] * 2, [[1, 1, 1], [2, 2, 2]], [1, 1], [1], bias=False)

    def array(n_out, n_in, size, salt=0):
        out = np.zeros((n_out, *size, n_in))
        for o, i, a, b, c, w in q.cells(n_out, n_in, size, salt):
            out[o, a, b, c, i] = w
        return out

    head = np.array([[((3 * o + 2 * i) % 7 - 3) / 10 for i in range(2)] for o in range(3)]).reshape(3, 1, 1, 1, 2)
    stored = {
        "encoder.stages.0.convs.0.conv.weight": array(2, 1, k), "encoder.stages.1.convs.0.conv.weight": array(3, 2, k, 3), "decoder.transpconvs.0.weight": array(2, 3, (2, 2, 2), 6),
        "decoder.stages.0.convs.0.conv.weight": array(2, 4, k, 7), "decoder.seg_layers.0.weight": head, "decoder.seg_layers.0.bias": np.array([-0.1, 0, 0.1]),
    }
    got = forward.UNet(arch, stored)(features[None])
    assert np.allclose(dense(want, "l", got.shape, "k"), got, atol=1e-4)


def test_descriptions():
    assert networks.stage_features(6) == [32, 64, 128, 256, 320, 320]
    small = networks.Architecture(1, 3, [16, 32, 64, 128], [[3, 3, 3]] * 4, [[1, 1, 1]] + [[2, 2, 2]] * 3, [2] * 4, [2] * 3)
    assert small.parameters() == 1_402_297
    large = networks.Architecture(1, 105, [32, 64, 128, 256, 320, 320], [[3, 3, 3]] * 6, [[1, 1, 1]] + [[2, 2, 2]] * 5, [2] * 6, [2] * 5)
    assert large.parameters() == 31_278_509
    old = {"configurations": {"3d_fullres": {"pool_op_kernel_sizes": [[1, 1, 1], [2, 2, 2]], "conv_kernel_sizes": [[3, 3, 3]] * 2, "n_conv_per_stage_encoder": [2, 2], "n_conv_per_stage_decoder": [2], "UNet_base_num_features": 8}}}
    assert networks.from_plans(old, 1, 4).features == [8, 16]
    new = {"configurations": {"3d_fullres": {"network_arch_class_name": "x.ResidualEncoderUNet", "network_arch_init_kwargs": {"n_stages": 2, "features_per_stage": [8, 16], "kernel_sizes": 3, "strides": [1, 2], "conv_bias": False, "nonlin_kwargs": {"inplace": True}}}}}
    arch = networks.from_plans(new, 2, 4)
    assert arch.residual and arch.encoder_convs == [1, 1] and arch.strides == [[1, 1, 1], [2, 2, 2]] and arch.slope == 0.01 and not arch.bias and arch.options == {}


def test_batch_sizes(spark):
    patch = F.array(*[F.lit(128)] * 3)
    widths = F.array(*map(F.lit, networks.stage_features(6)))
    assert spark.range(1).select(networks.activation_bytes(patch, widths)).first()[0] == 1_429_012_480
    got = [spark.range(1).select(networks.batch_size(patch, F.lit(105), F.lit(gib * 2.0**30))).first()[0] for gib in (8, 12.7, 72)]
    assert got == [1, 2, 8]


def test_tensor_files(spark, tmp_path):
    rows = [("conv.weight", [2, 1, 3, 3, 3], [float(i) for i in range(54)]), ("x.transpconv.weight", [4, 2, 2, 2, 2], [float(i) for i in range(64)]), ("norm", [3], [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "key string, shape array<int>, data array<float>")
    assert models.store(df, str(tmp_path)) == 1
    back = {r["key"]: (r["shape"], r["data"]) for r in models.load_weights(spark, str(tmp_path)).collect()}
    assert back == {k: (s, d) for k, s, d in rows}
    turned = {r["key"]: np.array(r["data"]).reshape(r["shape"]) for r in weights.transposed(df).collect()}
    assert np.array_equal(turned["conv.weight"], np.arange(54).reshape(2, 1, 3, 3, 3).transpose(0, 2, 3, 4, 1))
    assert np.array_equal(turned["x.transpconv.weight"], np.arange(64).reshape(4, 2, 2, 2, 2).transpose(1, 2, 3, 4, 0))
    with pytest.raises(ValueError, match="no weight_layout"):
        tensors.decode(tensors.encode([]).replace(b"weight_layout", b"weight_layoux"))
    with pytest.raises(ValueError, match="Unsupported"):
        tensors.decode(tensors.encode([], layout="other"))
    with pytest.raises(FileNotFoundError):
        models.load_weights(spark, str(tmp_path), fold=3)


def test_keys(spark):
    one = lambda f, k: spark.range(1).select(f(F.lit(k))).first()[0]
    assert one(X.remapped_key, "encoder.stages.0.0.convs.1.conv.weight") == "encoder.stages.0.convs.1.conv.weight"
    assert one(X.remapped_key, "decoder.stages.0.convs.0.conv.weight") == "decoder.stages.0.convs.0.conv.weight"
    assert not one(X.kept_key, "x.all_modules.0.weight") and not one(X.kept_key, "decoder.encoder.stages.0.w")
    assert one(X.fuzzy_key, "encoder.stages.3.0.foo.weight") == "encoder.stages.3.0.foo.weight"


def test_engine(spark, tmp_path):
    import json

    from tesserae import Engine, ModelBundle

    plans = {"configurations": {"3d_fullres": {"patch_size": [8, 8, 8], "normalization_schemes": ["ZScoreNormalization"], "pool_op_kernel_sizes": [[1, 1, 1], [2, 2, 2]], "conv_kernel_sizes": [[3, 3, 3]] * 2, "n_conv_per_stage_encoder": [1, 1], "n_conv_per_stage_decoder": [1], "UNet_base_num_features": 4}}}
    folder = tmp_path / "Dataset007_x" / "Trainer__plans__3d"
    folder.mkdir(parents=True)
    (folder / "plans.json").write_text(json.dumps(plans))
    (folder / "dataset.json").write_text(json.dumps({"labels": {"0": "a", "1": "b", "2": "c"}, "channel_names": {"0": "CT"}}))
    rng, arch = np.random.default_rng(5), networks.from_plans(plans, 1, 3)
    rows = [(k, [int(n) for n in s], [float(x) for x in rng.standard_normal(int(np.prod(s)))]) for k, _, s in arch.layers()]
    models.store(spark.createDataFrame(rows, "key string, shape array<int>, data array<float>"), str(folder))
    engine = Engine(ModelBundle.from_task(spark, 7, root=str(tmp_path)))
    image = volume(spark, rng.standard_normal((10, 8, 5)))
    assert engine.prepare((10, 8, 5)) is engine.prepare((10, 8, 5)) and engine.prepare((10, 8, 5)).n_patches == 2
    first = dense(engine.predict(image), "l", (3, 10, 8, 5), "k")
    again = dense(engine.predict(engine.normalize(image), normalized=True), "l", (3, 10, 8, 5), "k")
    assert not np.isnan(first).any() and np.allclose(first, again)
    assert engine.segment(image).count() == 400 and engine.unmapped.count() == 0
    # a second volume of another shape changes nothing in the first, and is predicted as it would be alone
    other = volume(spark, rng.standard_normal((3, 9, 12)), "w")
    both, alone = engine.predict(image.unionByName(other)), dense(engine.predict(other), "l", (3, 3, 9, 12), "k")
    assert np.allclose(dense(both.where("volume_id = 'v'"), "l", (3, 10, 8, 5), "k"), first)
    assert both.count() == 3 * (400 + 324) and np.allclose(dense(both.where("volume_id = 'w'"), "l", (3, 3, 9, 12), "k"), alone)


def test_blocks(spark):
    blocks = spark.createDataFrame([("v", 2, 0, 1, [1, 2, 2], [1.0, 2.0, 3.0, 4.0])], "volume_id string, z0 int, y0 int, x0 int, dims array<int>, data array<float>")
    got = {(r["z"], r["y"], r["x"]): r["v"] for r in volumes.from_blocks(blocks).collect()}
    assert got == {(2, 0, 1): 1.0, (2, 0, 2): 2.0, (2, 1, 1): 3.0, (2, 1, 2): 4.0}
