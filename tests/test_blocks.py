"""Blocks against the voxel forms and NumPy: patches, batches, segmentation, layers, rolling planes, sums and quantiles."""

import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tesserae import queries as Q
from tesserae.functions.sums import binned_sum, exact_quantiles, total
from tesserae.operators import blend as B
from tesserae.operators import blocks, forward, layers, tiling
from tesserae.sources import volumes
from tesserae.streaming.rolling import FLAT, Ring, rolling_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests

PATCH, SIDE = (6, 4, 5), (4, 3, 4)
SIZES = {"large": (13, 9, 10), "flat": (3, 9, 10), "one": (1, 1, 1), "exact": (6, 4, 5), "even": (12, 8, 10)}


def arrays():
    rng = np.random.default_rng(1)
    return {n: rng.normal(size=s) for n, s in SIZES.items()}


@pytest.fixture(scope="module")
def held():
    return arrays()


@pytest.fixture(scope="module")
def voxels(spark, held):
    rows = [(n, 0, int(z), int(y), int(x), float(a[z, y, x])) for n, a in held.items() for z, y, x in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "volume_id string, c int, z int, y int, x int, v double")


def packed(voxels, side=SIDE):
    return blocks.pack(voxels, volumes.extents(voxels), side)


class Three:
    """Scores that depend on a patch as a whole; takes one patch at a time."""

    def __call__(self, box):
        a = forward.leaky(forward.normed(box))[0]
        return np.stack([a, 0.5 - a, 0.1 * a])


class Many(Three):
    batched = True

    def __call__(self, boxes):
        self.most = max(getattr(self, "most", 0), len(boxes))
        return np.stack([Three.__call__(self, b) for b in boxes])


def blended(array, network, uniform=False):
    """By the definition, over the padded array."""
    pads = tiling.padding(array.shape, PATCH)
    padded = np.pad(array, pads)
    g = [np.exp(-((np.arange(p) - p // 2) ** 2) / (2 * (p / 8) ** 2)) for p in PATCH]
    w = np.ones(PATCH) if uniform else 10 * g[0][:, None, None] * g[1][:, None] * g[2]
    total_, weights, best = np.zeros((3, *padded.shape)), np.zeros(padded.shape), {}
    starts = [tiling.positions(n, p, 0.5) for n, p in zip(padded.shape, PATCH)]
    for s in [(a, b, c) for a in starts[0] for b in starts[1] for c in starts[2]]:
        at = tuple(slice(x, x + p) for x, p in zip(s, PATCH))
        scores = network(padded[at][None])
        total_[(slice(None), *at)] += w * scores
        weights[at] += w
        for place in np.ndindex(*PATCH):
            ranked = sorted((-w[place] * scores[(k, *place)], k) for k in range(3))
            to = tuple(x + d for x, d in zip(s, place))
            if to not in best or -ranked[0][0] > best[to][1]:
                best[to] = (ranked[0][1], -ranked[0][0], ranked[1][1], -ranked[1][0])
    crop = tuple(slice(b, b + n) for (b, _), n in zip(pads, array.shape))
    return (total_ / weights)[(slice(None), *crop)], {tuple(i - b for i, (b, _) in zip(k, pads)): v for k, v in best.items()}


@pytest.mark.parametrize("batch,network,uniform", [(1, Three(), False), (3, Many(), False), (8, Many(), False), (8, Many(), True)])
def test_prediction_on_blocks(voxels, held, batch, network, uniform):
    plan = blocks.Patching(PATCH, 0.5, SIDE, batch, uniform)
    got = blocks.unpack(blocks.predicted(packed(voxels), plan, network, 3), SIDE).collect()
    assert len(got) == sum(a.size for a in held.values())
    want = {n: blended(a, Three(), uniform)[0] for n, a in held.items()}
    for r in got:
        assert np.allclose(r["ls"], want[r["volume_id"]][:, r["z"], r["y"], r["x"]], atol=1e-9)


def test_absent_voxels_and_whole_blocks_are_zeros(spark):
    """A volume with voxels in one corner only, and a plane without most of its rows."""
    rows = [("v", 0, z, y, x, float(z + 2 * y - x)) for z in range(3) for y in range(2) for x in range(3) if (z + x) % 2]
    sizes = spark.createDataFrame([("v", 13, 9, 10)], "volume_id string, n_z int, n_y int, n_x int")
    array = np.zeros((13, 9, 10))
    for _, _, z, y, x, v in rows:
        array[z, y, x] = v
    voxels = spark.createDataFrame(rows, "volume_id string, c int, z int, y int, x int, v double")
    got = blocks.unpack(blocks.predicted(blocks.pack(voxels, sizes, SIDE), blocks.Patching(PATCH, 0.5, SIDE), Three(), 3), SIDE).collect()
    want = blended(array, Three())[0]
    assert len(got) == array.size and all(np.allclose(r["ls"], want[:, r["z"], r["y"], r["x"]], atol=1e-9) for r in got)
    plane = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (11, [4.0, 5.0, 6.0])], "i int, a array<float>")
    held = {(r["z"], r["x"]): r["ls"] for r in blocks.unpack(blocks.pack_arrays(plane, 14, 3, "i", "a", (4, 1, 2)), (4, 1, 2)).collect()}
    assert len(held) == 42 and {k: v for k, v in held.items() if v != [0.0]} == {(z, x): [3.0 * (z == 11) + x + 1] for z in (1, 11) for x in range(3)}


def test_batches_are_cut_to_size(voxels):
    """A home of many patches: all calls but the last have the whole batch."""
    plan, sizes = blocks.Patching(PATCH, 0.5, (16, 16, 16), 3), []
    axes = plan.axes((13, 9, 10))
    body = np.random.default_rng(0).normal(size=(1, 13, 9, 10))
    table = blocks._batch([("v", 13, 9, 10, 0, 0, 0, 0, 0, 0, 0, 0, 0, 13, 9, 10, 1, body.tobytes())], blocks.PIECE)

    class Counting(Many):
        def __call__(self, boxes):
            sizes.append(len(boxes))
            return super().__call__(boxes)

    found = list(plan.runs(table, Counting()))
    n = int(np.prod([len(a.starts) for a in axes]))
    assert [pid for pid, _, _ in found] == list(range(n)) and sizes == [3] * (n // 3) + [n % 3] * (n % 3 > 0)


def test_the_same_to_the_last_bit_however_rows_are_dealt(spark, voxels):
    results = []
    for parts in ("1", "3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found = blocks.predicted(packed(voxels.repartition(int(parts) + 1)), blocks.Patching(PATCH, 0.5, SIDE, 2), Three(), 3)
            results.append(sorted((tuple(r[k] for k in blocks.KEY), bytes(r["data"])) for r in found.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


def test_wider_homes_exchange_fewer_bytes(held):
    """Of one volume, the pieces that leave homes of one block, of two along each axis, and of all; the results are one."""
    size, body = (13, 9, 10), held["large"]
    sent, sums = [], []
    for spread in ((1, 1, 1), (2, 2, 2), (8, 8, 8)):
        plan = blocks.Patching(PATCH, 0.5, SIDE, spread=spread)
        axes, bytes_, total_ = plan.axes(size), 0, np.zeros(size)
        for home in np.ndindex(*(max(a.homes) + 1 for a in axes)):
            if all(h in a.homes for a, h in zip(axes, home)):
                box = [a.box[h] for a, h in zip(axes, home)]
                lo = [max(x, 0) for x, _ in box]
                cut = body[tuple(slice(x, min(y, n)) for x, (_, y), n in zip(lo, box, size))]
                piece = blocks._batch([("v", *size, 0, 0, 0, *home, *lo, *cut.shape, 1, np.ascontiguousarray(cut).tobytes())], blocks.PIECE)
                for _, at, scores in plan.runs(piece, Three()):
                    total_[tuple(slice(a.start + x, a.stop + x) for a, (x, _) in zip(at, box))] += scores[0]
                row = {"volume_id": "v", **dict(zip(("n_z", "n_y", "n_x"), size))}
                bytes_ += sum(8 * int(np.prod([x.stop - x.start for x in at])) for _, at in plan.pieces(row, home, box))
        sent.append(bytes_)
        sums.append(total_)
    assert sent[0] > 2 * sent[1] >= 2 * sent[2] == 16 * body.size
    assert np.allclose(sums[0], sums[1]) and np.allclose(sums[0], sums[2])


@pytest.mark.parametrize("spread", [(2, 2, 2), (1, 4, 2)])
def test_prediction_by_wider_homes(voxels, held, spread):
    got = blocks.unpack(blocks.predicted(packed(voxels), blocks.Patching(PATCH, 0.5, SIDE, 4, spread=spread), Many(), 3), SIDE).collect()
    want = {n: blended(a, Three())[0] for n, a in held.items()}
    assert len(got) == sum(a.size for a in held.values())
    assert all(np.allclose(r["ls"], want[r["volume_id"]][:, r["z"], r["y"], r["x"]], atol=1e-9) for r in got)


def test_segmentation_on_blocks_exchanges_planes_only(voxels, held):
    plan = blocks.Patching(PATCH, 0.5, SIDE, 2)
    segments = blocks.segmented(packed(voxels), plan, Many())
    assert not any(n in blocks.RANKED for n in ("channels", "ls")) and "label2" in blocks.RANKED  # what the exchange carries
    want = {n: blended(a, Three())[1] for n, a in held.items()}
    got = blocks.unpack_segments(segments, SIDE).collect()
    assert len(got) == sum(a.size for a in held.values())
    for r in got:
        a, s, b, t = want[r["volume_id"]][r["z"], r["y"], r["x"]]
        assert (r["label1"], r["label2"]) == (a, b) and np.allclose([r["score1"], r["score2"]], [s, t], atol=1e-9)


def test_two_best_of_ties_and_nan():
    nan, inf = np.nan, np.inf
    scores = np.array([[1, nan, nan, 2], [1, 3, nan, nan], [0, nan, nan, nan]], float).reshape(3, 1, 1, 4)
    label1, score1, label2, score2 = (p.ravel().tolist() for p in blocks._two_best(scores))
    assert (label1, label2) == ([0, 1, 0, 0], [1, 0, 1, 1]) and score1 == [1, 3, -inf, 2] and score2 == [1, -inf, -inf, -inf]
    assert [p.ravel().tolist() for p in blocks._two_best(scores[:1])][2:] == [[0] * 4, [-inf] * 4]


def test_patches_from_blocks(voxels, held):
    got = blocks.extracted(packed(voxels), blocks.Patching(PATCH, 0.5, SIDE)).collect()
    count = 0
    for n, a in held.items():
        padded = np.pad(a, tiling.padding(a.shape, PATCH))
        starts = [tiling.positions(m, p, 0.5) for m, p in zip(padded.shape, PATCH)]
        for pid, s in enumerate((i, j, k) for i in starts[0] for j in starts[1] for k in starts[2]):
            row = next(r for r in got if (r["volume_id"], r["pid"]) == (n, pid))
            assert (row["s0"], row["s1"], row["s2"]) == s
            assert np.array_equal(np.frombuffer(row["data"], "<f8").reshape(PATCH), padded[tuple(slice(x, x + p) for x, p in zip(s, PATCH))])
            count += 1
    assert len(got) == count


@pytest.mark.parametrize("kernel,stride", [((3, 3, 3), (1, 1, 1)), ((3, 3, 3), (2, 2, 2)), ((1, 3, 3), (1, 2, 2)), ((5, 1, 3), (3, 1, 1))])
def test_convolution_on_blocks_is_the_relational_one(spark, voxels, kernel, stride):
    shape = SIZES["large"]
    one = voxels.where("volume_id = 'large'")
    w = Q.kernel_array(2, 1, kernel)
    relational = layers.conv3d(one, Q.kernel(spark, 2, 1, kernel), shape, kernel, stride, Q.biases(spark, 2)).collect()
    found = blocks.unpack(blocks.conv3d(packed(one), w, SIDE, stride, np.array([-0.1, 0.0])), SIDE).collect()
    got = {(c, r["z"], r["y"], r["x"]): v for r in found for c, v in enumerate(r["ls"])}
    assert len(got) == len(relational) and all(abs(got[r["c"], r["z"], r["y"], r["x"]] - r["v"]) < 1e-9 for r in relational)


def test_network_layers_take_several_patches():
    rng = np.random.default_rng(2)
    x, w, up = rng.normal(size=(3, 2, 6, 4, 8)), rng.normal(size=(4, 3, 3, 3, 2)), rng.normal(size=(4, 2, 2, 2, 2))
    for f in (lambda y: forward.conv(y, w, np.arange(4.0), (2, 1, 2)), lambda y: forward.conv_up(y, up), forward.normed, forward.Mirrored(forward.normed, (0, 2))):
        assert np.allclose(f(x), np.stack([f(one) for one in x]))
    whole = forward.conv(x[0], w)
    forward.COLUMNS, held = 1, forward.COLUMNS  # a plane at a time
    try:
        assert np.allclose(forward.conv(x[0], w), whole)
    finally:
        forward.COLUMNS = held


# rolling planes


def scored(plan, held):
    rows = []
    for n, a in held.items():
        axes = plan.axes(a.shape)
        padded = np.pad(a, tiling.padding(a.shape, plan.patch))
        before = [b for b, _ in tiling.padding(a.shape, plan.patch)]
        for pid, s in enumerate((i, j, k) for i in axes[0].starts for j in axes[1].starts for k in axes[2].starts):
            found = Three()(padded[tuple(slice(x + b, x + b + p) for x, b, p in zip(s, before, plan.patch))][None])
            rows.append((n, *a.shape, pid, *s, 3, found.tobytes()))
    return rows


def test_ring_is_bounded_and_late_patches_are_defined(held):
    plan = blocks.Patching(PATCH, 0.5, SIDE)
    deep = {"deep": np.random.default_rng(3).normal(size=(60, 5, 6))}
    rows = sorted(scored(plan, deep), key=lambda r: (r[5], r[4]))
    ring, out = Ring((60, 5, 6), 3, plan), {}
    starts = ring.axes[0].starts
    most = PATCH[0] + max(b - a for a, b in zip(starts, starts[1:]))
    for r in rows:
        out.update(ring.take(r[5:8], np.frombuffer(r[9], "<f8").reshape(3, *PATCH)))
        assert ring.planes.shape == (most, 3, 5, 6) and most < 12
    want = blended(deep["deep"], Three())[0]
    assert sorted(out) == list(range(60)) and ring.late == 0
    assert all(np.allclose(np.frombuffer(b, "<f8").reshape(3, 5, 6), want[:, z]) for z, b in out.items())
    late = [*rows[1:-1], rows[0], rows[-1]]  # the first patch comes when its planes have left
    ring, again = Ring((60, 5, 6), 3, plan), {}
    for r in late:
        again.update(ring.take(r[5:8], np.frombuffer(r[9], "<f8").reshape(3, *PATCH)))
    assert sorted(again) == list(range(60)) and ring.late == 1
    assert all(again[z] == out[z] for z in range(PATCH[0], 60)) and again[0] != out[0]


def test_stream_of_interleaved_volumes(spark, held, tmp_path):
    """Files of one step each, volumes mixed, every second pair of files swapped (a step late): all planes right."""
    plan = blocks.Patching(PATCH, 0.5, SIDE)
    rows = scored(plan, held)
    random.Random(1).shuffle(rows)
    steps = sorted({r[5] for r in rows})
    order = [s for i in range(0, len(steps), 2) for s in reversed(steps[i : i + 2])]
    for s in order:
        spark.createDataFrame([r for r in rows if r[5] == s], blocks.SCORED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(blocks.SCORED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = rolling_state(stream, plan)
    found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = blocks.unpack(spark.read.schema(found.schema).parquet(f"{tmp_path}/out"), (1, FLAT, FLAT)).collect()
    want = {n: blended(a, Three())[0] for n, a in held.items()}
    assert len(got) == sum(a.size for a in held.values())
    for r in got:
        assert np.allclose(r["ls"], want[r["volume_id"]][:, r["z"], r["y"], r["x"]], atol=1e-9)


# sums and quantiles


def test_binned_sums_do_not_depend_on_order(spark):
    rng = random.Random(4)
    values = [rng.choice([1e12, 1.0, 1e-9, 1e-20]) * rng.uniform(-1, 1) for _ in range(2000)]
    found = set()
    for parts in (1, 3, 8):
        df = spark.createDataFrame([(v,) for v in rng.sample(values, len(values))], "v double").repartition(parts)
        found.add(df.agg(*binned_sum(F.col("v"), "s")).select(total("s").alias("t")).first()["t"])
    assert len(found) == 1 and abs(found.pop() - sum(map(float, sorted(values, key=abs)))) < 1e-3
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double").agg(*binned_sum(F.col("v"), "s")).select(total("s").alias("t")).first()["t"]
    assert odd != odd


def test_strict_blend_holds_no_lists(spark, voxels):
    logits = tiling.patches(voxels.where("volume_id = 'large'"), SIZES["large"], PATCH, 0.5).withColumn("k", F.lit(0)).withColumnRenamed("v", "l")
    plan = B.strict_blend(logits, PATCH)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_sum" in plan
    d = B.covering_weight(SIZES["large"], PATCH, 0.5)
    sums = logits.withColumn("w", tiling.weight(PATCH)).groupBy("z", "y", "x").agg(F.sum("w").alias("w")).withColumn("d", d)
    assert sums.where(F.abs(F.col("w") - F.col("d")) > 1e-9).count() == 0


@pytest.mark.parametrize("few,bins", [(4096, 4096), (5, 64)])
def test_exact_quantiles(spark, monkeypatch, few, bins):
    from tesserae.functions import sums

    monkeypatch.setattr(sums, "FEW", few)
    monkeypatch.setattr(sums, "BINS", bins)
    rng = np.random.default_rng(6)
    groups = {"normal": rng.normal(size=400), "ties": rng.integers(0, 4, 300).astype(float), "one": np.array([3.5]), "wide": 10.0 ** rng.uniform(-300, 300, 200) * rng.choice([-1, 1], 200), "same": np.full(50, -2.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None), ("normal", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 1.0], ["a", "b", "c", "d"]).collect()}
    for g, vs in groups.items():
        assert np.allclose([got[g][c] for c in "abcd"], np.quantile(vs, [0, 0.1, 0.5, 1]), rtol=1e-9)
    assert exact_quantiles(df.where("false"), ["g"], "v", [0.5], ["a"]).count() == 0
