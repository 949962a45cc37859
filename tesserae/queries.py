"""One query per operator, over the driver's tables read as volumes.

* the *plane*: ``embeddings``, row by vector, 64 wide; * the *cube*: mean prices of
``lineitem`` by quantity, line number and discount; * *discounts*: a volume along one
axis with real zeros.  Floats are rounded to six digits so that sums taken in another
order agree.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine, ModelBundle
from .functions import expressions as X
from .functions.sums import exact_quantiles
from .operators import blend as B
from .operators import blocks, forward, layers, normalize, tiling, weights
from .plans import networks
from .sources import models, tensor_source, tensors, volumes
from .sources.scratch import folder, stored
from .streaming import rolling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PATCH = (32, 1, 32)  # of the plane
CUBE_PATCH = (16, 8, 16)  # larger than the cube along y and x
CUBE_BOX = (50, 8, 16)  # the cube padded to it
HEADS = ((0, 0.8, 0.1), (1, -0.5, 0.2), (2, 0.3, -0.1))  # class, weight, bias


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with a zero that has no sign."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.embeddings_plane(spark, sf_dir)


UNIT = 79193.0  # a prime: no mean of prices in this unit lies halfway between two rounded values
SHAPE = (50, 7, 11)
BOX = (50, 8, 12)  # the cube with even sides


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.lineitem_cube(spark, sf_dir).withColumn("v", F.col("v") / UNIT)


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.pad(cube(spark, sf_dir), SHAPE, BOX)[0]


def rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def cells(n_out: int, n_in: int, kernel: tuple[int, int, int], salt: int = 0) -> list[tuple]:
    """Weights of a layer by a formula: small, signed, different from place to place."""
    d, h, w = kernel
    return [(o, i, a, b, c, ((7 * o + 5 * i + 3 * a + 2 * b + c + salt) % 11 - 5) / 10) for o in range(n_out) for i in range(n_in) for a in range(d) for b in range(h) for c in range(w)]


def kernel(spark: SparkSession, *args, **kw) -> DataFrame:
    return rows(spark, cells(*args, **kw), "o int, i int, dz int, dy int, dx int, w double")


def biases(spark: SparkSession, n: int) -> DataFrame:
    return rows(spark, [(o, (o - 1) / 10) for o in range(n)], "o int, b double")


def patch_network(patched: DataFrame) -> DataFrame:
    """Instance norm within each patch, leaky activation, a head of three classes: one row a voxel and patch with the scores ``ls``."""
    normed = layers.instance_norm(patched, ("volume_id", "pid"))
    a = X.leaky_relu(F.col("v"))
    return normed.withColumn("ls", F.array(*[a * w + b for _, w, b in HEADS]))


def plane_scores(spark: SparkSession, sf_dir: str, shape: tuple[int, int, int] | None = None) -> DataFrame:
    image = plane(spark, sf_dir)
    return patch_network(tiling.patches(image, shape or volumes.shape_of(image), PATCH, 0.5))


def _blended_plane(spark: SparkSession, sf_dir: str, uniform: bool) -> DataFrame:
    shape = volumes.shape_of(plane(spark, sf_dir))
    return long(B.blend_arrays(plane_scores(spark, sf_dir, shape), 3, PATCH, uniform, shape))


def cube_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded, box = tiling.pad(normalize.ct(cube(spark, sf_dir), 0.6, 0.31, 0.01, 1.1), SHAPE, CUBE_PATCH)
    return patch_network(tiling.patches(padded, box, CUBE_PATCH, 0.5))


def long(blended: DataFrame) -> DataFrame:
    return blended.select("z", "y", "x", F.posexplode("ls").alias("k", "l")).select("z", "y", "x", "k", r("l").alias("l"))


# normalisation


@query
def ct_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.ct(cube(spark, sf_dir), 0.6, 0.31, 0.25, 1.0).select("z", "y", "x", r("v").alias("v"))


def discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = volumes.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_discount").alias("v"), F.col("l_quantity").alias("q"))
    return d.select(F.col("l_returnflag").alias("volume_id"), F.lit(0).alias("c"), "v", "q")


def _distribution(found: DataFrame) -> DataFrame:
    return found.groupBy("volume_id", r("v").alias("v")).agg(F.count("*").alias("n"))


@query
def zscore_foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distribution(normalize.zscore(discounts(spark, sf_dir)))


@query
def zscore_custom_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distribution(normalize.zscore(discounts(spark, sf_dir), mask=F.col("q") > 25))


@query
def zscore_empty_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distribution(normalize.zscore(discounts(spark, sf_dir), mask=F.col("q") < 0))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four channels of one image: order prices by month."""
    o = volumes.table(spark, sf_dir, "orders")
    return o.select(F.lit("orders").alias("volume_id"), (F.col("o_custkey") % 4).cast("int").alias("c"), F.col("o_orderkey").cast("int").alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x"), (F.col("o_totalprice") / 1000).alias("v"))


SCHEME_LIST = ["CTNormalization", "ZScoreNormalization", "NoNormalization"]
PARAMS = [(0, 100.0, 50.0, 10.0, 300.0), (3, 150.0, 61.7, 20.0, 280.0)]


def _params(spark: SparkSession) -> DataFrame:
    return rows(spark, PARAMS, "c int, mean double, std double, low double, high double")


@query
def normalize_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.dispatch(channels(spark, sf_dir), SCHEME_LIST, _params(spark)).select("c", "z", r("v").alias("v"))


@query
def normalize_engine_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.dispatch(channels(spark, sf_dir).withColumn("c", F.lit(0)), ["SomeOtherNormalization"], _params(spark), unknown="NoNormalization").select("c", "z", r("v").alias("v"))


# padding, patches, weights


@query
def pad_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.pad(cube(spark, sf_dir), SHAPE, CUBE_PATCH)[0].select("z", "y", "x", r("v").alias("v"))


@query
def crop_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded, _ = tiling.pad(cube(spark, sf_dir), SHAPE, CUBE_PATCH)
    return tiling.crop(padded, SHAPE, CUBE_PATCH).select("z", "y", "x", r("v").alias("v"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of axes and of tiles: orders of customers by number, 97 axes of like length."""
    n = (F.col("o_custkey") % 97).cast("int")
    return volumes.table(spark, sf_dir, "orders").groupBy(n.alias("axis")).agg(F.count("*").cast("int").alias("image")).withColumn("tile", (8 * (1 + F.col("axis") % 4)).cast("int"))


@query
def tile_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = images(spark, sf_dir)
    found = [sized.where(F.col("tile") == t).select("axis", "image", "tile", F.posexplode(X.steps(F.col("image"), t, 0.5)).alias("i", "s")) for t in (8, 16, 24, 32)]
    return reduce(DataFrame.unionByName, found)


@query
def tile_grid_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    extents = volumes.extents(tiling.pad(cube(spark, sf_dir), SHAPE, CUBE_PATCH)[0])
    return tiling.tile_grid(extents, CUBE_PATCH, 0.5).select("pid", "s0", "s1", "s2")


@query
def tile_step_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = tile_steps(spark, sf_dir)
    gap = steps.withColumn("gap", F.col("s") - F.lag("s").over(Window.partitionBy("axis", "tile").orderBy("i")))
    return gap.groupBy("axis", "tile").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("gap"), F.count("*").alias("n"))


@query
def patch_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = plane(spark, sf_dir)
    found = tiling.patches(image, volumes.shape_of(image), PATCH, 0.5)
    return found.groupBy("pid").agg(F.count("*").alias("n"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.min("x").alias("x0"), F.sum("d0").alias("d0"), F.sum("d2").alias("d2"), r(F.sum("v"), 5).alias("v"))


@query
def padding_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes by return flag and line number: whether each needs padding, and whether any or all of a flag's do."""
    rows = volumes.table(spark, sf_dir, "lineitem").where("l_quantity <= 8 * l_linenumber")
    name = F.concat_ws("/", "l_returnflag", F.col("l_linenumber").cast("string"))
    extents = rows.groupBy(name.alias("volume_id")).agg(F.max("l_quantity").cast("int").alias("n_z"), F.lit(8).alias("n_y"), F.max(F.rint(F.col("l_discount") * 100) + 1).cast("int").alias("n_x"))
    found = tiling.needs_padding(extents, (32, 8, 11)).withColumn("flag", F.substring("volume_id", 1, 1))
    return found.groupBy("flag").agg(F.bool_or("needs_padding").alias("some"), F.bool_and("needs_padding").alias("all"), F.count_if("needs_padding").alias("n"))


@query
def gaussian_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of every place of a patch, and how many voxels of the cube's patches lie there."""
    found = tiling.patches(tiling.pad(cube(spark, sf_dir), SHAPE, CUBE_PATCH)[0], CUBE_BOX, CUBE_PATCH, 0.5)
    return found.join(tiling.gaussian_map(spark, CUBE_PATCH, scale=10.0), ["d0", "d1", "d2"]).groupBy("d0", "d1", "d2", r("w", 9).alias("w")).agg(F.count("*").alias("n"))


@query
def gaussian_underflow_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as places of a patch so narrow that most weights underflow to the least one that does not."""
    weights_ = tiling.gaussian_map(spark, (50, 1, 1), sigma_scale=1 / 400)
    found = volumes.table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") - 1).alias("d0")).join(weights_, "d0")
    return found.groupBy(r(F.log("w"), 5).alias("log_w")).agg(F.count("*").alias("n"))


# blending


@query
def blend_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended_plane(spark, sf_dir, False)


@query
def blend_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended_plane(spark, sf_dir, True)


def _blended_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.crop(B.blend_arrays(cube_scores(spark, sf_dir), 3, CUBE_PATCH, shape=CUBE_BOX), SHAPE, CUBE_PATCH)


@query
def blend_3d_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(_blended_cube(spark, sf_dir))


def _long_scores(scores: DataFrame) -> DataFrame:
    return scores.select("volume_id", "pid", "z", "y", "x", "d0", "d1", "d2", F.posexplode("ls").alias("k", "l"))


@query
def blend_rolling_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rolling.rolling_batch(_long_scores(cube_scores(spark, sf_dir)), CUBE_PATCH)
    return tiling.crop(found, SHAPE, CUBE_PATCH).select("z", "y", "x", "k", r("l").alias("l"))


@query
def blend_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.strict_blend(_long_scores(cube_scores(spark, sf_dir)), CUBE_PATCH)
    return tiling.crop(found, SHAPE, CUBE_PATCH).select("z", "y", "x", "k", r("l").alias("l"))


@query
def blend_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling blend as a stream over a file of patch scores, closed by a row beyond the last plane."""
    base = folder(spark, "stream")
    scores = _long_scores(cube_scores(spark, sf_dir))
    scores.repartitionByRange(4, "z").write.parquet(f"{base}/in")
    rolling.closing_row(scores, 50, CUBE_PATCH).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(scores.schema).parquet(f"{base}/in")
    found = rolling.rolling_blend(stream, CUBE_PATCH)
    run = found.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{base}/out")
    return tiling.crop(out, SHAPE, CUBE_PATCH).select("z", "y", "x", "k", r("l").alias("l"))


def flag_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three volumes, one a return flag: mean prices by quantity, line number and discount, absent ones 0."""
    rows = volumes.table(spark, sf_dir, "lineitem")
    place = (F.col("l_quantity").cast("int") - 1).alias("z"), (F.col("l_linenumber") - 1).alias("y"), F.rint(F.col("l_discount") * 100).cast("int").alias("x")
    return rows.groupBy(F.col("l_returnflag").alias("volume_id"), *place).agg((F.avg("l_extendedprice") / UNIT).alias("v")).withColumn("c", F.lit(0))


@query
def blend_rolling_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three volumes whose patches come interleaved, a step of planes at a time, through a stream that holds a ring of planes each."""
    base, voxels = folder(spark, "rolling"), flag_cubes(spark, sf_dir)
    size = voxels.select("volume_id").distinct().select("volume_id", *[F.lit(n).alias(f"n_{a}") for a, n in zip(volumes.AXES, SHAPE)])
    plan = blocks.Patching(CUBE_PATCH, 0.5, CUBE_SIDE)
    scores = stored(blocks.scored(blocks.pack(voxels, size, CUBE_SIDE), plan, PatchNorm()), "scores")
    for low, high in ((-16, 10), (10, 20), (20, 50)):  # files in the order of their planes
        scores.where(f"s0 >= {low} AND s0 < {high}").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    found = rolling.rolling_state(stream, plan)
    run = found.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    planes = blocks.unpack(spark.read.schema(found.schema).parquet(f"{base}/out"), (1, rolling.FLAT, rolling.FLAT))
    return planes.select("volume_id", "z", "y", "x", F.posexplode("ls").alias("k", "l")).select("volume_id", "z", "y", "x", "k", r("l").alias("l"))


# mirrored passes


@query
def tta_axis_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every patch of the cube once a mirrored pass."""
    passes = rows(spark, [(n, "".join(map(str, a))) for n, a in enumerate(tiling.axis_subsets((0, 1, 2)))], "pass int, axes string")
    found = tiling.tile_grid(volumes.extents(tiling.pad(cube(spark, sf_dir), SHAPE, CUBE_PATCH)[0]), CUBE_PATCH, 0.5)
    return found.crossJoin(F.broadcast(passes)).select("pid", "pass", "axes")  # eight passes


def _lopsided(spark: SparkSession) -> DataFrame:
    return rows(spark, [(0, 0, 0, 0, n, w) for n, w in enumerate((1.0, 0.0, -2.0))], "o int, i int, dz int, dy int, dx int, w double")


@query
def tta_mirror_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _lopsided(spark)
    net = lambda f, by: layers.conv3d(f, w, SHAPE, (1, 1, 3), by=by)
    found = layers.mirrored_mean(cube(spark, sf_dir), net, tiling.axis_subsets((0, 2)), SHAPE)
    return found.select("z", "y", "x", r(F.col("v") / 7919).alias("v"))


# labels and probabilities


@query
def argmax_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    blended = B.blend_arrays(plane_scores(spark, sf_dir), 3, PATCH)
    found = B.argmax(blended.select("volume_id", "z", "y", "x", F.posexplode("ls").alias("k", "l")))
    return found.groupBy("z", "label").agg(F.count("*").alias("n"), r(F.sum("score"), 5).alias("score"))


@query
def segment_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.segment(plane_scores(spark, sf_dir), PATCH).select("z", "x", "label1", r("score1").alias("score1"), "label2", r("score2").alias("score2"))


@query
def segment_single_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = cube_scores(spark, sf_dir).withColumn("ls", F.slice("ls", 1, 1))
    found = B.segment(one, CUBE_PATCH)
    return found.groupBy("z", "label1", "label2", (F.col("score2") == float("-inf")).alias("no_second")).agg(F.count("*").alias("n"), r(F.sum("score1"), 4).alias("score1"))


@query
def segment_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(B.segment(plane_scores(spark, sf_dir), PATCH).select("x", "label1", (F.col("score1") - F.col("score2")).alias("m")), "margins")
    plain = found.groupBy("x").agg(F.count_distinct("label1").alias("labels"), r(F.avg("m"), 5).alias("mean"))
    ranked = exact_quantiles(found, ["x"], "m", [0.5, 0.1], ["median", "p10"])
    return plain.join(ranked, "x").select("x", "labels", "mean", r("median", 5).alias("median"), r("p10", 5).alias("p10"))


@query
def segment_vs_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = plane_scores(spark, sf_dir)
    seg = B.segment(scores, PATCH)
    best = B.argmax(B.blend_arrays(scores, 3, PATCH).select("volume_id", "z", "y", "x", F.posexplode("ls").alias("k", "l")))
    return seg.join(best, ["volume_id", "z", "y", "x"]).groupBy("label1", "label").agg(F.count("*").alias("n"))


@query
def softmax_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = _blended_cube(spark, sf_dir).select("volume_id", "z", "y", "x", F.posexplode("ls").alias("k", "l"))
    return B.softmax(logits).select("z", "y", "x", "k", r("p").alias("p"))


@query
def softmax_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _blended_cube(spark, sf_dir).withColumn("p", X.softmax(F.col("ls")))
    return found.select("z", "y", "x", F.posexplode("p").alias("k", "p")).select("z", "y", "x", "k", r("p").alias("p"))


# layers


def cells_of(features: DataFrame) -> DataFrame:
    return features.select("c", "z", "y", "x", r("v").alias("v"))


@query
def conv3d_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(layers.conv3d(cube(spark, sf_dir), kernel(spark, 2, 1, (3, 3, 3)), SHAPE, (3, 3, 3), bias=biases(spark, 2)))


@query
def conv3d_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(layers.conv3d(box(spark, sf_dir), kernel(spark, 2, 1, (3, 3, 3)), BOX, (3, 3, 3), (2, 2, 2), biases(spark, 2)))


@query
def instance_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    affine = rows(spark, [(0, 1.5, -0.25)], "c int, gamma double, beta double")
    return cells_of(layers.instance_norm(cube(spark, sf_dir), affine=affine))


@query
def leaky_relu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.activate(plane(spark, sf_dir)).groupBy("z").agg(r(F.sum("v"), 5).alias("v"), F.count_if(F.col("v") < 0).alias("below"))


@query
def conv_norm_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(layers.conv_norm_act(cube(spark, sf_dir), kernel(spark, 2, 1, (3, 3, 3)), SHAPE, (3, 3, 3), bias=biases(spark, 2)))


@query
def stacked_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(layers.stacked(box(spark, sf_dir), [kernel(spark, 2, 1, (3, 3, 3)), kernel(spark, 2, 2, (3, 3, 3), 3)], BOX, (3, 3, 3), (2, 2, 2))[0])


@query
def avg_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(layers.avg_pool(cube(spark, sf_dir), (2, 2, 2), SHAPE))


@query
def residual_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layers.residual(box(spark, sf_dir), kernel(spark, 2, 1, (3, 3, 3)), kernel(spark, 2, 2, (3, 3, 3), 3), BOX, (3, 3, 3), (2, 2, 2), kernel(spark, 2, 1, (1, 1, 1), 4))
    return cells_of(found)


@query
def conv_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(layers.conv_transpose(cube(spark, sf_dir), kernel(spark, 2, 1, (2, 2, 2)), (2, 2, 2), biases(spark, 2)))


@query
def skip_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = layers.conv3d(cube(spark, sf_dir), kernel(spark, 2, 1, (1, 1, 1)), SHAPE, (1, 1, 1))
    return cells_of(layers.concat(up, cube(spark, sf_dir), 2))


def _head(spark: SparkSession, features: DataFrame, channels: int) -> DataFrame:
    w = rows(spark, [(o, i, ((3 * o + 2 * i) % 7 - 3) / 10) for o in range(3) for i in range(channels)], "o int, i int, w double")
    return layers.head(features, w, biases(spark, 3))


@query
def seg_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = layers.conv3d(cube(spark, sf_dir), kernel(spark, 2, 1, (1, 1, 1)), SHAPE, (1, 1, 1))
    return _head(spark, two, 2).select("k", "z", "y", "x", r("l").alias("l"))


def nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network a part, described by its size."""
    size = F.col("p_size")
    return volumes.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model"), (size % 4 + 2).alias("n"), (8 * (size % 3 + 1)).alias("base"), (16 * (size % 5 + 2)).alias("most"), size.alias("classes"))


@query
def deep_supervision_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of every network, the finest first."""
    heads = networks.layer_rows(networks.dealt(nets(spark, sf_dir)), kinds=("head",)).select("model", F.regexp_extract("key", r"\.(\d+)\.weight$", 1).cast("int").alias("stage"), F.col("shape")[1].alias("width"))
    order = F.reverse(F.array_sort(F.collect_list(F.struct("stage", "width"))))
    return heads.groupBy("model").agg(order.alias("hs")).select("model", F.posexplode("hs").alias("place", "h")).select("model", "place", "h.stage", "h.width")


def _unet(spark: SparkSession, features: DataFrame, residual: bool) -> DataFrame:
    k = (3, 3, 3)
    half = tuple(n // 2 for n in BOX)
    if residual:
        x = stored(layers.conv_norm_act(features, kernel(spark, 2, 1, k), BOX, k), "stem")
        skip = stored(layers.residual(x, kernel(spark, 2, 2, k, 1), kernel(spark, 2, 2, k, 2), BOX, k), "skip")
        low = layers.residual(skip, kernel(spark, 3, 2, k, 3), kernel(spark, 3, 3, k, 4), BOX, k, (2, 2, 2), kernel(spark, 3, 2, (1, 1, 1), 5))
    else:
        skip = stored(layers.conv_norm_act(features, kernel(spark, 2, 1, k), BOX, k), "skip")
        low = layers.conv_norm_act(skip, kernel(spark, 3, 2, k, 3), BOX, k, (2, 2, 2))
    assert layers.conv_shape(BOX, k, (2, 2, 2)) == half
    up = layers.conv_transpose(stored(low, "low"), kernel(spark, 2, 3, (2, 2, 2), 6), (2, 2, 2))
    out = layers.conv_norm_act(layers.concat(up, skip, 2), kernel(spark, 2, 4, k, 7), BOX, k)
    return _head(spark, out, 2).select("k", "z", "y", "x", r("l", 5).alias("l"))


@query
def tiny_unet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unet(spark, box(spark, sf_dir), False)


@query
def tiny_resenc_unet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unet(spark, box(spark, sf_dir), True)


# descriptions and stored tensors


@query
def stage_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nets(spark, sf_dir).select("model", F.posexplode(networks.stage_features_column(F.col("n"), F.col("base"), F.col("most"))).alias("stage", "width"))


@query
def network_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tensors of each kind every network has, and their parameters."""
    sums = networks.layer_sums(networks.dealt(nets(spark, sf_dir)))
    return sums.groupBy("model", "kind").agg(F.sum("tensors").alias("tensors"), F.sum("parameters").alias("parameters"))


@query
def param_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.layer_sums(networks.dealt(nets(spark, sf_dir))).groupBy("model").agg(F.sum("parameters").alias("parameters"))


@query
def plan_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions in JSON, one a part, with more or fewer keys."""
    size = F.col("p_size")
    kinds = ("{}", '{"class_name": "ResidualEncoderUNet", "base": %d, "conv_bias": false}', '{"nonlin_kwargs": {"inplace": true, "negative_slope": 0.25}, "most": %d}', '{"nonlin_kwargs": {"inplace": true}}')
    text = F.element_at(F.array(*[F.format_string(k, size) if "%" in k else F.lit(k) for k in kinds]), (size % 4 + 1).cast("int"))
    return networks.defaulted(volumes.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("json"))).drop("json")


#: By turns, the name and shape of a vector of 64 as a tensor.
FORMS = (("enc.conv", "weight", [2, 2, 2, 2, 4]), ("dec.transpconvs.0", "weight", [4, 2, 2, 2, 2]), ("enc.norm", "weight", [64]), ("dec.ConvTranspose", "weight", [2, 4, 2, 2, 2]), ("enc.wide", "bias", [2, 1, 4, 4, 2]))


def stored_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of ``embeddings`` as stored tensors."""
    v = volumes.table(spark, sf_dir, "embeddings")
    turn = (F.col("vec_id") % len(FORMS) + 1).cast("int")
    key = F.concat(F.element_at(F.array(*[F.lit(a) for a, _, _ in FORMS]), turn), F.lit(".v"), F.col("vec_id").cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(b) for _, b, _ in FORMS]), turn))
    shape = F.element_at(F.array(*[F.array(*[F.lit(n) for n in c]) for _, _, c in FORMS]), turn)
    return v.select(key.alias("key"), shape.alias("shape"), F.col("embedding").alias("data"), "label")


@query
def weight_layout_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weights.transposed(stored_tensors(spark, sf_dir))
    return found.select("key", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), F.posexplode("data").alias("j", "w")).withColumn("w", F.col("w").cast("double"))


#: By turns, the key of a part; its size stands for the marks.
TEMPLATES = (
    "encoder.stages.%d.0.convs.1.conv.weight", "decoder.stages.%d.convs.0.conv.weight", "x%d.all_modules.0.weight", "decoder.encoder.stages.%d.w", "encoder.stages.%d.0.foo.weight",
    "encoder.stages.%d.0.blocks.0.conv1.conv.weight", "encoder.stages.%d.0.convs", "decoder.transpconvs.%d.weight", "net.stages.%d.0.convs.0.all_modules.1.bias", "stages.%d.0.blocks.1.norm.weight",
)


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.element_at(F.array(*[F.format_string(t, F.col("p_size")) for t in TEMPLATES]), (F.col("p_partkey") % len(TEMPLATES) + 1).cast("int"))
    return volumes.table(spark, sf_dir, "part").select("p_partkey", key.alias("key"))


@query
def weight_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).where(X.kept_key(F.col("key")))


@query
def weight_key_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = rows(spark, [("decoder.transpconvs.7.weight", "decoder.up.7.weight")], "key string, mapped string")
    return weights.renamed(_keys(spark, sf_dir), given).select("p_partkey", "key")


@query
def weight_key_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).select("p_partkey", "key", X.fuzzy_key(F.col("key")).alias("fuzzy"), X.dropped_subindex(F.col("key")).alias("dropped"))


@query
def weight_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known are the rewritten keys of the parts of small size."""
    keys = _keys(spark, sf_dir)
    known = keys.join(volumes.table(spark, sf_dir, "part").where("p_size <= 20").select("p_partkey"), "p_partkey").select(X.fuzzy_key(F.col("key")).alias("key"))
    mapped, unmapped = weights.fuzzy_matched(keys, known)
    return mapped.select("p_partkey", "key", F.lit(True).alias("mapped")).unionByName(unmapped.select("p_partkey", "key", F.lit(False).alias("mapped")))


@query
def weight_unmapped_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five keys a message about unmatched tensors would name."""
    keys = _keys(spark, sf_dir)
    known = keys.join(volumes.table(spark, sf_dir, "part").where("p_size <= 20").select("p_partkey"), "p_partkey").select(X.fuzzy_key(F.col("key")).alias("key"))
    return weights.first_unmapped(weights.fuzzy_matched(keys, known)[1])


@query
def pending_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of parts without a converted file; some parts have both."""
    path = F.concat(F.lit("m/fold_"), F.col("p_partkey").cast("string"), F.lit("/checkpoint_"), F.when(F.col("p_size") % 2 == 0, F.lit("final")).otherwise(F.lit("best")))
    parts = volumes.table(spark, sf_dir, "part")
    sources = parts.where("p_size % 5 <> 0").select(F.concat(path, F.lit(".pth")).alias("path"))
    done = parts.where("p_size % 3 = 0").select(F.concat(path, F.lit(".safetensors")).alias("path"))
    return weights.pending(sources.unionByName(done), done)


@query
def first_sorted_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.first_sorted(volumes.table(spark, sf_dir, "part").where(F.col("p_brand").rlike("^Brand#[1-3]")).select(F.concat_ws("/", "p_brand", "p_name").alias("path")))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch a part: its sides and classes follow from the part's size."""
    size = F.col("p_size")
    patch = F.array(32 * (size % 4 + 1), 16 * (size % 5 + 4), 16 * (size % 7 + 4))
    return volumes.table(spark, sf_dir, "part").select("p_partkey", patch.alias("patch"), size.alias("classes"))


@query
def activation_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = F.array(*[F.lit(f) for f in networks.stage_features(6)])
    return _shapes(spark, sf_dir).select("p_partkey", networks.activation_bytes(F.col("patch"), widths).alias("bytes"))


MEMORY = (8 * 2.0**30, 12.7 * 2.0**30, 72 * 2.0**30)


@query
def batch_size_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _shapes(spark, sf_dir).withColumn("memory", F.explode(F.array(*[F.lit(m) for m in MEMORY])))
    return sized.select("p_partkey", "memory", networks.batch_size(F.col("patch"), F.col("classes"), F.col("memory")).alias("batch"))


# whole patches in Arrow, files


class PatchNorm:
    """The network of :func:`patch_network` on a whole patch."""

    def __call__(self, box):
        a = forward.leaky(forward.normed(box))[0]
        return np.stack([a * w + b for _, w, b in HEADS])


SIDE = (64, 1, 32)  # of the plane's blocks
CUBE_SIDE = (16, 7, 6)


def plane_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = volumes.table(spark, sf_dir, "embeddings")
    count = int((vectors.agg(F.max("vec_id")).first()[0] or 0) + 1)
    return blocks.pack_arrays(vectors, count, 64, "vec_id", "embedding", SIDE)


def cube_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels = normalize.ct(cube(spark, sf_dir), 0.6, 0.31, 0.01, 1.1)
    return blocks.pack(voxels, volumes.extents(voxels), CUBE_SIDE)


@query
def predict_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.predicted(plane_blocks(spark, sf_dir), blocks.Patching(PATCH, 0.5, SIDE, batch=4), PatchNorm(), 3)
    return long(blocks.unpack(found, SIDE))


@query
def block_blend_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.predicted(plane_blocks(spark, sf_dir), blocks.Patching(PATCH, 0.5, SIDE, uniform=True), PatchNorm(), 3)
    return long(blocks.unpack(found, SIDE))


@query
def block_blend_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.predicted(cube_blocks(spark, sf_dir), blocks.Patching(CUBE_PATCH, 0.5, CUBE_SIDE, batch=3), PatchNorm(), 3)
    return long(blocks.unpack(found, CUBE_SIDE))


@query
def block_patch_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every patch cut from blocks, opened again to count its voxels and sum them."""
    found = blocks.extracted(plane_blocks(spark, sf_dir), blocks.Patching(PATCH, 0.5, SIDE))
    values = forward.doubles(found, "data", "vs")
    return values.select("pid", F.size("vs").cast("long").alias("n"), F.col("s0").alias("z0"), (F.col("s0") + PATCH[0] - 1).alias("z1"), F.col("s2").alias("x0"), r(F.aggregate("vs", F.lit(0.0), lambda a, x: a + x), 5).alias("v"))


@query
def block_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.unpack_segments(blocks.segmented(plane_blocks(spark, sf_dir), blocks.Patching(PATCH, 0.5, SIDE, batch=4), PatchNorm()), SIDE)
    return found.select("z", "x", "label1", r("score1").alias("score1"), "label2", r("score2").alias("score2"))


BIG = (128, 128, 128)
BIG_PATCH = (64, 64, 64)


@query
def block_large_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices spread over 128 x 128 x 128 places, 27 patches of 64 a side: class scores by plane and row."""
    rows = volumes.table(spark, sf_dir, "lineitem")
    place = [(F.col(c) % n).cast("int").alias(a) for c, n, a in zip(("l_orderkey", "l_partkey", "l_suppkey"), BIG, volumes.AXES)]
    voxels = rows.groupBy(*place).agg((F.sum("l_extendedprice") / UNIT).alias("v")).select(F.lit("big").alias("volume_id"), F.lit(0).alias("c"), *volumes.AXES, "v")
    size = spark.range(1).select(F.lit("big").alias("volume_id"), *[F.lit(n).alias(f"n_{a}") for a, n in zip(volumes.AXES, BIG)])
    packed = blocks.pack(voxels, size, (32, 32, 32))
    found = blocks.predicted(packed, blocks.Patching(BIG_PATCH, 0.5, (32, 32, 32), batch=2, spread=(2, 2, 2)), PatchNorm(), 3)
    cells = blocks.unpack(found, (32, 32, 32)).groupBy("z", "y").agg(*[F.avg(F.get("ls", F.lit(k))).alias(f"l{k}") for k in range(3)])
    return cells.select("z", "y", *[r(f"l{k}", 5).alias(f"l{k}") for k in range(3)])


def kernel_array(n_out: int, n_in: int, kernel: tuple[int, int, int], salt: int = 0) -> np.ndarray:
    """The weights of :func:`cells` as ``O kd kh kw C``."""
    out = np.zeros((n_out, *kernel, n_in))
    for o, i, a, b, c, w in cells(n_out, n_in, kernel, salt):
        out[o, a, b, c, i] = w
    return out


BIAS = np.array([-0.1, 0.0, 0.1])


def _cells_of_blocks(found: DataFrame, side: tuple[int, int, int]) -> DataFrame:
    return blocks.unpack(found, side).select("z", "y", "x", F.posexplode("ls").alias("c", "v")).select("c", "z", "y", "x", r("v").alias("v"))


@query
def block_conv3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = cube(spark, sf_dir)
    packed = blocks.pack(whole, volumes.extents(whole), CUBE_SIDE)
    return _cells_of_blocks(blocks.conv3d(packed, kernel_array(2, 1, (3, 3, 3)), CUBE_SIDE, bias=BIAS[:2]), CUBE_SIDE)


@query
def block_conv3d_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = box(spark, sf_dir)
    packed = blocks.pack(padded, volumes.extents(padded), CUBE_SIDE)
    return _cells_of_blocks(blocks.conv3d(packed, kernel_array(2, 1, (3, 3, 3)), CUBE_SIDE, (2, 2, 2), BIAS[:2]), CUBE_SIDE)


UNET_SIDE = (16, 4, 6)  # a block of the lower stage is half as long


def _block_unet(spark: SparkSession, sf_dir: str, residual: bool) -> DataFrame:
    """The small networks of :func:`_unet`, layer by layer on blocks."""
    side, half, k = UNET_SIDE, tuple(n // 2 for n in UNET_SIDE), (3, 3, 3)
    padded = box(spark, sf_dir)
    x = blocks.pack(padded, volumes.extents(padded), side)
    if residual:
        x = stored(blocks.norm_act(blocks.conv3d(x, kernel_array(2, 1, k), side), side), "stem")
        skip = stored(blocks.residual(x, kernel_array(2, 2, k, 1), kernel_array(2, 2, k, 2), side), "skip")
        low = blocks.residual(skip, kernel_array(3, 2, k, 3), kernel_array(3, 3, k, 4), side, (2, 2, 2), kernel_array(3, 2, (1, 1, 1), 5))
    else:
        skip = stored(blocks.norm_act(blocks.conv3d(x, kernel_array(2, 1, k), side), side), "skip")
        low = blocks.norm_act(blocks.conv3d(skip, kernel_array(3, 2, k, 3), side, (2, 2, 2), sides=half), half)
    up = blocks.conv_up(low, kernel_array(2, 3, (2, 2, 2), 6), half)
    out = blocks.norm_act(blocks.conv3d(blocks.concat(up, skip), kernel_array(2, 4, k, 7), side), side)
    w = np.array([[((3 * o + 2 * i) % 7 - 3) / 10 for i in range(2)] for o in range(3)])
    scores = blocks.unpack(blocks.head(out, w, BIAS, side), side)
    return scores.select("z", "y", "x", F.posexplode("ls").alias("k", "l")).select("k", "z", "y", "x", r("l", 5).alias("l"))


@query
def block_tiny_unet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_unet(spark, sf_dir, False)


@query
def block_tiny_resenc_unet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_unet(spark, sf_dir, True)


@query
def block_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded, side = box(spark, sf_dir), UNET_SIDE
    x = blocks.pack(padded, volumes.extents(padded), side)
    found = blocks.residual(x, kernel_array(2, 1, (3, 3, 3)), kernel_array(2, 2, (3, 3, 3), 3), side, (2, 2, 2), kernel_array(2, 1, (1, 1, 1), 4))
    return _cells_of_blocks(found, tuple(n // 2 for n in side))


@query
def block_avg_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, side = cube(spark, sf_dir), UNET_SIDE
    found = blocks.avg_pool(blocks.pack(whole, volumes.extents(whole), side), side, (2, 2, 2))
    return _cells_of_blocks(found, tuple(n // 2 for n in side))


@query
def safetensors_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a label, written and read again."""
    base = folder(spark, "tensors")
    path = F.concat(F.lit(f"{base}/"), F.coalesce(F.col("label").cast("string"), F.lit("none")), F.lit(".safetensors"))
    tensors.write_safetensors(stored_tensors(spark, sf_dir).withColumn("path", path))
    found = tensors.read_safetensors(spark, f"{base}/*.safetensors")
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    return found.select(F.regexp_extract("path", r"(\w+)\.safetensors$", 1).alias("label"), "key", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), F.size("data").alias("n"), r(total, 5).alias("total"))


@query
def tensor_source_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors written by the data source and read again by the beginning of their keys, which the files' headers tell."""
    tensor_source.register(spark)
    path = folder(spark, "tensors")
    stored_tensors(spark, sf_dir).select(F.lit("").alias("path"), "key", "shape", "data").write.format("tensors").mode("append").save(path)
    found = spark.read.format("tensors").load(path).where(F.startswith("key", F.lit("enc.norm.")))
    return found.select("key", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), F.posexplode("data").alias("j", "w")).withColumn("w", F.col("w").cast("double"))


# models in folders, and the engine over them

PLANS = {
    "configurations": {
        "3d_fullres": {
            "patch_size": list(CUBE_PATCH), "normalization_schemes": ["ZScoreNormalization"], "pool_op_kernel_sizes": [[1, 1, 1], [2, 2, 2]], "conv_kernel_sizes": [[3, 3, 3]] * 2,
            "n_conv_per_stage_encoder": [1, 1], "n_conv_per_stage_decoder": [1], "UNet_base_num_features": 2, "unet_max_num_features": 3,
        }
    },
    "foreground_intensity_properties_per_channel": {"0": {"mean": 0.5, "std": 0.25, "percentile_00_5": 0.125, "percentile_99_5": 0.875}, "2": {"mean": 3.0, "std": 0.5, "percentile_00_5": -1.0, "percentile_99_5": 9.0}},
}
DATASET = {"labels": {"background": 0, "one": 1, "two": 2}, "channel_names": {"0": "price"}}


def _tensor_rows(spark: SparkSession, arch: networks.Architecture) -> DataFrame:
    """Every parameter of a network by a formula of its place and its key's length, exact in 32 bits."""
    n = F.aggregate("shape", F.lit(1), lambda a, x: a * x)
    value = lambda j: (((7 * j + 3 * F.length("key")) % 11 - 5) / 16).cast("float")
    return arch.layer_table(spark).select("key", "shape", F.transform(F.sequence(F.lit(0), n - 1), value).alias("data"))


def _model_store(spark: SparkSession) -> str:
    """A store of three models: one converted, one whose first fold is not, one without a description."""
    root = folder(spark, "models")
    texts = [(f"{root}/{d}/{t}/{n}.json", json.dumps(x)) for d, t in (("Dataset007_demo", "Trainer__plans__3d"), ("Dataset12_other", "A__plans__3d")) for n, x in (("plans", PLANS), ("dataset", DATASET))]
    texts += [(f"{root}/Dataset007_demo/Zero__plans__3d/readme.txt", "later in the order"), (f"{root}/Dataset099_bare/T__plans__3d/fold_0/checkpoint_final.pth", "a pickle"), (f"{root}/Dataset12_other/A__plans__3d/fold_1/checkpoint_best.pth", "a pickle")]
    tensors.write_text(rows(spark, texts, "path string, text string"))
    models.store(_tensor_rows(spark, networks.from_plans(PLANS, 1, 3)), f"{root}/Dataset007_demo/Trainer__plans__3d")
    return root


def _engine(spark: SparkSession) -> Engine:
    return Engine(ModelBundle.from_task(spark, 7, root=_model_store(spark)))


@query
def engine_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark).predict(cube(spark, sf_dir)).select("z", "y", "x", "k", r("l", 5).alias("l"))


@query
def engine_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine(spark).segment(cube(spark, sf_dir))
    return found.select("z", "y", "x", "label1", r("score1", 5).alias("score1"), "label2", r("score2", 5).alias("score2"))


@query
def engine_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of several shapes at once: the cube, a part of it along each axis, and one plane; each normalised, tiled and cropped by itself."""
    whole = cube(spark, sf_dir)
    parts = {"whole": "true", "long": "y < 2", "flat": "z < 5", "plane": "z < 1 AND x < 4"}
    several = reduce(DataFrame.unionByName, [whole.where(w).withColumn("volume_id", F.lit(n)) for n, w in parts.items()])
    found = _engine(spark).predict(several)
    return found.select("volume_id", "z", "y", "x", "k", r("l", 5).alias("l"))


@query
def engine_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark).normalize(cube(spark, sf_dir)).select("z", "y", "x", r("v").alias("v"))


@query
def intensity_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters a channel as a description lists them, from the prices of orders."""
    per = channels(spark, sf_dir).groupBy("c").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("percentile_00_5"), F.max("v").alias("percentile_99_5"))
    entry = F.struct(F.col("c").cast("string"), F.struct("mean", "std", "percentile_00_5", "percentile_99_5"))
    listed = per.agg(F.map_from_entries(F.collect_list(entry)).alias("foreground_intensity_properties_per_channel"))  # four channels
    found = normalize.intensity_params(listed)
    return found.select("c", *[r(n).alias(n) for n in ("mean", "std", "low", "high")])


def _below(path: Column) -> Column:
    """A path below the store, without the file system's part."""
    return F.regexp_replace(path, "^.*/(models|convert)-[0-9a-f]*/", "")


def nation_store(spark: SparkSession, sf_dir: str) -> str:
    """A store with a data set a nation, whose trainer folder is named by the region; some nations have two, some no description."""
    root = folder(spark, "models")
    n = volumes.table(spark, sf_dir, "nation").join(volumes.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    base = F.concat(F.lit(f"{root}/"), F.format_string("Dataset%03d_%s", "n_nationkey", F.replace("n_name", F.lit(" "), F.lit("_"))))
    trainer = F.concat(base, F.lit("/"), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("__plans__3d"))
    first = n.where("n_nationkey % 4 <> 3").select(F.concat(trainer, F.lit("/plans.json")).alias("path"), F.lit("{}").alias("text"))
    bare = n.where("n_nationkey % 4 = 3").select(F.concat(trainer, F.lit("/fold_0/checkpoint_final.pth")).alias("path"), F.lit("a pickle").alias("text"))
    second = n.where("n_nationkey % 3 = 0").select(F.concat(base, F.lit("/AAA__plans__3d/readme.txt")).alias("path"), F.lit("earlier in the order").alias("text"))
    tensors.write_text(first.unionByName(bare).unionByName(second))
    return root


@query
def model_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each nation's number resolves to: its first trainer folder, and the first one with a description."""
    root, found = nation_store(spark, sf_dir), []
    for (number,) in volumes.table(spark, sf_dir, "nation").select("n_nationkey").collect():  # a data set each, 25
        path = models.model_folder(spark, number, root)
        try:
            described = models.trainer_folder(spark, path.rsplit("/", 1)[0])
        except FileNotFoundError:
            described = None
        found.append((number, path, described))
    return rows(spark, found, "task int, path string, described string").select("task", _below(F.col("path")).alias("path"), _below(F.col("described")).alias("described"))


def _folds(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A trainer folder whose folds hold the tensors of a label each, as tables."""
    root = folder(spark, "convert")
    path = f"{root}/Dataset007_demo/T__plans__3d"
    given = stored_tensors(spark, sf_dir).where("label IS NOT NULL")
    for (label,) in given.select("label").distinct().collect():  # ten labels
        given.where(F.col("label") == label).drop("label").write.parquet(f"{path}/fold_{label}/checkpoint_final.parquet")
    return root, path


@query
def convert_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written on a first run, on a second one, and by force; then the tensors and values of all files."""
    root, path = _folds(spark, sf_dir)
    counts = [models.convert_folder(spark, root, force) for force in (False, False, True)]
    found = tensors.read_safetensors(spark, f"{path}/fold_*/*.safetensors")
    total = F.sum(F.aggregate("data", F.lit(0.0), lambda a, x: a + x))
    return found.agg(F.count("*").alias("tensors"), r(total, 4).alias("total")).select(*[F.lit(c).alias(n) for c, n in zip(counts, ("first", "second", "forced"))], "tensors", "total")


@query
def checkpoint_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensors of each fold's checkpoint, one fold a label; an odd fold has only a pickle, which is not opened, and says so."""
    root, path = _folds(spark, sf_dir)
    labels = sorted(int(p.rsplit("_", 1)[1]) for p in models.listed(spark, f"{path}/fold_*"))
    for fold in labels:
        if fold % 2 == 0:
            models.store(spark.read.parquet(f"{path}/fold_{fold}/checkpoint_final.parquet"), path, fold)
    tensors.write_text(rows(spark, [(f"{path}/fold_{f}/checkpoint_final.pth", "a pickle") for f in labels], "path string, text string"))
    found = None
    for fold in [*labels, 1 + max(labels)]:
        try:
            n = models.load_weights(spark, path, fold).agg(F.count("*").alias("n"), F.sum(F.size("data")).alias("size"))
            row = n.select(F.lit(fold).alias("fold"), F.lit("loaded").alias("state"), "n", "size")
        except (ValueError, FileNotFoundError) as e:
            state = "pickle" if isinstance(e, ValueError) else "missing"
            row = rows(spark, [(fold, state, 0, 0)], "fold int, state string, n bigint, size bigint")
        found = row if found is None else found.unionByName(row)
    return found


def queries() -> dict[str, Query]:
    return dict(QUERIES)

