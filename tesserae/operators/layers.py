"""Network layers as joins and aggregates over feature rows (``volume_id, c, z, y, x, v``).

Every multiply is a joined row here, so these forms are for small networks and for
checking; :mod:`tesserae.operators.forward` runs the same layers on whole patches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import leaky_relu
from ..sources.volumes import AXES
from .tiling import Triple

BY = ("volume_id",)


def _conv_size(n: int, k: int, s: int) -> int:
    return (n + 2 * ((k - 1) // 2) - k) // s + 1


def conv_shape(shape: Triple, kernel: Triple, stride: Triple = (1, 1, 1)) -> Triple:
    return tuple(_conv_size(n, k, s) for n, k, s in zip(shape, kernel, stride))


def conv3d(features: DataFrame, weights: DataFrame, shape: Triple, kernel: Triple, stride: Triple = (1, 1, 1), bias: DataFrame | None = None, by: tuple[str, ...] = BY) -> DataFrame:
    """Cross-correlation with ``(k - 1) // 2`` zeros around.  ``weights``: ``o, i, dz, dy, dx, w``; ``bias``: ``o, b``.

    Each voxel meets its channel's weights (a broadcast of the layer's parameters) and goes
    to the places its products add to; sums combine before the shuffle.
    """
    size = conv_shape(shape, kernel, stride)
    rows = features.join(F.broadcast(weights), F.col("c") == F.col("i"))
    for a, k, s, n in zip(AXES, kernel, stride, size):
        at = F.col(a) + (k - 1) // 2 - F.col(f"d{a}")
        rows = rows.where((at >= 0) & (at % s == 0) & (at < n * s)).withColumn(f"_{a}", F.floor(at / s).cast("int"))
    out = rows.groupBy(*by, F.col("o").alias("c"), *[F.col(f"_{a}").alias(a) for a in AXES]).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return with_bias(out, bias)


def with_bias(features: DataFrame, bias: DataFrame | None) -> DataFrame:
    if bias is None:
        return features
    return features.join(F.broadcast(bias.withColumnRenamed("o", "c")), "c").withColumn("v", F.col("v") + F.col("b")).drop("b")


def instance_norm(features: DataFrame, by: tuple[str, ...] = BY, affine: DataFrame | None = None, eps: float = 1e-5) -> DataFrame:
    """Zero mean and unit variance per channel over space; ``affine``: ``c, gamma, beta``."""
    stats = features.groupBy(*by, "c").agg(F.avg("v").alias("_m"), F.var_pop("v").alias("_q"))
    rows = features.join(stats, [*by, "c"]).withColumn("v", (F.col("v") - F.col("_m")) / F.sqrt(F.col("_q") + eps)).drop("_m", "_q")
    if affine is None:
        return rows
    return rows.join(F.broadcast(affine), "c").withColumn("v", F.col("v") * F.col("gamma") + F.col("beta")).drop("gamma", "beta")


def activate(features: DataFrame, slope: float = 0.01) -> DataFrame:
    return features.withColumn("v", leaky_relu(F.col("v"), slope))


def conv_norm_act(features: DataFrame, weights: DataFrame, shape: Triple, kernel: Triple, stride: Triple = (1, 1, 1), bias: DataFrame | None = None, by: tuple[str, ...] = BY, norm: bool = True, act: bool = True) -> DataFrame:
    out = conv3d(features, weights, shape, kernel, stride, bias, by)
    out = instance_norm(out, by) if norm else out
    return activate(out) if act else out


def stacked(features: DataFrame, layers: list[DataFrame], shape: Triple, kernel: Triple, stride: Triple, by: tuple[str, ...] = BY) -> tuple[DataFrame, Triple]:
    """Several conv-norm-activation blocks, the first one strided."""
    for n, weights in enumerate(layers):
        step = stride if n == 0 else (1, 1, 1)
        features = conv_norm_act(features, weights, shape, kernel, step, by=by)
        shape = conv_shape(shape, kernel, step)
    return features, shape


def avg_pool(features: DataFrame, stride: Triple, shape: Triple, by: tuple[str, ...] = BY) -> DataFrame:
    """Means of non-overlapping boxes; incomplete ones at the end are left out."""
    inside = reduce(lambda a, b: a & b, [F.col(a) < n // s * s for a, n, s in zip(AXES, shape, stride)])
    return features.where(inside).groupBy(*by, "c", *[F.floor(F.col(a) / s).cast("int").alias(a) for a, s in zip(AXES, stride)]).agg(F.avg("v").alias("v"))


def add(left: DataFrame, right: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Cell by cell sum of two features of one shape."""
    return left.unionByName(right).groupBy(*by, "c", *AXES).agg(F.sum("v").alias("v"))


def residual(features: DataFrame, first: DataFrame, second: DataFrame, shape: Triple, kernel: Triple, stride: Triple = (1, 1, 1), project: DataFrame | None = None, by: tuple[str, ...] = BY) -> DataFrame:
    """Two convolutions and a skip, activated after the sum.  The skip is pooled where strided and projected where widths differ."""
    out = conv_norm_act(features, first, shape, kernel, stride, by=by)
    out = conv_norm_act(out, second, conv_shape(shape, kernel, stride), kernel, by=by, act=False)
    skip = features if stride == (1, 1, 1) else avg_pool(features, stride, shape, by)
    if project is not None:
        skip = conv_norm_act(skip, project, tuple(n // s for n, s in zip(shape, stride)), (1, 1, 1), by=by, act=False)
    return activate(add(out, skip, by))


def conv_transpose(features: DataFrame, weights: DataFrame, stride: Triple, bias: DataFrame | None = None, by: tuple[str, ...] = BY) -> DataFrame:
    """Upsampling with kernel and stride alike, so outputs never overlap: ``out[s z + d] = sum_i w[d, i] x[z, i]``."""
    rows = features.join(F.broadcast(weights), F.col("c") == F.col("i"))
    out = rows.groupBy(*by, F.col("o").alias("c"), *[(F.col(a) * s + F.col(f"d{a}")).alias(a) for a, s in zip(AXES, stride)]).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return with_bias(out, bias)


def concat(up: DataFrame, skip: DataFrame, channels: int) -> DataFrame:
    """Channels of ``up`` (so many), then those of ``skip``."""
    return up.unionByName(skip.withColumn("c", F.col("c") + channels))


def head(features: DataFrame, weights: DataFrame, bias: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Class scores ``k, l`` by a 1 x 1 x 1 convolution over channels; ``weights``: ``o, i, w``."""
    rows = features.join(F.broadcast(weights), F.col("c") == F.col("i")).groupBy(*by, F.col("o").alias("k"), *AXES).agg(F.sum(F.col("v") * F.col("w")).alias("l"))
    return rows.join(F.broadcast(bias.withColumnRenamed("o", "k")), "k").withColumn("l", F.col("l") + F.col("b")).drop("b")


def flip(features: DataFrame, axes: tuple[int, ...], shape: Triple) -> DataFrame:
    """The features mirrored along some axes."""
    return features.withColumns({AXES[i]: F.lit(shape[i] - 1) - F.col(AXES[i]) for i in axes})


def mirrored_mean(features: DataFrame, network, axes: list[tuple[int, ...]], shape: Triple, by: tuple[str, ...] = BY) -> DataFrame:
    """The mean over mirrored passes, each flipped back: ``network`` maps features to features.

    The passes are one more key of the rows, so the network runs once over all of them.
    """
    names = "+".join
    passes = reduce(DataFrame.unionByName, [flip(features, a, shape).withColumn("_pass", F.lit(names(map(str, a)))) for a in axes])
    out = network(passes, (*by, "_pass"))
    back = {a: F.when(F.contains(F.col("_pass"), F.lit(str(i))), F.lit(shape[i] - 1) - F.col(a)).otherwise(F.col(a)) for i, a in enumerate(AXES)}
    return out.withColumns(back).groupBy(*by, "c", *AXES).agg(F.avg("v").alias("v"))
