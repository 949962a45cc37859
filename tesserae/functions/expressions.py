"""Scalar expressions: clipping, norms, activations, weights, string keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def clip(v: Column, low: Column | float, high: Column | float) -> Column:
    """``v`` kept within the bounds; NaN stays NaN."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(F.isnan(v), v).otherwise(F.greatest(F.least(v, high), low))


def ct_norm(v: Column, mean: Column | float, std: Column | float, low: Column | float, high: Column | float) -> Column:
    """Clipped intensities in units of a given deviation, at least ``EPS``."""
    mean, std = (x if isinstance(x, Column) else F.lit(float(x)) for x in (mean, std))
    return (clip(v, low, high) - mean) / F.greatest(std, F.lit(EPS))


def leaky_relu(v: Column, slope: float = 0.01) -> Column:
    return F.when(v > 0, v).otherwise(v * slope)


def gaussian(coords: list[Column], tile: list[int], sigma_scale: float = 0.125, scale: float = 10.0) -> Column:
    """The importance of a place in a patch: a product of per-axis bells around ``tile // 2``."""
    terms = [(c - t // 2) * (c - t // 2) / F.lit(2.0 * (t * sigma_scale) ** 2) for c, t in zip(coords, tile)]
    return F.lit(scale) * F.exp(-reduce(lambda a, b: a + b, terms))


def step_count(image: Column, tile: int, step: float) -> Column:
    """How many patch positions an axis gets; none where the image is below the tile by a step or more."""
    target = max(1, int(tile * step))
    return F.greatest((F.ceil((image - tile) / F.lit(float(target))) + 1).cast("int"), F.lit(0))


def step_at(i: Column, n: Column, image: Column, tile: int) -> Column:
    """The i-th of n positions, evenly spread and rounded half to even."""
    gap = (image - tile).cast("double") / F.greatest(n - 1, F.lit(1))
    return F.when(n > 1, F.rint(gap * i)).otherwise(F.lit(0.0)).cast("int")


def steps(image: Column, tile: int, step: float) -> Column:
    """All positions of an axis as an array."""
    n = step_count(image, tile, step)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: step_at(i, n, image, tile))).otherwise(F.expr("array()").cast("array<int>"))


def covering(at: Column, image: Column, tile: int, step: float) -> Column:
    """Ordinals of the positions whose tile holds ``at``: a few candidates by arithmetic, then the exact test."""
    n = step_count(image, tile, step)
    gap = (image - tile).cast("double") / F.greatest(n - 1, F.lit(1))
    first = F.when((n > 1) & (gap > 0), F.greatest(F.floor((at - tile) / F.nullif(gap, F.lit(0.0))), F.lit(0))).otherwise(F.lit(0)).cast("int")
    last = F.when((n > 1) & (gap > 0), F.least(F.ceil(at / F.nullif(gap, F.lit(0.0))), n - 1)).otherwise(n - 1).cast("int")
    inside = lambda i: (step_at(i, n, image, tile) <= at) & (at < step_at(i, n, image, tile) + tile)
    return F.when(last >= first, F.filter(F.sequence(first, F.greatest(first, last)), inside)).otherwise(F.expr("array()").cast("array<int>"))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores, shifted by their greatest."""
    shifted = F.transform(F.array(F.array_max(scores)), lambda m: F.transform(scores, lambda s: F.exp(s - m)))[0]
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def top_two(scores: Column) -> Column:
    """Labels and scores of the two best of an array, lower labels first on ties; a lone class leaves label 0 and no score second."""
    ranked = F.array_sort(F.transform(scores, lambda s, k: F.struct((-s).alias("s"), k.alias("k"))))
    second = F.get(ranked, F.lit(1))
    return F.struct(
        ranked[0]["k"].alias("label1"),
        (-ranked[0]["s"]).alias("score1"),
        F.coalesce(second["k"], F.lit(0)).alias("label2"),
        F.coalesce(-second["s"], F.lit(float("-inf"))).alias("score2"),
    )


def kept_key(key: Column) -> Column:
    """Whether a stored tensor belongs to the network: no copies under module lists or the decoder's encoder."""
    return ~F.contains(key, F.lit(".all_modules.")) & ~F.startswith(key, F.lit("decoder.encoder."))


def remapped_key(key: Column) -> Column:
    """A stored key by the network's naming: the lone sub-index after a stage goes."""
    return F.regexp_replace(key, r"(^|\.)stages\.([0-9]+)\.0\.(convs|blocks)(?=\.|$)", "$1stages.$2.$3")


def fuzzy_key(key: Column) -> Column:
    """A key with numbered sub-modules by name: 0 the convolution, 1 the norm, 2 the activation."""
    for number, name in enumerate(("conv", "norm", "nonlin")):
        key = F.replace(key, F.lit(f".all_modules.{number}."), F.lit(f".{name}."))
    return key


def dropped_subindex(key: Column) -> Column:
    """An option apart from :func:`fuzzy_key`: also drop the ``0`` that follows a stage's number."""
    return F.regexp_replace(key, r"(^|\.)stages\.([0-9]+)\.0(?=\.|$)", "$1stages.$2")
