"""Overlapping patch results put together: weighted mean, labels, confidences, probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import covering, gaussian, step_at, step_count, top_two
from ..functions.sums import binned_sum, total
from ..sources.volumes import AXES
from .tiling import Triple, weight

PLACE = ("volume_id", *AXES)


def blend(logits: DataFrame, patch: Triple, uniform: bool = False) -> DataFrame:
    """The weighted mean of each voxel and class over patches; sums combine before the shuffle."""
    w = weight(patch, uniform)
    sums = logits.withColumn("_w", w).groupBy(*PLACE, "k").agg(F.sum(F.col("_w") * F.col("l")).alias("_n"), F.sum("_w").alias("_d"))
    return sums.select(*PLACE, "k", F.try_divide("_n", "_d").alias("l"))


def covering_weight(shape: Triple | list[Column], patch: Triple, step: float, uniform: bool = False, scale: float = 10.0) -> Column:
    """The sum of weights over the patches that cover a voxel: a product of three sums along the axes, each over the few positions by its coordinate."""

    def along(a: str, n: int | Column, p: int) -> Column:
        size = n if isinstance(n, Column) else F.lit(n)
        count = step_count(size, p, step)
        bell = lambda i: F.lit(1.0) if uniform else gaussian([F.col(a) - step_at(i, count, size, p)], [p], scale=1.0)
        return F.aggregate(covering(F.col(a), size, p, step), F.lit(0.0), lambda so_far, i: so_far + bell(i))

    terms = [along(*x) for x in zip(AXES, shape, patch)]
    return F.lit(1.0 if uniform else scale) * terms[0] * terms[1] * terms[2]


def blend_arrays(scores: DataFrame, classes: int, patch: Triple, uniform: bool = False, shape: Triple | list[Column] | None = None, step: float = 0.5) -> DataFrame:
    """:func:`blend` for rows that hold all classes in an array ``ls``: one shuffled row a voxel and task instead of one a class.

    With the ``shape`` that was cut into patches, the weights are not summed: their sum follows from the voxel's place.
    """
    weighted = scores.withColumn("_w", weight(patch, uniform))
    sums = [F.sum(F.col("_w") * F.get("ls", F.lit(k))).alias(f"_n{k}") for k in range(classes)]
    d = F.col("_d")
    if shape is None:
        rows = weighted.groupBy(*PLACE).agg(F.sum("_w").alias("_d"), *sums)
    elif any(isinstance(n, Column) for n in shape):
        rows = weighted.groupBy(*PLACE).agg(*sums).withColumn("_d", covering_weight(shape, patch, step, uniform))
    else:  # three short tables, a row a place of an axis
        rows = weighted.groupBy(*PLACE).agg(*sums)
        for k, (a, n, p) in enumerate(zip(AXES, shape, patch)):
            sizes, sides = [1] * 3, [1] * 3  # the other axes have one place
            sizes[k], sides[k] = n, p
            total_ = covering_weight(sizes, tuple(sides), step, uniform, 1.0)
            place = scores.sparkSession.range(n).select(*[F.col("id").cast("int").alias(b) if b == a else F.lit(0).alias(b) for b in AXES])
            rows = rows.join(F.broadcast(place.select(a, total_.alias(f"_t{k}"))), a)
        d = F.lit(1.0 if uniform else 10.0) * F.col("_t0") * F.col("_t1") * F.col("_t2")
    return rows.select(*PLACE, F.array(*[F.try_divide(f"_n{k}", d) for k in range(classes)]).alias("ls"))


def strict_blend(logits: DataFrame, patch: Triple) -> DataFrame:
    """:func:`blend` with sums that are the same to the last bit in any order, so they combine before the shuffle too."""
    w = weight(patch)
    rows = logits.withColumn("_w", w).groupBy(*PLACE, "k").agg(*binned_sum(F.col("_w") * F.col("l"), "_n"), *binned_sum(F.col("_w"), "_d"))
    return rows.select(*PLACE, "k", F.try_divide(total("_n"), total("_d")).alias("l"))


def argmax(logits: DataFrame) -> DataFrame:
    """The best class of each voxel, the lowest on ties."""
    best = logits.groupBy(*PLACE).agg(F.max(F.struct("l", (-F.col("k")).alias("k"))).alias("b"))
    return best.select(*PLACE, (-F.col("b.k")).cast("int").alias("label"), F.col("b.l").alias("score"))


def segment(scores: DataFrame, patch: Triple, uniform: bool = False) -> DataFrame:
    """Two best weighted classes within each patch; over patches the greatest first score wins whole, the earlier patch on ties.

    NaN scores never win.  The winner is a maximum of structs, so it combines before the shuffle.
    """
    w = weight(patch, uniform)
    clean = F.transform("ls", lambda s: F.nanvl(s * w, F.lit(float("-inf"))))
    ranked = scores.withColumn("t", top_two(clean))
    best = F.max(F.struct("t.score1", (-F.col("pid")).alias("p"), "t.label1", "t.label2", "t.score2")).alias("b")
    won = ranked.groupBy(*PLACE).agg(best)
    return won.select(*PLACE, "b.label1", "b.score1", "b.label2", "b.score2")


def softmax(logits: DataFrame) -> DataFrame:
    """Class probabilities of each voxel."""
    over = Window.partitionBy(*PLACE)
    shifted = logits.withColumn("_e", F.exp(F.col("l") - F.max("l").over(over)))
    return shifted.withColumn("p", F.col("_e") / F.sum("_e").over(over)).drop("_e")
