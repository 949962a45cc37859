"""Intensity normalisation of voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import EPS, ct_norm

SCHEMES = ("CTNormalization", "ZScoreNormalization", "NoNormalization")
DEFAULT = "CTNormalization"


def ct(voxels: DataFrame, mean: float, std: float, low: float, high: float) -> DataFrame:
    return voxels.withColumn("v", ct_norm(F.col("v"), mean, std, low, high))


def zscore(voxels: DataFrame, mask: Column | None = None, by: tuple[str, ...] = ("volume_id", "c")) -> DataFrame:
    """Mean and population deviation of the masked voxels (non-zero by default) applied to all; an empty mask gives 0 and 1.

    Statistics are one row a volume and channel, aggregated before the shuffle.
    """
    mask = F.col("v") != 0 if mask is None else mask
    inside = F.when(mask, F.col("v"))
    stats = voxels.groupBy(*by).agg(F.coalesce(F.avg(inside), F.lit(0.0)).alias("_m"), F.coalesce(F.stddev_pop(inside), F.lit(1.0)).alias("_s"))
    joined = voxels.join(stats, list(by))
    return joined.withColumn("v", (F.col("v") - F.col("_m")) / F.greatest("_s", F.lit(EPS))).drop("_m", "_s")


def intensity_params(plans: DataFrame) -> DataFrame:
    """``c, mean, std, low, high`` of each channel a model description lists."""
    rows = plans.select(F.explode("foreground_intensity_properties_per_channel").alias("c", "p"))
    return rows.select(F.col("c").cast("int").alias("c"), "p.mean", "p.std", F.col("p.percentile_00_5").alias("low"), F.col("p.percentile_99_5").alias("high"))


def dispatch(voxels: DataFrame, schemes: list[str], params: DataFrame, unknown: str = DEFAULT) -> DataFrame:
    """Each channel by its scheme (the first where the list is short).

    ``unknown``: the scheme names not known fall back to, ``NoNormalization`` to leave
    their voxels as they are.  Z-score statistics are per volume and channel.
    """
    schemes = schemes or [DEFAULT]
    names = F.array(*[F.lit(s if s in SCHEMES else unknown) for s in schemes])
    scheme = F.when(F.col("c") < len(schemes), F.get(names, F.col("c"))).otherwise(names[0])
    given = params.select("c", F.col("mean").alias("_mean"), F.col("std").alias("_std"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    rows = voxels.join(F.broadcast(given), "c", "left")  # a row a channel
    value = F.when(scheme == "NoNormalization", F.col("v"))
    if "ZScoreNormalization" in [*schemes, unknown]:
        inside = F.when(F.col("v") != 0, F.col("v"))
        stats = voxels.groupBy("volume_id", "c").agg(F.coalesce(F.avg(inside), F.lit(0.0)).alias("_m"), F.coalesce(F.stddev_pop(inside), F.lit(1.0)).alias("_s"))
        rows = rows.join(stats, ["volume_id", "c"])
        value = value.when(scheme == "ZScoreNormalization", (F.col("v") - F.col("_m")) / F.greatest("_s", F.lit(EPS)))
    value = value.otherwise(ct_norm(F.col("v"), F.col("_mean"), F.col("_std"), F.col("_low"), F.col("_high")))
    return rows.withColumn("v", value).select(*voxels.columns)
