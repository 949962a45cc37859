"""Stored tensors (``key, shape, data``) by the network's naming and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import fuzzy_key, kept_key, remapped_key


def transposed(rows: DataFrame) -> DataFrame:
    """Five-dimensional tensors with the input channel last: ``(o, i, d, h, w)`` to ``(o, d, h, w, i)``, of
    upsampling layers ``(i, o, d, h, w)`` to ``(o, d, h, w, i)``; others as they are.

    A gather by index arithmetic inside each array; no row leaves its partition.
    """
    rows = rows.select("key", F.col("shape").alias("_shape"), F.col("data").alias("_data"))  # names of their own: lambdas resolve after the aliases below
    s = lambda i: F.col("_shape")[i]
    up = F.contains("key", F.lit("transpconv")) | F.contains("key", F.lit("ConvTranspose"))
    first, channels = F.when(up, s(1)).otherwise(s(0)), F.when(up, s(0)).otherwise(s(1))
    space = s(2) * s(3) * s(4)

    def gather(j: Column) -> Column:
        channel, rest = j % channels, F.floor(j / channels)
        place, out = rest % space, F.floor(rest / space)
        row = F.when(up, channel * first + out).otherwise(out * channels + channel)
        return F.get("_data", (row * space + place).cast("int"))

    five = F.size("_shape") == 5
    n = F.size("_data")
    moved = F.when(five & (n > 0), F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), gather)).otherwise(F.col("_data"))
    return rows.select("key", F.when(five, F.array(first, s(2), s(3), s(4), channels)).otherwise(F.col("_shape")).alias("shape"), moved.alias("data"))


def renamed(rows: DataFrame, key_map: DataFrame | None = None) -> DataFrame:
    """Kept tensors under remapped keys; ``key_map`` (``key``, ``mapped``) overrides by original key."""
    rows = rows.where(kept_key(F.col("key")))
    if key_map is None:
        return rows.withColumn("key", remapped_key(F.col("key")))
    return rows.join(key_map, "key", "left").withColumn("key", F.coalesce("mapped", remapped_key(F.col("key")))).drop("mapped")


def converted(rows: DataFrame, key_map: DataFrame | None = None) -> DataFrame:
    """Stored tensors ready for the network; the layout goes by the original key."""
    return renamed(transposed(rows), key_map)


def fuzzy_matched(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tensors under keys of the network (``known.key``), by exact or else by rewritten key, and those that match none."""
    names = known.select(F.col("key").alias("_known")).distinct()
    exact = rows.join(names, F.col("key") == F.col("_known"), "left").withColumn("_new", F.coalesce("_known", fuzzy_key(F.col("key")))).drop("_known")
    mapped = exact.join(names, F.col("_new") == F.col("_known"), "left_semi").withColumn("key", F.col("_new")).drop("_new")
    unmapped = exact.join(names, F.col("_new") == F.col("_known"), "left_anti").drop("_new")
    return mapped, unmapped


def first_unmapped(unmapped: DataFrame, count: int = 5) -> DataFrame:
    """The first keys that match none, for a message; a sorted head, which each partition cuts before one task sees it."""
    return unmapped.select("key").distinct().orderBy("key").limit(count)


def pending(sources: DataFrame, existing: DataFrame) -> DataFrame:
    """Checkpoints (``path``) whose converted file does not exist yet."""
    target = F.regexp_replace("path", r"\.pth$", ".safetensors")
    return sources.where(F.endswith("path", F.lit(".pth"))).withColumn("target", target).join(existing.select(F.col("path").alias("target")), "target", "left_anti")
