"""Padding, patch positions, and the expansion of voxels into the patches that cover them."""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import covering, gaussian, step_at, step_count, steps
from ..sources.volumes import AXES, grid

Triple = tuple[int, int, int]


def positions(image: int, tile: int, step: float) -> list[int]:
    """Patch positions along one axis, for plans made on the driver."""
    target = max(1, int(tile * step))
    n = max(0, ceil((image - tile) / target) + 1)
    return [round((image - tile) / (n - 1) * i) for i in range(n)] if n > 1 else [0] * n


def padding(shape: Triple, patch: Triple) -> list[tuple[int, int]]:
    """Zeros before and after each axis: only axes below the patch grow, an odd one after."""
    total = [max(0, p - s) for s, p in zip(shape, patch)]
    return [(t // 2, t - t // 2) for t in total]


def pad(voxels: DataFrame, shape: Triple, patch: Triple) -> tuple[DataFrame, Triple]:
    """The volume shifted into its padded box, and the box's shape; only the added places are generated."""
    widths = padding(shape, patch)
    if not any(b + a for b, a in widths):
        return voxels, shape
    box = tuple(s + b + a for s, (b, a) in zip(shape, widths))
    moved = voxels.select("volume_id", "c", *[(F.col(a) + w[0]).alias(a) for a, w in zip(AXES, widths)], "v")
    outside = " OR ".join(f"{a} < {w[0]} OR {a} >= {w[0] + s}" for a, w, s in zip(AXES, widths, shape))
    zeros = voxels.select("volume_id", "c").distinct()  # a row a volume and channel, each expanded by itself
    for a, n in zip(AXES, box):
        zeros = zeros.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return moved.unionByName(zeros.where(outside).select("volume_id", "c", *AXES, F.lit(0.0).alias("v"))), box


def crop(cells: DataFrame, shape: Triple, patch: Triple) -> DataFrame:
    """The inverse of :func:`pad`, for cells of any kind with ``z, y, x``."""
    widths = padding(shape, patch)
    inside = " AND ".join(f"{a} >= {w[0]} AND {a} < {w[0] + s}" for a, w, s in zip(AXES, widths, shape))
    return cells.where(inside).withColumns({a: (F.col(a) - w[0]).cast("int") for a, w in zip(AXES, widths)})


def needs_padding(extents: DataFrame, patch: Triple) -> DataFrame:
    """``volume_id``, ``needs_padding``: whether any axis of a volume is shorter than the patch."""
    short = [F.col(f"n_{a}") < p for a, p in zip(AXES, patch)]
    return extents.select("volume_id", (short[0] | short[1] | short[2]).alias("needs_padding"))


def tile_grid(extents: DataFrame, patch: Triple, step: float) -> DataFrame:
    """Patches of each volume in lexicographic order: ``volume_id, pid, s0, s1, s2``."""
    rows = extents
    for a, p in zip(AXES, patch):
        n = step_count(F.col(f"n_{a}"), p, step)
        rows = rows.withColumn(f"_c_{a}", n).select("*", F.posexplode(steps(F.col(f"n_{a}"), p, step)).alias(f"_i_{a}", f"_s_{a}"))
    pid = (F.col("_i_z").cast("long") * F.col("_c_y") + F.col("_i_y")) * F.col("_c_x") + F.col("_i_x")
    return rows.select("volume_id", pid.alias("pid"), *[F.col(f"_s_{a}").alias(f"s{i}") for i, a in enumerate(AXES)])


def patches(voxels: DataFrame, shape: Triple | list[Column], patch: Triple, step: float) -> DataFrame:
    """Each voxel once per patch that covers it: ``pid`` and ``d0, d1, d2``, its place in the patch, are added.

    The covering positions follow from the coordinate by arithmetic, so this is a narrow
    expansion: no join, no shuffle, no list of patches.  ``shape`` may be columns, for
    volumes of several shapes.
    """
    sizes = [s if isinstance(s, Column) else F.lit(s) for s in shape]
    rows, counts = voxels, [step_count(s, p, step) for s, p in zip(sizes, patch)]
    for a, s, p in zip(AXES, sizes, patch):
        rows = rows.withColumn(f"_i_{a}", F.explode(covering(F.col(a), s, p, step)))
    pid = (F.col("_i_z").cast("long") * counts[1] + F.col("_i_y")) * counts[2] + F.col("_i_x")
    place = {f"d{i}": F.col(a) - step_at(F.col(f"_i_{a}"), counts[i], s, p) for i, (a, s, p) in enumerate(zip(AXES, sizes, patch))}
    return rows.withColumns({"pid": pid, **place}).drop(*[f"_i_{a}" for a in AXES])


def _before(a: str, p: int) -> Column:
    """Zeros before axis ``a`` of a volume with its extents as columns."""
    return F.expr(f"greatest({p} - n_{a}, 0) div 2").cast("int")


def pad_each(voxels: DataFrame, extents: DataFrame, patch: Triple) -> DataFrame:
    """:func:`pad` for volumes of several shapes; ``n_z, n_y, n_x`` become the padded box of each."""
    held = voxels.join(extents, "volume_id")
    box = {f"n_{a}": F.greatest(F.col(f"n_{a}"), F.lit(p)).cast("int") for a, p in zip(AXES, patch)}
    moved = held.withColumns({a: (F.col(a) + _before(a, p)).cast("int") for a, p in zip(AXES, patch)}).withColumns(box)
    heads = voxels.select("volume_id", "c").distinct().join(extents, "volume_id")  # a row a volume and channel
    zeros = heads.where(" OR ".join(f"n_{a} < {p}" for a, p in zip(AXES, patch)))
    for a, p in zip(AXES, patch):
        zeros = zeros.withColumn(a, F.explode(F.sequence(F.lit(0), F.greatest(F.col(f"n_{a}"), F.lit(p)).cast("int") - 1)))
    inside = [(F.col(a) >= _before(a, p)) & (F.col(a) < _before(a, p) + F.col(f"n_{a}")) for a, p in zip(AXES, patch)]
    zeros = zeros.where(~(inside[0] & inside[1] & inside[2])).withColumn("v", F.lit(0.0)).withColumns(box)
    columns = ["volume_id", "c", *AXES, "v", *box]
    return moved.select(*columns).unionByName(zeros.select(*columns))


def crop_each(cells: DataFrame, extents: DataFrame, patch: Triple) -> DataFrame:
    """The inverse of :func:`pad_each`, for cells of any kind with ``volume_id, z, y, x``."""
    moved = cells.join(extents, "volume_id").withColumns({a: (F.col(a) - _before(a, p)).cast("int") for a, p in zip(AXES, patch)})
    return moved.where(" AND ".join(f"{a} >= 0 AND {a} < n_{a}" for a in AXES)).drop(*[f"n_{a}" for a in AXES])


def gaussian_map(spark: SparkSession, tile: Triple, sigma_scale: float = 0.125, scale: float = 1.0) -> DataFrame:
    """``d0, d1, d2, w`` of one patch; weights that underflow take the least that does not."""
    cells = grid(spark, tile).toDF("d0", "d1", "d2").withColumn("w", gaussian([F.col(f"d{i}") for i in range(3)], list(tile), sigma_scale, scale))
    least = cells.agg(F.min(F.when(F.col("w") != 0, F.col("w"))).alias("_least"))  # one row
    return cells.crossJoin(F.broadcast(least)).select("d0", "d1", "d2", F.when(F.col("w") == 0, F.col("_least")).otherwise(F.col("w")).alias("w"))


def weight(patch: Triple, uniform: bool = False, scale: float = 10.0) -> Column:
    return F.lit(1.0) if uniform else gaussian([F.col(f"d{i}") for i in range(3)], list(patch), 0.125, scale)


def axis_subsets(axes: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The identity, then every non-empty choice of mirror axes by size."""
    return [(), *(c for n in range(1, len(axes) + 1) for c in combinations(axes, n))]
