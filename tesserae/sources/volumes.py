"""Tables and arrays as volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_arrays(rows: DataFrame, z: str, data: str, volume_id: str = "image") -> DataFrame:
    """A plane per row set: ``z`` is the row, ``x`` the place in its array."""
    cells = rows.select(F.col(z).cast("int").alias("z"), F.posexplode(data).alias("x", "v"))
    return cells.select(F.lit(volume_id).alias("volume_id"), F.lit(0).alias("c"), "z", F.lit(0).alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def from_blocks(blocks: DataFrame) -> DataFrame:
    """Voxels of stored blocks (``z0, y0, x0, dims, data`` in row-major order)."""
    cells = blocks.select("*", F.posexplode("data").alias("i", "v"))
    plane = F.col("dims")[1] * F.col("dims")[2]
    place = [F.floor(F.col("i") / plane), F.floor(F.col("i") / F.col("dims")[2]) % F.col("dims")[1], F.col("i") % F.col("dims")[2]]
    return cells.select("volume_id", F.lit(0).alias("c"), *[(F.col(f"{a}0") + p).cast("int").alias(a) for a, p in zip(AXES, place)], F.col("v").cast("double").alias("v"))


def embeddings_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def lineitem_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price by quantity, line number and discount: 50 x 7 x 11 cells, absent ones 0."""
    rows = table(spark, sf_dir, "lineitem")
    place = (F.col("l_quantity").cast("int") - 1).alias("z"), (F.col("l_linenumber") - 1).alias("y"), F.rint(F.col("l_discount") * 100).cast("int").alias("x")
    cells = rows.groupBy(*place).agg(F.avg("l_extendedprice").alias("v"))
    return densify(cells.select(F.lit("cube").alias("volume_id"), F.lit(0).alias("c"), "z", "y", "x", "v"), (50, 7, 11))


def grid(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """Every place of a box, spread over partitions."""
    n = shape[1] * shape[2]
    return spark.range(shape[0] * n).select(*[e.cast("int").alias(a) for a, e in zip(AXES, (F.expr(f"id div {n}"), F.expr(f"(id div {shape[2]}) % {shape[1]}"), F.expr(f"id % {shape[2]}")))])


def densify(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """``voxels`` of one volume and channel with zeros where places are missing."""
    dense = grid(voxels.sparkSession, shape).join(voxels, list(AXES), "left")
    ids = voxels.select(F.first("volume_id").alias("_id"), F.first("c").alias("_c"))  # one row
    return dense.crossJoin(F.broadcast(ids)).select(F.col("_id").alias("volume_id"), F.col("_c").alias("c"), *AXES, F.coalesce("v", F.lit(0.0)).alias("v"))


def extents(voxels: DataFrame) -> DataFrame:
    """One row a volume: its size along each axis."""
    return voxels.groupBy("volume_id").agg(*[(F.max(a) + 1).alias(f"n_{a}") for a in AXES])


def shape_of(voxels: DataFrame) -> tuple[int, int, int]:
    """The size of a single volume, one row to the driver."""
    return tuple(int(x or 0) for x in voxels.agg(*[F.max(a) + 1 for a in AXES]).first())
