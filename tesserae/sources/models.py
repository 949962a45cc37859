"""Model folders: discovery, descriptions, checkpoints, bulk conversion."""

from __future__ import annotations

import argparse
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.weights import pending
from .tensors import read_safetensors, write_safetensors

WEIGHTS = "TESSERAE_MODELS"  # the environment variable that names the model store


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a Hadoop pattern, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found) if found else []


def weights_dir() -> str:
    if not os.environ.get(WEIGHTS):
        raise FileNotFoundError(f"{WEIGHTS} is not set")
    return os.environ[WEIGHTS]


def first_sorted(paths: DataFrame, path: str = "path") -> DataFrame:
    """The least path, as one row."""
    return paths.agg(F.min(path).alias(path))


def model_folder(spark: SparkSession, task_id: int, root: str | None = None) -> str:
    """The first trainer folder of the first data set with this number."""
    root = root or weights_dir()
    sets = listed(spark, f"{root}/Dataset{task_id:03d}_*") or listed(spark, f"{root}/Dataset{task_id}_*")
    found = listed(spark, f"{sets[0]}/*__*__*") if sets else []
    if not found:
        raise FileNotFoundError(f"no model folder of task {task_id} under {root}")
    return found[0]


def trainer_folder(spark: SparkSession, path: str) -> str:
    """``path`` itself where it holds a description, else its first trainer folder."""
    if listed(spark, f"{path}/plans.json"):
        return path
    found = [f for f in listed(spark, f"{path}/*__*__*") if listed(spark, f"{f}/plans.json")]
    if not found:
        raise FileNotFoundError(f"no plans.json in {path} or its trainer folders")
    return found[0]


def load_weights(spark: SparkSession, folder: str, fold: int = 0, checkpoint: str = "checkpoint_final.pth") -> DataFrame:
    """``key, shape, data`` of a fold's tensor file.  Pickled checkpoints are not opened: unpickling runs what they hold."""
    base = checkpoint.rsplit(".", 1)[0]
    path = f"{folder}/fold_{fold}/{base}.safetensors"
    if listed(spark, path):
        return read_safetensors(spark, path).drop("path")
    if listed(spark, f"{folder}/fold_{fold}/{base}.pth"):
        raise ValueError(f"{folder}/fold_{fold}/{base}.pth is a pickle; convert it to safetensors first")
    raise FileNotFoundError(path)


def pending_conversions(spark: SparkSession, root: str, checkpoint: str = "checkpoint_final.pth") -> DataFrame:
    """``path``, ``target`` of checkpoints in fold folders without a converted sibling."""
    rows = lambda names: spark.createDataFrame([(n,) for n in names], "path string")
    return pending(rows(listed(spark, f"{root}/fold_*/{checkpoint}")), rows(listed(spark, f"{root}/fold_*/*.safetensors")))


def store(tensors: DataFrame, folder: str, fold: int = 0, name: str = "checkpoint_final.safetensors") -> int:
    """Writes ``key, shape, data`` as a fold's tensor file."""
    return write_safetensors(tensors.withColumn("path", F.lit(f"{folder}/fold_{fold}/{name}")))


def convert_folder(spark: SparkSession, root: str, force: bool = False) -> int:
    """Tensor tables (``key, shape, data`` as Parquet) in the fold folders below ``root`` to tensor files
    beside them; those that exist stay unless ``force``.  All files are one job; returns how many were written."""
    paths = [p for p in (*listed(spark, f"{root}/fold_*/*.parquet"), *listed(spark, f"{root}/Dataset*/*__*__*/fold_*/*.parquet"))]
    todo = {p: p.rsplit(".", 1)[0] + ".safetensors" for p in paths}
    todo = {p: t for p, t in todo.items() if force or not listed(spark, t)}
    tables = [spark.read.parquet(p).select("key", "shape", "data").withColumn("path", F.lit(t)) for p, t in todo.items()]
    return write_safetensors(reduce(DataFrame.unionByName, tables)) if tables else 0


def main(args: list[str] | None = None) -> int:
    """``python -m tesserae.sources.models PATH [-o OUT] [--all]``: tensor tables (Parquet) or folders of them to tensor files."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("path")
    parser.add_argument("-o", "--output")
    parser.add_argument("--all", action="store_true", help="every fold_*/*.parquet below the path")
    parser.add_argument("--force", action="store_true", help="also those that exist")
    found = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if found.all:
        done = convert_folder(spark, found.path, found.force)
    else:
        target = found.output or found.path.rsplit(".", 1)[0] + ".safetensors"
        wanted = found.force or not listed(spark, target)
        done = write_safetensors(spark.read.parquet(found.path).withColumn("path", F.lit(target))) if wanted else 0
    print(f"{done} files written")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
