"""The facade: a model bundle, and an engine that predicts over volumes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks, forward, normalize, tiling
from .operators.weights import converted, fuzzy_matched
from .plans.networks import batch_size, from_plans, read_json
from .sources import models
from .sources.volumes import extents


@dataclass
class ModelBundle:
    """A description, its data set's labels and channels, and the stored tensors."""

    plans: dict
    dataset: dict
    weights: DataFrame

    @classmethod
    def from_folder(cls, spark: SparkSession, path: str, fold: int = 0) -> ModelBundle:
        folder = models.trainer_folder(spark, path)
        return cls(read_json(spark, f"{folder}/plans.json"), read_json(spark, f"{folder}/dataset.json"), models.load_weights(spark, folder, fold))

    @classmethod
    def from_task(cls, spark: SparkSession, task_id: int, fold: int = 0, root: str | None = None, auto_convert: bool = True) -> ModelBundle:
        """The first model of a task; with ``auto_convert`` its tensor tables that have no tensor file yet are converted first."""
        folder = models.model_folder(spark, task_id, root)
        if auto_convert:
            models.convert_folder(spark, folder)
        return cls.from_folder(spark, folder, fold)

    @property
    def classes(self) -> int:
        return len(self.dataset["labels"])

    @property
    def channels(self) -> int:
        return len(self.dataset.get("channel_names") or self.dataset.get("modality") or {})


@dataclass(frozen=True)
class ShapeContext:
    """What follows from a volume's shape alone."""

    shape: tuple[int, int, int]
    widths: tuple[tuple[int, int], ...]
    padded: tuple[int, int, int]
    starts: tuple[tuple[int, ...], ...]

    @property
    def needs_padding(self) -> bool:
        return self.shape != self.padded

    @property
    def n_patches(self) -> int:
        return int(np.prod([len(s) for s in self.starts]))


class Engine:
    """Predicts over voxel tables: normalise, pack into blocks, run the network on the patches of each block, blend.

    ``batch`` patches go through the network at once; where it is not given, as many as fit into
    ``memory`` bytes, 8 at most.  ``side`` is that of the blocks, a patch's where it is not given.
    """

    def __init__(self, bundle: ModelBundle, configuration: str = "3d_fullres", step: float = 0.5, mirror: tuple[int, ...] = (), batch: int | None = None, memory: float = 2.0**30, side: tuple[int, int, int] | None = None) -> None:
        self.bundle, self.step, self.mirror = bundle, step, mirror
        config = bundle.plans["configurations"][configuration]
        self.patch = tuple(config["patch_size"])
        self.schemes = config.get("normalization_schemes") or [normalize.DEFAULT]
        self.arch = from_plans(bundle.plans, max(1, bundle.channels), bundle.classes, configuration)
        known = self.arch.layer_table(bundle.weights.sparkSession)
        mapped, self.unmapped = fuzzy_matched(converted(bundle.weights), known)
        # the parameters of one model: bounded by the network, not by the data
        self.network = forward.UNet(self.arch, {r["key"]: np.array(r["data"], np.float64).reshape(r["shape"]) for r in mapped.toLocalIterator()})
        spark = bundle.weights.sparkSession
        fits = batch_size(F.array(*[F.lit(p) for p in self.patch]), F.lit(bundle.classes), F.lit(float(memory)))
        self.batch = batch or spark.range(1).select(fits).first()[0]
        self.plan = blocks.Patching(self.patch, step, side or self.patch, self.batch)
        self.prepare = lru_cache(maxsize=None)(self._prepare)

    def _prepare(self, shape: tuple[int, int, int]) -> ShapeContext:
        widths = tuple(tiling.padding(shape, self.patch))
        padded = tuple(s + b + a for s, (b, a) in zip(shape, widths))
        return ShapeContext(tuple(shape), widths, padded, tuple(tuple(tiling.positions(n, p, self.step)) for n, p in zip(padded, self.patch)))

    def normalize(self, voxels: DataFrame) -> DataFrame:
        """By each channel's scheme; unknown schemes leave voxels as they are."""
        spark = voxels.sparkSession
        given = self.bundle.plans.get("foreground_intensity_properties_per_channel") or {}
        names = ("mean", "std", "percentile_00_5", "percentile_99_5")
        rows = [({c: {n: float(p[n]) for n in names} for c, p in given.items()},)]
        kind = ", ".join(f"{n}: double" for n in names)
        listed = spark.createDataFrame(rows, f"foreground_intensity_properties_per_channel map<string, struct<{kind}>>")
        return normalize.dispatch(voxels, self.schemes, normalize.intensity_params(listed), unknown="NoNormalization")

    def _blocks(self, voxels: DataFrame, normalized: bool) -> DataFrame:
        ready = voxels if normalized else self.normalize(voxels)
        return blocks.pack(ready, extents(voxels), self.plan.side, self.arch.in_channels)

    @property
    def _passes(self) -> forward.Network:
        return forward.mirrored(self.network, self.mirror) if self.mirror else self.network

    def predict(self, voxels: DataFrame, normalized: bool = False) -> DataFrame:
        """``volume_id, k, z, y, x, l``: blended class scores; every volume has a shape of its own."""
        blended = blocks.predicted(self._blocks(voxels, normalized), self.plan, self._passes, self.bundle.classes)
        return blocks.unpack(blended, self.plan.side).select("volume_id", "z", "y", "x", F.posexplode("ls").alias("k", "l"))

    def segment(self, voxels: DataFrame, normalized: bool = False) -> DataFrame:
        """``volume_id, z, y, x, label1, score1, label2, score2``: the two best classes of the winning patch."""
        return blocks.unpack_segments(blocks.segmented(self._blocks(voxels, normalized), self.plan, self._passes), self.plan.side)
