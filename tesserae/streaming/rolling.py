"""Blending of patch scores that arrive plane by plane.

:func:`rolling_state` keeps a ring of planes a volume as the state of a stream, and lets
planes go as the patches' steps pass them.  :func:`rolling_blend` does it with sums by voxel: the plane
number is the event time, and once the watermark has passed a plane by a patch's
depth, no patch can add to it any more and it is emitted and forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK, Patching
from ..operators.tiling import Triple, weight

STATE = "low int, seen bigint, late bigint, ring binary"
FLAT = 1 << 30  # a side no plane reaches


class Ring:
    """The planes of one volume that patches may still add to: ``min(patch + greatest gap between steps, depth)`` of them, from ``low`` on.

    A plane leaves when a step begins beyond it whose *predecessor* begins beyond it too, so patches may
    come one step late.  What comes later than that adds to the planes still held; its
    planes that have left stay as they were, and it counts as ``late``.
    """

    def __init__(self, size: Triple, channels: int, plan: Patching, low: int = 0, seen: int = 0, late: int = 0, ring: bytes | None = None) -> None:
        self.size, self.channels, self.plan, self.low, self.seen, self.late = size, channels, plan, low, seen, late
        self.axes = plan.axes(size)
        self.w = plan.weight(self.axes)
        starts = self.axes[0].starts
        gap = max((b - a for a, b in zip(starts, starts[1:])), default=0)
        shape = (min(plan.patch[0] + gap, size[0]), channels, *size[1:])
        self.planes = np.zeros(shape) if ring is None else np.frombuffer(ring, "<f8").reshape(shape).copy()
        self.before = dict(zip(starts, [starts[0], *starts[:-1]]))
        self.count = int(np.prod([len(a.starts) for a in self.axes]))

    def leave(self, upto: int) -> Iterator[tuple[int, bytes]]:
        """Planes below ``upto``, blended; their places in the ring are free again."""
        d = [a.total(self.plan.uniform) for a in self.axes]
        flat = (1.0 if self.plan.uniform else self.plan.scale) * d[1][:, None] * d[2]
        while self.low < upto:
            plane = self.planes[self.low % len(self.planes)]
            yield self.low, (plane / (d[0][self.low] * flat)).tobytes()
            plane[:] = 0
            self.low += 1

    def take(self, start: Triple, scores: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Planes that leave before the patch comes; then its weighted scores are added."""
        yield from self.leave(max(self.before[start[0]], 0))
        self.seen += 1
        self.late += max(start[0], 0) < self.low
        box = [(max(s, 0), min(s + p, n)) for s, p, n in zip(start, self.plan.patch, self.size)]
        inner = tuple(slice(lo - s, hi - s) for (lo, hi), s in zip(box, start))
        weighted = (self.w * scores)[(slice(None), *inner)]
        for z in range(max(box[0][0], self.low), box[0][1]):
            self.planes[z % len(self.planes)][:, box[1][0] : box[1][1], box[2][0] : box[2][1]] += weighted[:, z - box[0][0]]
        if self.seen == self.count:
            yield from self.leave(self.size[0])


def rolling_state(scores: DataFrame, plan: Patching) -> DataFrame:
    """A stream of patch scores (the rows of ``blocks.scored``) to blended planes, as blocks of one plane each (side ``(1, FLAT, FLAT)``).

    Volumes may come interleaved; a volume's patches come in order of their first plane, up to one step
    late, and in any order within a micro-batch.  A volume ends with its last patch, which follows from its
    size; then its state goes.  The state is a ring of planes, whatever the volume's depth.
    """

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["s0", "pid"])  # what one micro-batch has of a volume
        first = rows.iloc[0]
        size, channels = (int(first.n_z), int(first.n_y), int(first.n_x)), int(first.channels)
        ring = Ring(size, channels, plan, *(state.get if state.exists else ()))
        out = []
        for row in rows.itertuples():
            body = np.frombuffer(row.data, "<f8").reshape(channels, *plan.patch)
            out += ring.take((row.s0, row.s1, row.s2), body)
        if ring.seen == ring.count:
            state.remove()
        else:
            state.update((ring.low, ring.seen, ring.late, ring.planes.tobytes()))
        names = [c.split()[0] for c in BLOCK.split(", ")]
        yield pd.DataFrame([(key[0], *size, z, 0, 0, channels, data) for z, data in out], columns=names)

    return scores.groupBy("volume_id").applyInPandasWithState(advance, BLOCK, STATE, "append", "NoTimeout")


def rolling_blend(scores: DataFrame, patch: Triple) -> DataFrame:
    """A stream of ``volume_id, z, y, x, k, d0, d1, d2, l``, patches in order of z, to blended planes (append mode).

    The last planes leave only when later rows arrive: close a volume with :func:`closing_row`.
    That row has no weight, which is tested on the sums: a test on the rows would be pushed
    below the watermark and hide it.
    """
    # planes count from second 1: at 0, where watermarks begin, the first would be late
    timed = scores.withColumn("at", F.timestamp_seconds(F.col("z") + 1)).withWatermark("at", f"{patch[0]} seconds")
    sums = timed.withColumn("_w", weight(patch)).groupBy("volume_id", "at", "z", "y", "x", "k").agg(F.sum(F.col("_w") * F.col("l")).alias("_n"), F.sum("_w").alias("_d"))
    return sums.where(F.col("_d").isNotNull()).select("volume_id", "z", "y", "x", "k", F.try_divide("_n", "_d").alias("l"))


def closing_row(scores: DataFrame, depth: int, patch: Triple) -> DataFrame:
    """One row beyond a volume of ``depth`` planes, in the layout of ``scores`` and without weight or score."""
    row = scores.sparkSession.range(1)
    return row.select(*[F.lit(depth + 2 * patch[0] if f.name == "z" else None).cast(f.dataType).alias(f.name) for f in scores.schema])


def rolling_batch(scores: DataFrame, patch: Triple) -> DataFrame:
    """The same over a table: rows are dealt by ranges of z, and one such shuffle serves the sums."""
    rows = scores.withColumn("_w", weight(patch)).repartitionByRange("volume_id", "z")
    sums = rows.groupBy("volume_id", "z", "y", "x", "k").agg(F.sum(F.col("_w") * F.col("l")).alias("_n"), F.sum("_w").alias("_d"))
    return sums.select("volume_id", "z", "y", "x", "k", F.try_divide("_n", "_d").alias("l"))
