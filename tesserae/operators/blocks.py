"""Volumes as binary blocks: patches, blending, segmentation and layers without a row a voxel.

A block is one row: a box of at most ``side`` voxels an axis with all its channels, in
row-major bytes.  What a task needs beyond its own block comes by a *halo exchange*: every
block sends each neighbour that asks for it just the slice it asks for.  Patches are at home
in the block that holds their first voxel inside the volume; a home's task gets the box its patches
cover, runs them, puts their overlaps together, and sends one piece to each block it touched.
Blocks add the pieces in the order of their homes, so results are the same to the last
bit however rows are dealt.  The sum of weights over a voxel is a product of three sums along the
axes, which follow from the volume's size; they are not shuffled.

No group is larger than the box of a home (``side`` and a patch an axis), or than the pieces of a block.

Which patches share a task decides what is exchanged: their overlaps are summed before they leave it.  A home of ``2**k``
blocks along each axis holds the blocks of one stretch of a Z-order curve, so ``spread`` deals patches by such
a curve, in stretches as long as memory allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.networks import same_padding
from ..sources.volumes import AXES
from . import forward
from .tiling import Triple, padding, positions

SIZE = "n_z int, n_y int, n_x int"
BLOCK = f"volume_id string, {SIZE}, b0 int, b1 int, b2 int, channels int, data binary"
PIECE = f"volume_id string, {SIZE}, b0 int, b1 int, b2 int, h0 int, h1 int, h2 int, o0 int, o1 int, o2 int, d0 int, d1 int, d2 int, channels int, data binary"
RANKED = f"volume_id string, {SIZE}, b0 int, b1 int, b2 int, h0 int, h1 int, h2 int, o0 int, o1 int, o2 int, d0 int, d1 int, d2 int, label1 binary, score1 binary, label2 binary, score2 binary, pid binary"
SEGMENTS = f"volume_id string, {SIZE}, b0 int, b1 int, b2 int, label1 binary, score1 binary, label2 binary, score2 binary"
AT = ["b0", "b1", "b2"]
KEY = ["volume_id", "n_z", "n_y", "n_x", *AT]
PLANES = {"label1": "<i4", "score1": "<f8", "label2": "<i4", "score2": "<f8", "pid": "<i8"}

Regions = Callable[[int, int], list[tuple[int, int, int]]]  # of an axis and a size: homes and the stretch each asks for


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return [kinds[c.split()[1]] for c in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_names(schema))
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, _types(schema))], names=_names(schema))


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for row in zip(*(c.to_pylist() for c in table.columns)):
        yield dict(zip(table.schema.names, row))


def _size(row: dict) -> Triple:
    return tuple(row[f"n_{a}"] for a in AXES)


def _span(row: dict, side: Triple) -> list[tuple[int, int]]:
    return [(row[b] * s, min(n, (row[b] + 1) * s)) for b, s, n in zip(AT, side, _size(row))]


def _array(row: dict, side: Triple) -> np.ndarray:
    return np.frombuffer(row["data"], "<f8").reshape(row["channels"], *(b - a for a, b in _span(row, side)))


# blocks and voxels


def pack(voxels: DataFrame, sizes: DataFrame, side: Triple, channels: int = 1) -> DataFrame:
    """Blocks of a voxel table; ``sizes`` has a row a volume (``n_z, n_y, n_x``).  Places without a voxel are 0; so are whole blocks, which are made all the same."""

    def box(table: pa.Table) -> pa.Table:
        row = {n: table.column(n)[0].as_py() for n in KEY}
        table = table.filter(table.column("c").is_valid())
        span = _span(row, side)
        out = np.zeros((channels, *(b - a for a, b in span)))
        place = [table.column(a).to_numpy() - s for a, (s, _) in zip(AXES, span)]
        out[(table.column("c").to_numpy(), *place)] = table.column("v").to_numpy()
        return pa.Table.from_batches([_batch([(*row.values(), channels, out.tobytes())], BLOCK)])

    rows = voxels.join(sizes, "volume_id").withColumns({b: F.expr(f"{a} div {s}").cast("int") for a, b, s in zip(AXES, AT, side)})
    rows = rows.select(*KEY, "c", *AXES, F.col("v").cast("double").alias("v"))
    marks = sizes  # a row a block, so that none is missing
    for a, b, s in zip(AXES, AT, side):
        marks = marks.withColumn(b, F.explode(F.sequence(F.lit(0), F.expr(f"(n_{a} - 1) div {s}").cast("int"))))
    marks = marks.select(*KEY, *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in ("c", *AXES, "v")])
    return rows.unionByName(marks).groupBy(*KEY).applyInArrow(box, BLOCK)


def pack_arrays(rows: DataFrame, count: int, width: int, z: str, data: str, side: Triple, volume_id: str = "image") -> DataFrame:
    """Blocks of a plane (``y`` is 0) of ``count`` rows whose arrays run along ``x``, ``width`` wide; no row is exploded, absent ones are 0."""

    def stack(table: pa.Table) -> pa.Table:
        b = table.column("b0")[0].as_py()
        whole = np.zeros((min(count, (b + 1) * side[0]) - b * side[0], width))
        table = table.filter(table.column("z").is_valid())
        body = table.column("data").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        whole[table.column("z").to_numpy() - b * side[0]] = body.reshape(-1, width)
        cuts = [whole[:, x : x + side[2]] for x in range(0, width, side[2])]
        return pa.Table.from_batches([_batch([(volume_id, count, 1, width, b, 0, k, 1, c.tobytes()) for k, c in enumerate(cuts)], BLOCK)])

    cells = rows.select(F.col(z).cast("int").alias("z"), F.col(data).cast("array<double>").alias("data"))
    cells = cells.withColumn("b0", F.expr(f"z div {side[0]}").cast("int"))
    marks = rows.sparkSession.range(-(-count // side[0])).select(F.lit(None).cast("int").alias("z"), F.lit(None).cast("array<double>").alias("data"), F.col("id").cast("int").alias("b0"))
    return cells.unionByName(marks).groupBy("b0").applyInArrow(stack, BLOCK)


def unpack(blocks: DataFrame, side: Triple) -> DataFrame:
    """``volume_id, z, y, x, ls``: a row a voxel with its channels in an array."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                values = np.moveaxis(_array(row, side), 0, -1)
                place = np.indices(values.shape[:3]).reshape(3, -1).astype(np.int32)
                columns = [pa.array(p + np.int32(a)) for p, (a, _) in zip(place, _span(row, side))]
                offsets = pa.array(np.arange(0, values.size + 1, row["channels"], dtype=np.int32))
                ls = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel()))
                yield pa.record_batch([pa.array([row["volume_id"]] * place.shape[1]), *columns, ls], names=["volume_id", *AXES, "ls"])

    return blocks.mapInArrow(cells, "volume_id string, z int, y int, x int, ls array<double>")


def unpack_segments(segments: DataFrame, side: Triple) -> DataFrame:
    """``volume_id, z, y, x, label1, score1, label2, score2`` of segmented blocks."""
    names = list(PLANES)[:4]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                span = _span(row, side)
                place = np.indices([b - a for a, b in span]).reshape(3, -1).astype(np.int32)
                columns = [pa.array(p + np.int32(a)) for p, (a, _) in zip(place, span)]
                yield pa.record_batch([pa.array([row["volume_id"]] * place.shape[1]), *columns, *(pa.array(np.frombuffer(row[n], PLANES[n])) for n in names)], names=["volume_id", *AXES, *names])

    return segments.mapInArrow(cells, "volume_id string, z int, y int, x int, label1 int, score1 double, label2 int, score2 double")


# the halo exchange


def exchanged(blocks: DataFrame, side: Triple, regions: Regions) -> DataFrame:
    """For each home the slices of all blocks in the box it asks for: rows of ``PIECE`` with the home in ``h0, h1, h2``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                size, span, body = _size(row), _span(row, side), _array(row, side)
                asked = [[(h, max(lo, a), min(hi, b)) for h, lo, hi in regions(k, size[k]) if lo < b and hi > a] for k, (a, b) in enumerate(span)]
                out = []
                for homes in product(*asked):
                    cut = body[(slice(None), *(slice(lo - a, hi - a) for (_, lo, hi), (a, _) in zip(homes, span)))]
                    place = [*(h for h, _, _ in homes), *(lo for _, lo, _ in homes), *cut.shape[1:]]
                    out.append((*(row[k] for k in KEY), *place, row["channels"], cut.tobytes()))
                yield _batch(out, PIECE)

    return blocks.mapInArrow(send, PIECE)


def _assembled(table: pa.Table, box: list[tuple[int, int]]) -> np.ndarray:
    """The pieces put together in a box that may reach beyond the volume, where it is 0."""
    out = None
    for row in _rows(table):
        if out is None:
            out = np.zeros((row["channels"], *(hi - lo for lo, hi in box)))
        at = [slice(row[f"o{k}"] - lo, row[f"o{k}"] - lo + row[f"d{k}"]) for k, (lo, _) in enumerate(box)]
        out[(slice(None), *at)] = np.frombuffer(row["data"], "<f8").reshape(row["channels"], *(row[f"d{k}"] for k in range(3)))
    return out


# patches


class Axis:
    """Patch positions along one axis of a volume, in its own coordinates (padding is below 0 or beyond ``n``), by the block they are at home in."""

    def __init__(self, n: int, patch: int, step: float, side: int) -> None:
        before = padding((n, n, n), (patch,) * 3)[0][0]
        self.n, self.patch = n, patch
        self.starts = [s - before for s in positions(max(n, patch), patch, step)]
        self.homes: dict[int, list[int]] = {}
        for i, s in enumerate(self.starts):
            self.homes.setdefault(max(s, 0) // side, []).append(i)
        self.regions = [(h, self.starts[i[0]], self.starts[i[-1]] + patch) for h, i in self.homes.items()]
        self.box = {h: (lo, hi) for h, lo, hi in self.regions}

    def bell(self, uniform: bool) -> np.ndarray:
        at = np.arange(self.patch) - self.patch // 2
        return np.ones(self.patch) if uniform else np.exp(-(at**2) / (2.0 * (self.patch * 0.125) ** 2))

    def total(self, uniform: bool) -> np.ndarray:
        """The sum of bells over each place of the axis."""
        out, bell = np.zeros(self.n), self.bell(uniform)
        for s in self.starts:
            lo, hi = max(s, 0), min(s + self.patch, self.n)
            out[lo:hi] += bell[lo - s : hi - s]
        return out


@lru_cache(maxsize=4096)
def axis(n: int, patch: int, step: float, side: int) -> Axis:
    return Axis(n, patch, step, side)


def _axes(size: Triple, patch: Triple, step: float, side: Triple) -> list[Axis]:
    return [axis(n, p, step, s) for n, p, s in zip(size, patch, side)]


def _home_patches(axes: list[Axis], home: Triple) -> list[tuple[int, Triple]]:
    """Numbers and first voxels of a home's patches, in order."""
    counts = [len(a.starts) for a in axes]
    chosen = product(*(a.homes[h] for a, h in zip(axes, home)))
    return [((i * counts[1] + j) * counts[2] + k, tuple(a.starts[x] for a, x in zip(axes, (i, j, k)))) for i, j, k in chosen]


def _cut(box: list[tuple[int, int]], size: Triple, side: Triple) -> Iterator[tuple[Triple, Triple, Triple]]:
    """The blocks a box touches, with the first voxel and size of what it has of each."""
    inside = [(max(lo, 0), min(hi, n)) for (lo, hi), n in zip(box, size)]
    for at in product(*(range(lo // s, -(-hi // s)) for (lo, hi), s in zip(inside, side))):
        first = tuple(max(lo, b * s) for (lo, _), b, s in zip(inside, at, side))
        yield at, first, tuple(min(hi, (b + 1) * s) - f for (_, hi), b, s, f in zip(inside, at, side, first))


class Patching:
    """Patches over blocks: their size and step, the blocks' side, how many go through the network at once, and how many blocks along each axis a home has."""

    def __init__(self, patch: Triple, step: float, side: Triple, batch: int = 1, uniform: bool = False, scale: float = 10.0, spread: Triple = (1, 1, 1)) -> None:
        self.patch, self.step, self.side, self.batch, self.uniform, self.scale = tuple(patch), step, tuple(side), batch, uniform, scale
        self.home_side = tuple(a * b for a, b in zip(self.side, spread))

    def axes(self, size: Triple) -> list[Axis]:
        return _axes(size, self.patch, self.step, self.home_side)

    def regions(self, k: int, n: int) -> list[tuple[int, int, int]]:
        return axis(n, self.patch[k], self.step, self.home_side[k]).regions

    def weight(self, axes: list[Axis]) -> np.ndarray:
        bells = [a.bell(self.uniform) for a in axes]
        return (1.0 if self.uniform else self.scale) * bells[0][:, None, None] * bells[1][:, None] * bells[2]

    def home(self, table: pa.Table) -> tuple[dict, list[Axis], Triple, list[tuple[int, int]]]:
        row = {n: table.column(n)[0].as_py() for n in ("volume_id", "n_z", "n_y", "n_x", "h0", "h1", "h2")}
        axes, home = self.axes(_size(row)), tuple(row[f"h{k}"] for k in range(3))
        return row, axes, home, [a.box[h] for a, h in zip(axes, home)]

    def runs(self, table: pa.Table, network: forward.Network) -> Iterator[tuple[int, list[slice], np.ndarray]]:
        """Number, place in the home's box and scores of every patch; ``batch`` of them go through the network together, the last ones fewer."""
        _, axes, home, box = self.home(table)
        body = _assembled(table, box)
        asked = _home_patches(axes, home)
        for i in range(0, len(asked), self.batch):
            some = [(pid, [slice(s - lo, s - lo + p) for s, (lo, _), p in zip(start, box, self.patch)]) for pid, start in asked[i : i + self.batch]]
            scores = forward.batched(network)(np.stack([body[(slice(None), *at)] for _, at in some]))
            for (pid, at), found in zip(some, scores):
                yield pid, at, found

    def pieces(self, row: dict, home: Triple, box: list[tuple[int, int]]) -> Iterator[tuple[tuple, list[slice]]]:
        for at, first, dims in _cut(box, _size(row), self.side):
            yield (row["volume_id"], *_size(row), *at, *home, *first, *dims), [slice(f - lo, f - lo + d) for f, (lo, _), d in zip(first, box, dims)]


def extracted(blocks: DataFrame, plan: Patching) -> DataFrame:
    """``volume_id, pid, s0, s1, s2, channels, data``: every patch as bytes, padded with zeros beyond the volume."""
    schema = "volume_id string, pid bigint, s0 int, s1 int, s2 int, channels int, data binary"

    def cut(table: pa.Table) -> pa.Table:
        row, axes, home, box = plan.home(table)
        body, out = _assembled(table, box), []
        for pid, start in _home_patches(axes, home):
            at = [slice(s - lo, s - lo + p) for s, (lo, _), p in zip(start, box, plan.patch)]
            before = [b for b, _ in padding(_size(row), plan.patch)]
            out.append((row["volume_id"], pid, *(s + b for s, b in zip(start, before)), len(body), np.ascontiguousarray(body[(slice(None), *at)]).tobytes()))
        return pa.Table.from_batches([_batch(out, schema)])

    return exchanged(blocks, plan.side, plan.regions).groupBy("volume_id", "h0", "h1", "h2").applyInArrow(cut, schema)


SCORED = f"volume_id string, {SIZE}, pid bigint, s0 int, s1 int, s2 int, channels int, data binary"


def scored(blocks: DataFrame, plan: Patching, network: forward.Network) -> DataFrame:
    """The network's scores of every patch as bytes, with the place of its first voxel in the volume (below 0 in the padding)."""
    shared = forward.shared(blocks, network)

    def run(table: pa.Table) -> pa.Table:
        row, _, _, box = plan.home(table)
        out = [(row["volume_id"], *_size(row), pid, *(s.start + lo for s, (lo, _) in zip(at, box)), len(found), np.ascontiguousarray(found).tobytes()) for pid, at, found in plan.runs(table, shared.value)]
        return pa.Table.from_batches([_batch(out, SCORED)])

    return exchanged(blocks, plan.side, plan.regions).groupBy("volume_id", "h0", "h1", "h2").applyInArrow(run, SCORED)


def predicted(blocks: DataFrame, plan: Patching, network: forward.Network, classes: int) -> DataFrame:
    """Blended class scores of every block, as its channels: the weighted mean over the patches that cover a voxel (NaN where steps above 1 leave it uncovered)."""
    shared = forward.shared(blocks, network)

    def run(table: pa.Table) -> pa.Table:
        row, axes, home, box = plan.home(table)
        w, total = plan.weight(axes), np.zeros((classes, *(hi - lo for lo, hi in box)))
        for _, at, scores in plan.runs(table, shared.value):
            total[(slice(None), *at)] += w * scores
        out = [(*place, classes, np.ascontiguousarray(total[(slice(None), *at)]).tobytes()) for place, at in plan.pieces(row, home, box)]
        return pa.Table.from_batches([_batch(out, PIECE)])

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(_rows(table), key=lambda r: (r["h0"], r["h1"], r["h2"]))
        row = {n: rows[0][n] for n in KEY}
        span, axes = _span(row, plan.side), plan.axes(_size(row))
        total = np.zeros((classes, *(b - a for a, b in span)))
        for r in rows:
            at = [slice(r[f"o{k}"] - a, r[f"o{k}"] - a + r[f"d{k}"]) for k, (a, _) in enumerate(span)]
            total[(slice(None), *at)] += np.frombuffer(r["data"], "<f8").reshape(classes, *(r[f"d{k}"] for k in range(3)))
        d = [a.total(plan.uniform)[lo:hi] for a, (lo, hi) in zip(axes, span)]
        with np.errstate(invalid="ignore"):
            total /= (1.0 if plan.uniform else plan.scale) * d[0][:, None, None] * d[1][:, None] * d[2]
        return pa.Table.from_batches([_batch([(*row.values(), classes, total.tobytes())], BLOCK)])

    pieces = exchanged(blocks, plan.side, plan.regions).groupBy("volume_id", "h0", "h1", "h2").applyInArrow(run, PIECE)
    return pieces.groupBy(*KEY).applyInArrow(merge, BLOCK)


def _two_best(scores: np.ndarray) -> tuple[np.ndarray, ...]:
    """Labels and scores of the two best classes, the lower label on ties; NaN never wins; a lone class leaves label 0 and no score second."""
    clean = np.where(np.isnan(scores), -np.inf, scores)
    first = clean.argmax(0)
    best = np.take_along_axis(clean, first[None], 0)[0]
    if len(clean) == 1:
        return first, best, np.zeros_like(first), np.full(best.shape, -np.inf)
    rest = clean.copy()
    np.put_along_axis(rest, first[None], -np.inf, 0)
    tied = np.arange(len(rest)).reshape(-1, 1, 1, 1) == first[None]  # never second, though all others are -inf too
    second = np.where(tied, -np.inf, rest)
    label = np.where(np.isneginf(second).all(0), np.where(first == 0, 1, 0), second.argmax(0))
    return first, best, label, np.take_along_axis(second, label[None], 0)[0]


class _Best:
    """The winner so far at every voxel of a box: the greatest first score takes all its planes along, the earlier patch on ties."""

    def __init__(self, shape: tuple[int, ...]) -> None:
        self.planes = {n: np.zeros(shape, t) for n, t in PLANES.items()}
        self.planes["score1"][:] = self.planes["score2"][:] = -np.inf
        self.planes["pid"][:] = np.iinfo(np.int64).max

    def take(self, at: list[slice], found: dict[str, np.ndarray]) -> None:
        held = {n: p[tuple(at)] for n, p in self.planes.items()}
        wins = (found["score1"] > held["score1"]) | ((found["score1"] == held["score1"]) & (found["pid"] < held["pid"]))
        for n, p in held.items():
            p[wins] = found[n][wins]


def segmented(blocks: DataFrame, plan: Patching, network: forward.Network) -> DataFrame:
    """The two best classes of the winning patch at every voxel, as planes of bytes.

    Scores are weighed and ranked where the patch is; five planes leave the task whatever the
    number of classes, and no array of classes is exchanged.
    """
    shared = forward.shared(blocks, network)

    def run(table: pa.Table) -> pa.Table:
        row, axes, home, box = plan.home(table)
        w, best = plan.weight(axes), _Best(tuple(hi - lo for lo, hi in box))
        for pid, at, scores in plan.runs(table, shared.value):
            ranked = dict(zip(PLANES, _two_best(w * scores)))
            best.take(at, ranked | {"pid": np.full(w.shape, pid)})
        out = [(*place, *(np.ascontiguousarray(p[tuple(at)]).tobytes() for p in best.planes.values())) for place, at in plan.pieces(row, home, box)]
        return pa.Table.from_batches([_batch(out, RANKED)])

    def merge(table: pa.Table) -> pa.Table:
        row = {n: table.column(n)[0].as_py() for n in KEY}
        span = _span(row, plan.side)
        best = _Best(tuple(b - a for a, b in span))
        for r in _rows(table):
            dims = [r[f"d{k}"] for k in range(3)]
            at = [slice(r[f"o{k}"] - a, r[f"o{k}"] - a + d) for k, ((a, _), d) in enumerate(zip(span, dims))]
            best.take(at, {n: np.frombuffer(r[n], t).reshape(dims) for n, t in PLANES.items()})
        return pa.Table.from_batches([_batch([(*row.values(), *(best.planes[n].tobytes() for n in list(PLANES)[:4]))], SEGMENTS)])

    ranked = exchanged(blocks, plan.side, plan.regions).groupBy("volume_id", "h0", "h1", "h2").applyInArrow(run, RANKED)
    return ranked.groupBy(*KEY).applyInArrow(merge, SEGMENTS)


# layers


def conv3d(blocks: DataFrame, w: np.ndarray, side: Triple, stride: Triple = (1, 1, 1), bias: np.ndarray | None = None, sides: Triple | None = None) -> DataFrame:
    """Cross-correlation with ``(k - 1) // 2`` zeros around; ``w``: O kd kh kw C.

    A block of the output asks for its box of the input, a kernel's reach wider than itself, and is one
    matrix product over that box.  Blocks of the output have the same side, or ``sides``.
    """
    kernel, sides = w.shape[1:4], sides or side
    pads = same_padding(kernel)

    def out_size(k: int, n: int) -> int:
        return (n + 2 * pads[k] - kernel[k]) // stride[k] + 1

    def regions(k: int, n: int) -> list[tuple[int, int, int]]:
        m = out_size(k, n)
        ends = [(h, h * sides[k], min(m, (h + 1) * sides[k])) for h in range(-(-m // sides[k]))]
        return [(h, a * stride[k] - pads[k], (b - 1) * stride[k] - pads[k] + kernel[k]) for h, a, b in ends]

    shared = blocks.sparkSession.sparkContext.broadcast((w, bias))

    def run(table: pa.Table) -> pa.Table:
        row = next(_rows(table.slice(0, 1)))
        size, home = _size(row), [row[f"h{k}"] for k in range(3)]
        box = [next((lo, hi) for h, lo, hi in regions(k, size[k]) if h == home[k]) for k in range(3)]
        body = forward.conv_valid(_assembled(table, box)[None], *shared.value, stride)[0]
        return pa.Table.from_batches([_batch([(row["volume_id"], *(out_size(k, n) for k, n in enumerate(size)), *home, len(body), np.ascontiguousarray(body).tobytes())], BLOCK)])

    return exchanged(blocks, side, regions).groupBy("volume_id", "h0", "h1", "h2").applyInArrow(run, BLOCK)


def mapped(blocks: DataFrame, side: Triple, f: Callable[[np.ndarray, dict], np.ndarray], extra: tuple[str, ...] = (), factor: Triple = (1, 1, 1)) -> DataFrame:
    """Every block by itself; ``f`` gets its array and the ``extra`` columns, and may make each axis ``factor`` times as long (as must the side)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                body = f(_array(row, side), {n: row[n] for n in extra})
                yield _batch([(row["volume_id"], *(n * s for n, s in zip(_size(row), factor)), *(row[b] for b in AT), len(body), np.ascontiguousarray(body).tobytes())], BLOCK)

    return blocks.mapInArrow(run, BLOCK)


def norm_act(blocks: DataFrame, side: Triple, eps: float = 1e-5, slope: float | None = 0.01) -> DataFrame:
    """Zero mean and unit variance per channel over a volume, then the leaky activation (None: none).

    Each block leaves a row of counts, means and squared deviations a channel; their sums are joined back, one row a volume.
    """
    schema = "volume_id string, c int, n bigint, mean double, m2 double"

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                flat = _array(row, side).reshape(row["channels"], -1)
                yield _batch([(row["volume_id"], c, flat.shape[1], float(x.mean()), float(((x - x.mean()) ** 2).sum())) for c, x in enumerate(flat)], schema)

    parts = blocks.mapInArrow(moments, schema)
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    spread = (F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean) / n
    per = parts.groupBy("volume_id", "c").agg(mean.alias("mean"), F.greatest(spread, F.lit(0.0)).alias("var"))
    stats = per.groupBy("volume_id").agg(F.array_sort(F.collect_list(F.struct("c", "mean", "var"))).alias("stats"))  # a volume's channels

    def apply(x: np.ndarray, extra: dict) -> np.ndarray:
        m, v = (np.array([s[k] for s in extra["stats"]])[:, None, None, None] for k in ("mean", "var"))
        out = (x - m) / np.sqrt(v + eps)
        return out if slope is None else forward.leaky(out, slope)

    return mapped(blocks.join(stats, "volume_id"), side, apply, ("stats",))


def conv_up(blocks: DataFrame, w: np.ndarray, side: Triple, bias: np.ndarray | None = None) -> DataFrame:
    """Upsampling with kernel and stride alike; the blocks of the output are as many times as long, and no block needs another."""
    shared = blocks.sparkSession.sparkContext.broadcast((w, bias))
    return mapped(blocks, side, lambda x, _: forward.conv_up(x, *shared.value), factor=w.shape[1:4])


def avg_pool(blocks: DataFrame, side: Triple, stride: Triple) -> DataFrame:
    """Means of non-overlapping boxes, incomplete ones at the end left out; blocks of ``side // stride``, which must divide."""
    if any(a % b for a, b in zip(side, stride)):
        raise ValueError(f"blocks of {side} are not cut by {stride}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                whole = [n // s for n, s in zip(_size(row), stride)]
                m = [min(n, (row[b] + 1) * (a // s)) - row[b] * (a // s) for n, b, a, s in zip(whole, AT, side, stride)]
                if min(m) > 0:
                    body = _array(row, side)[(slice(None), *(slice(0, n * s) for n, s in zip(m, stride)))]
                    body = body.reshape(len(body), m[0], stride[0], m[1], stride[1], m[2], stride[2]).mean(axis=(2, 4, 6))
                    yield _batch([(row["volume_id"], *whole, *(row[b] for b in AT), len(body), body.tobytes())], BLOCK)

    return blocks.mapInArrow(run, BLOCK)


def add(first: DataFrame, second: DataFrame, side: Triple, slope: float | None = 0.01) -> DataFrame:
    """The sum of blocks of one grid, joined by their place, then the leaky activation (None: none)."""

    def total(x: np.ndarray, extra: dict) -> np.ndarray:
        out = x + np.frombuffer(extra["_d"], "<f8").reshape(x.shape)
        return out if slope is None else forward.leaky(out, slope)

    return mapped(first.join(second.select(*KEY, F.col("data").alias("_d")), KEY), side, total, ("_d",))


def residual(blocks: DataFrame, first: np.ndarray, second: np.ndarray, side: Triple, stride: Triple = (1, 1, 1), project: np.ndarray | None = None) -> DataFrame:
    """Two convolutions and a skip, activated after the sum; the skip is pooled where strided and projected where widths differ.

    Blocks of the output are ``side // stride``.
    """
    low = tuple(a // b for a, b in zip(side, stride))
    out = norm_act(conv3d(blocks, first, side, stride, sides=low), low)
    out = norm_act(conv3d(out, second, low), low, slope=None)
    skip = blocks if tuple(stride) == (1, 1, 1) else avg_pool(blocks, side, stride)
    if project is not None:
        skip = norm_act(conv3d(skip, project, low), low, slope=None)
    return add(out, skip, low)


def concat(first: DataFrame, second: DataFrame) -> DataFrame:
    """The channels of ``first``, then those of ``second``: blocks of one grid joined by their place."""
    other = second.select(*KEY, F.col("channels").alias("_c"), F.col("data").alias("_d"))
    return first.join(other, KEY).select(*KEY, (F.col("channels") + F.col("_c")).alias("channels"), F.concat("data", "_d").alias("data"))


def head(blocks: DataFrame, w: np.ndarray, bias: np.ndarray, side: Triple) -> DataFrame:
    """Class scores by a 1 x 1 x 1 convolution over channels; ``w``: O C."""
    shared = blocks.sparkSession.sparkContext.broadcast((w, bias))
    return mapped(blocks, side, lambda x, _: np.tensordot(shared.value[0], x, axes=([1], [0])) + shared.value[1][:, None, None, None])
