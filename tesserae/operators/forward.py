"""Networks on whole patches: Arrow groups in, class scores out.

Spark deals voxels to patches and gathers each patch, a bounded box; NumPy multiplies
inside it.  Weights reach the tasks as one broadcast per model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..plans.networks import Architecture, same_padding
from .tiling import Triple, axis_subsets, patches

Network = Callable[[np.ndarray], np.ndarray]


COLUMNS = 1 << 23  # numbers of an unrolled input multiplied at a time, 64 MB


def conv_valid(x: np.ndarray, w: np.ndarray, b: np.ndarray | None = None, stride: tuple[int, ...] = (1, 1, 1)) -> np.ndarray:
    """Cross-correlation of patches ``N C D H W`` that bring their own margins; ``w``: O kd kh kw C.

    The input is unrolled plane by plane, a bounded part at a time, and multiplied as one matrix.
    """
    kernel = w.shape[1:4]
    view = np.lib.stride_tricks.sliding_window_view(x, kernel, axis=(2, 3, 4))[:, :, :: stride[0], :: stride[1], :: stride[2]]
    flat = w.transpose(0, 4, 1, 2, 3).reshape(len(w), -1)
    out = np.empty((len(x), len(w), *view.shape[2:5]), np.result_type(x, w))
    step = max(1, COLUMNS // max(1, flat.shape[1] * view.shape[3] * view.shape[4]))
    for n in range(len(x)):
        for z in range(0, view.shape[2], step):
            part = view[n, :, z : z + step].transpose(0, 4, 5, 6, 1, 2, 3)
            out[n, :, z : z + step] = (flat @ part.reshape(flat.shape[1], -1)).reshape(len(w), *part.shape[4:])
    return out if b is None else out + b[:, None, None, None]


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray | None = None, stride: tuple[int, ...] = (1, 1, 1)) -> np.ndarray:
    """``x``: C D H W, or several of them; ``w``: O kd kh kw C."""
    many = x if x.ndim == 5 else x[None]
    padded = np.pad(many, [(0, 0), (0, 0), *[(p, p) for p in same_padding(w.shape[1:4])]])
    out = conv_valid(padded, w, b, stride)
    return out if x.ndim == 5 else out[0]


def conv_up(x: np.ndarray, w: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Upsampling by the kernel's size; ``w``: O kd kh kw C."""
    o, d, h, v, _ = w.shape
    many = x if x.ndim == 5 else x[None]
    cells = np.tensordot(w, many, axes=([4], [1])).transpose(4, 0, 5, 1, 6, 2, 7, 3)
    out = cells.reshape(len(many), o, many.shape[2] * d, many.shape[3] * h, many.shape[4] * v)
    out = out if b is None else out + b[:, None, None, None]
    return out if x.ndim == 5 else out[0]


def normed(x: np.ndarray, gamma: np.ndarray | None = None, beta: np.ndarray | None = None, eps: float = 1e-5) -> np.ndarray:
    space = (-3, -2, -1)
    out = (x - x.mean(axis=space, keepdims=True)) / np.sqrt(x.var(axis=space, keepdims=True) + eps)
    return out if gamma is None else out * gamma[:, None, None, None] + beta[:, None, None, None]


def leaky(x: np.ndarray, slope: float = 0.01) -> np.ndarray:
    return np.where(x > 0, x, slope * x)


class UNet:
    """An encoder-decoder built from a layer list; ``weights`` by key, convolutions with the input channel last.

    Takes a patch, or several of one size along a first axis.
    """

    batched = True

    def __init__(self, arch: Architecture, weights: dict[str, np.ndarray]) -> None:
        self.arch, self.w = arch, weights

    def _block(self, x: np.ndarray, key: str, stride: tuple[int, ...] = (1, 1, 1), act: bool = True) -> np.ndarray:
        get = self.w.get
        out = normed(conv(x, self.w[f"{key}.conv.weight"], get(f"{key}.conv.bias"), stride), get(f"{key}.norm.weight"), get(f"{key}.norm.bias"), self.arch.eps)
        return leaky(out, self.arch.slope) if act else out

    def _residual(self, x: np.ndarray, key: str, stride: tuple[int, ...]) -> np.ndarray:
        out = self._block(self._block(x, f"{key}.conv1", stride), f"{key}.conv2", act=False)
        if max(stride) > 1:
            size = [n // s for n, s in zip(x.shape[-3:], stride)]
            x = x[..., : size[0] * stride[0], : size[1] * stride[1], : size[2] * stride[2]]
            x = x.reshape(*x.shape[:-3], size[0], stride[0], size[1], stride[1], size[2], stride[2]).mean(axis=(-5, -3, -1))
        skip = self._block(x, f"{key}.skip", act=False) if f"{key}.skip.conv.weight" in self.w else x
        return leaky(out + skip, self.arch.slope)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, skips = self.arch, []
        if a.residual:
            x = self._block(x, "encoder.stem.convs.0")
        for s in range(a.n_stages):
            for n in range(a.encoder_convs[s]):
                stride = a.strides[s] if n == 0 else (1, 1, 1)
                x = self._residual(x, f"encoder.stages.{s}.blocks.{n}", stride) if a.residual else self._block(x, f"encoder.stages.{s}.convs.{n}", stride)
            skips.append(x)
        scores = []
        for s in range(a.n_stages - 1):
            x = conv_up(x, self.w[f"decoder.transpconvs.{s}.weight"], self.w.get(f"decoder.transpconvs.{s}.bias"))
            x = np.concatenate([x, skips[-(s + 2)]], axis=-4)
            for n in range(a.decoder_convs[s]):
                x = self._block(x, f"decoder.stages.{s}.convs.{n}")
            if a.deep_supervision or s == a.n_stages - 2:
                scores.append(conv(x, self.w[f"decoder.seg_layers.{s}.weight"], self.w.get(f"decoder.seg_layers.{s}.bias")))
        return scores[-1]  # the finest; coarser ones are for training


class Mirrored:
    """The mean of a network over all mirrored passes."""

    def __init__(self, network: Network, axes: tuple[int, ...]) -> None:
        self.network, self.subsets = network, axis_subsets(axes)
        self.batched = getattr(network, "batched", False)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        turn = lambda y, a: np.flip(y, [i - 3 for i in a]) if a else y
        return sum(turn(self.network(turn(x, a)), a) for a in self.subsets) / len(self.subsets)


def mirrored(network: Network, axes: tuple[int, ...]) -> Network:
    return Mirrored(network, axes)


def batched(network: Network) -> Network:
    """The network over several patches at once, one after another if it takes only one."""
    return network if getattr(network, "batched", False) else lambda xs: np.stack([network(x) for x in xs])


class Carried:
    """A network that travels with the task."""

    def __init__(self, value: Network) -> None:
        self.value = value


def shared(rows: DataFrame, network: Network):
    """The network as a ``value`` in the tasks: a model's weights go once to an executor, plain functions travel with the task."""
    inner = network.network if isinstance(network, Mirrored) else network
    return rows.sparkSession.sparkContext.broadcast(network) if isinstance(inner, UNet) else Carried(network)


def doubles(rows: DataFrame, binary: str, name: str) -> DataFrame:
    """``rows`` with the numbers of a column of bytes as an array."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index(binary))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(b) // 8 for b in bodies.to_pylist()])]).astype(np.int32))
            values = pa.array(np.frombuffer(b"".join(bodies.to_pylist()), "<f8"))
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(offsets, values)], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(opened, f"{kinds}, `{name}` array<double>")


SCORES = "volume_id string, pid bigint, z int, y int, x int, d0 int, d1 int, d2 int, ls array<double>"


def predict_patches(voxels: DataFrame, shape: Triple | list[Column], patch: Triple, step: float, network: Network, channels: int = 1, axes: tuple[int, ...] = ()) -> DataFrame:
    """Class scores ``ls`` of every voxel in every patch.  A group is one patch: as many voxels as the patch has."""
    given = shared(voxels, network)

    def run(group: pa.Table) -> pa.Table:
        z, y, x, d0, d1, d2, c = (group.column(n).to_numpy() for n in ("z", "y", "x", "d0", "d1", "d2", "c"))
        box = np.zeros((channels, *patch))
        box[c, d0, d1, d2] = group.column("v").to_numpy()
        model = given.value
        model = mirrored(model, axes) if axes else model
        scores = model(box)
        one = c == 0
        flat = scores[:, d0[one], d1[one], d2[one]].T.astype(np.float64)
        offsets = pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32))
        cols = [group.column(n).combine_chunks().filter(pa.array(one)) for n in ("volume_id", "pid", "z", "y", "x", "d0", "d1", "d2")]
        return pa.table([*cols, pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], names=["volume_id", "pid", "z", "y", "x", "d0", "d1", "d2", "ls"])

    return patches(voxels, shape, patch, step).groupBy("volume_id", "pid").applyInArrow(run, SCORES)
