"""Tensor files (safetensors) as rows, and rows as such files.

A file is an eight-byte length, a JSON header and the tensors' bytes.  Reading goes
through Spark's binary source, writing through Hadoop's file system, so any store works.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import write

LAYOUT = "torch_ncdhw"
_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


def decode(content: bytes, check_layout: bool = True) -> list[tuple[str, list[int], np.ndarray]]:
    """The tensors of one file, in the order of its header."""
    (size,) = struct.unpack("<Q", content[:8])
    header = json.loads(content[8 : 8 + size])
    layout = header.pop("__metadata__", {}).get("weight_layout")
    if check_layout and layout is None:
        raise ValueError("no weight_layout metadata")
    if check_layout and layout != LAYOUT:
        raise ValueError(f"Unsupported weight_layout {layout!r}")
    out = []
    for key, at in header.items():
        body = content[8 + size + at["data_offsets"][0] : 8 + size + at["data_offsets"][1]]
        if at["dtype"] == "BF16":
            data = (np.frombuffer(body, "<u2").astype(np.uint32) << 16).view(np.float32)
        else:
            data = np.frombuffer(body, _TYPES[at["dtype"]]).astype(np.float32)
        out.append((key, list(at["shape"]), data))
    return out


def encode(tensors: list[tuple[str, list[int], np.ndarray]], layout: str = LAYOUT) -> bytes:
    header: dict = {"__metadata__": {"weight_layout": layout, "format_version": "1"}}
    at, bodies = 0, []
    for key, shape, data in tensors:
        body = np.asarray(data, "<f4").tobytes()
        header[key] = {"dtype": "F32", "shape": list(map(int, shape)), "data_offsets": [at, at + len(body)]}
        at += len(body)
        bodies.append(body)
    text = json.dumps(header, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(bodies)


def read_safetensors(spark: SparkSession, path: str, check_layout: bool = True) -> DataFrame:
    """``path, key, shape, data`` of all files under a path or pattern; a file goes to one task (model files are far below two gigabytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key, shape, data in decode(content, check_layout):
                    yield pa.record_batch([pa.array([name]), pa.array([key]), pa.array([shape], pa.list_(pa.int32())), pa.array([data], pa.list_(pa.float32()))], names=["path", "key", "shape", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, key string, shape array<int>, data array<float>")


def write_safetensors(tensors: DataFrame, layout: str = LAYOUT) -> int:
    """Writes the rows of each ``path`` as one file, in the task that gathers them; returns how many files.

    A model's tensors are one Arrow group; their values go from its buffers to the file.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key").combine_chunks()
        data = group.column("data").combine_chunks()
        values, ends = data.values.to_numpy(), data.offsets.to_numpy()
        rows = zip(group.column("key").to_pylist(), group.column("shape").to_pylist(), ends[:-1], ends[1:])
        path = group.column("path")[0].as_py()
        return pa.table({"path": [path], "size": [write(path, encode([(k, shape, values[a:b]) for k, shape, a, b in rows], layout))]})

    found = tensors.select("path", "key", "shape", "data").groupBy("path").applyInArrow(run, "path string, size bigint")
    return len(found.select("path").collect())  # a name a file


def write_text(texts: DataFrame) -> int:
    """Writes ``text`` as the file ``path``, a row a file; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [write(path, text.encode()) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([pa.array(sizes, pa.int64())], names=["size"])

    return texts.select("path", "text").mapInArrow(run, "size bigint").count()
