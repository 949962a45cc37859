"""Tensor files as a data source: ``spark.read.format("tensors")`` and ``df.write.format("tensors")``.

Reading plans from the files' headers alone: tensors are told apart by key before a byte of them is
read, and go to tasks by ranges of about ``RANGE`` bytes, so a large file is read by many.
Conditions on ``key`` (equal, in, starts with) are pushed to the header; the options ``keys`` (comma-separated) and
``prefix`` say the same.
Writing puts files in a folder of the job's own; a commit moves them beside each other under the
path, an abort removes the folder, so a failed job leaves nothing.
"""

from __future__ import annotations

import fnmatch
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .files import opened, write
from .tensors import _TYPES, LAYOUT, encode

SCHEMA = "path string, key string, shape array<int>, data array<float>"
RANGE = 64 << 20  # bytes of tensors a task reads
FILE = 256 << 20  # bytes a task gathers for one file
ARROW = pa.schema([("path", pa.string()), ("key", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float32()))])


@dataclass
class Tensors(InputPartition):
    """Tensors of one file: key, type, shape, first and last byte."""

    path: str
    tensors: list[tuple[str, str, list[int], int, int]]

    def __init__(self, path: str, tensors: list) -> None:
        super().__init__((path, tensors))
        self.path, self.tensors = path, tensors


def found_files(path: str) -> list[str]:
    """The files a path names: itself, those in a folder, or those whose name matches a pattern in its last part."""
    system, name = opened(path)
    folder, _, last = name.rpartition("/")
    if any(c in last for c in "*?["):
        listed = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.path for f in listed if f.is_file and fnmatch.fnmatch(f.base_name, last))
    if system.get_file_info(name).is_file:
        return [name]
    listed = system.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return sorted(f.path for f in listed if f.is_file and f.base_name.endswith(".safetensors"))


def header(system: fs.FileSystem, name: str) -> tuple[dict, int]:
    """A file's header and the place where its tensors begin; nothing else is read."""
    with system.open_input_file(name) as held:
        (size,) = struct.unpack("<Q", held.read_at(8, 0))
        return json.loads(held.read_at(size, 8)), 8 + size


class TensorReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.prefix = options["path"], options.get("prefix", "")
        self.keys = set(options["keys"].split(",")) if options.get("keys") else None
        self.step = int(options.get("range", RANGE))

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                self._narrow({f.value})
            elif isinstance(f, In) and f.attribute == ("key",):
                self._narrow(set(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("key",) and not self.prefix:
                self.prefix = f.value
            else:
                yield f

    def _narrow(self, keys: set[str]) -> None:
        self.keys = keys if self.keys is None else self.keys & keys

    def _asked(self, key: str) -> bool:
        return key.startswith(self.prefix) and (self.keys is None or key in self.keys)

    def partitions(self) -> list[InputPartition]:
        system, _ = opened(self.path)
        out: list[InputPartition] = []
        for name in found_files(self.path):
            held, base = header(system, name)
            layout = held.pop("__metadata__", {}).get("weight_layout")
            if layout != LAYOUT:
                raise ValueError("no weight_layout metadata" if layout is None else f"Unsupported weight_layout {layout!r}")
            some, size = [], 0
            for key, at in sorted(held.items(), key=lambda x: x[1]["data_offsets"]):
                if self._asked(key):
                    a, b = at["data_offsets"]
                    if some and size + b - a > self.step:
                        out.append(Tensors(name, some))
                        some, size = [], 0
                    some.append((key, at["dtype"], list(at["shape"]), base + a, base + b))
                    size += b - a
            if some:
                out.append(Tensors(name, some))
        return out

    def read(self, partition: Tensors) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as held:
            for key, kind, shape, a, b in partition.tensors:
                body = held.read_at(b - a, a)
                data = (np.frombuffer(body, "<u2").astype(np.uint32) << 16).view(np.float32) if kind == "BF16" else np.frombuffer(body, _TYPES[kind]).astype(np.float32)
                yield pa.record_batch([[partition.path], [key], pa.array([shape], pa.list_(pa.int32())), pa.array([data], pa.list_(pa.float32()))], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class TensorWriter(DataSourceArrowWriter):
    """Files of up to ``FILE`` bytes, as many as a task's tensors need."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.limit = int(options.get("file", FILE))
        self.job = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, some, size = Written(), [], 0

        def close() -> None:
            name = f"{uuid.uuid4().hex}.safetensors"
            write(f"{self.job}/{name}", encode(some))
            done.files.append(name)

        for batch in iterator:
            key, shape, data = (batch.column(batch.schema.get_field_index(n)) for n in ("key", "shape", "data"))
            for i in range(len(batch)):
                values = np.asarray(data[i].values.to_numpy(zero_copy_only=False), "<f4")
                if some and size + values.nbytes > self.limit:
                    close()
                    some, size = [], 0
                some.append((key[i].as_py(), shape[i].as_py(), values))
                size += values.nbytes
        if some:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, name = opened(self.path)
        before = found_files(self.path) if self.overwrite else []
        for m in messages:
            for f in m.files if m else ():
                system.move(opened(f"{self.job}/{f}")[1], f"{name}/{f}")
        for f in before:
            system.delete_file(f)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, name = opened(self.job)
        if system.get_file_info(name).type == fs.FileType.Directory:
            system.delete_dir(name)


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options)

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets conditions reach Python sources, without which Spark refuses one that takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorSource)
