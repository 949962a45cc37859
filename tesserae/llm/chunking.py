"""Operator 6: substring dedup by content-defined chunking.

A gear hash rolls over the bytes; a chunk ends where its top bits are zero, which
depends on the last ``REACH`` bytes alone, so an insertion moves the cuts next to it and
no others.  Chunks are deduplicated by digest over the whole corpus: the first
occurrence in the table stays, the others go where a run of them is long enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, in_arrow, looked_up, stored, with_row
from .text import flat, mix

LEAST = 24  # bytes of a chunk, but for a text's last
MEAN = 32  # bytes from there to the next cut, on average
MOST = 1024
REACH = 16  # bytes the gear hash remembers
SHORTEST = 100  # bytes that neighbouring repeated chunks of one text must have together to go

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(48)).astype(np.uint16)
CHUNKS = f"{ROW} bigint, start bigint, size int, digest bigint, check bigint"


def gear(raw: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte, ``h = 2 h + G[byte]``, for all places at once by doubling."""
    h = _GEAR[raw]
    step = 1
    while step < REACH:
        later = h.copy()
        later[step:] += h[:-step] << np.uint16(step)
        h, step = later, step * 2
    return h


def cuts(raw: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Ends of the chunks of one text."""
    n = len(raw)
    bits = int(np.log2(mean))
    marks = np.flatnonzero(gear(raw) >> np.uint16(16 - bits) == 0) + 1
    out, last, i = [], 0, 0
    marks = marks.tolist()
    while n - last > LEAST:
        while i < len(marks) and marks[i] < last + LEAST:
            i += 1
        end = min(marks[i] if i < len(marks) else n, last + MOST, n)
        out.append(end)
        last = end
    if last < n:
        out.append(n)
    return np.array(out, dtype=np.int64)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    for batch in batches:
        raw, offsets = flat(batch.column(1))
        rows, out, held = batch.column(0).to_numpy(), [], 0

        def emit(parts: list) -> pa.RecordBatch:
            row, start, size, digests = (np.concatenate(x) for x in zip(*parts))
            pairs = digests.reshape(-1, 2)
            return pa.record_batch([pa.array(row), pa.array(start), pa.array(size.astype(np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=names)

        for i in range(len(batch)):
            body = raw[offsets[i] : offsets[i + 1]]
            ends = cuts(body)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            text = body.tobytes()
            digest = b"".join(hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist()))
            out.append((np.full(len(ends), rows[i]), starts, ends - starts, np.frombuffer(digest, "<i8")))
            held += len(ends)
            if held > 20_000:
                yield emit(out)
                out, held = [], 0
        if held:
            yield emit(out)


def _kept(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = flat(batch.column(text))
        place = batch.schema.get_field_index("_spans")
        spans = batch.column(place).to_pylist()
        removed, chunks, bodies = [], [], []
        for i in range(len(batch)):
            body = raw[offsets[i] : offsets[i + 1]]
            runs: list[list[int]] = []
            for s in sorted((x["start"], x["size"]) for x in spans[i] or []):
                if runs and runs[-1][1] == s[0]:
                    runs[-1][1] += s[1]
                    runs[-1][2] += 1
                else:
                    runs.append([s[0], s[0] + s[1], 1])
            keep = np.ones(len(body), dtype=bool)
            gone = 0
            for a, b, n in runs:
                if b - a >= SHORTEST:
                    keep[a:b] = False
                    gone += n
            removed.append(int(len(body) - keep.sum()))
            chunks.append(gone)
            bodies.append(body[keep].tobytes().decode("utf-8", "ignore"))
        columns = [c for k, c in enumerate(batch.columns) if k != place]
        names = [n for n in batch.schema.names if n != "_spans"]
        yield pa.record_batch([*columns, pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(chunks, pa.int64()), pa.array(bodies, pa.string())], names=[*names, "n_bytes", "n_removed", "n_chunks_removed", "kept_text"])


def chunk_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``n_bytes``, ``n_removed``, ``n_chunks_removed`` and ``kept_text``.

    Removed are chunks that stand earlier in the corpus (in table order, then by place), in runs of ``SHORTEST`` bytes at least.  A character cut in two at
    the edge of a run goes whole.  Null text is empty; columns that clash with the new
    ones are left out; an empty table gives an empty result.
    """
    new = ("n_bytes", "n_removed", "n_chunks_removed", "kept_text")
    keyed = with_row(docs.drop(*[c for c in docs.columns if c.lower() in (*new, ROW, "_spans")]))
    place = keyed.columns.index(text)
    chunks = stored(in_arrow(keyed.select(ROW, text), _chunked, CHUNKS), "chunks")
    first = chunks.groupBy("digest", "check").agg(F.count("*").alias("c"), F.min(F.struct(ROW, "start")).alias("f")).where("c > 1")
    first = stored(first, "repeated")
    again = looked_up(chunks, first, ["digest", "check"], "c").where(F.struct(ROW, "start") != F.col("f"))
    spans = again.groupBy(ROW).agg(F.collect_list(F.struct("start", "size")).alias("_spans"))  # no more than one text's chunks
    joined = keyed.join(spans, ROW, "left").select(*keyed.columns, "_spans")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema), "n_bytes bigint, n_removed bigint, n_chunks_removed bigint, kept_text string"])
    return in_arrow(joined, lambda it: _kept(it, place), schema).drop(ROW)
