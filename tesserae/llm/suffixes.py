"""Operator 7: exact removal of long repeated byte strings by sampled suffixes.

The classic difference-cover scheme sorts the suffixes at positions 1 and 2 modulo 3,
names them, recurses on the names, merges the remaining suffixes and compares the
prefixes of neighbours.  One exchange of its sample, two thirds of all positions, is some
14 times the input (README), so that scheme is replaced: nothing is sorted by suffix,
nothing recurses and nothing is merged.  What is kept is a sample that equal strings
share, chosen by the content, and names by which they meet:

1. In each ``LENGTH``-byte window the ``GRAM``-byte string of least hash is the sampled
   position.  Equal windows sample at the same offset, the property a difference cover
   is for; neighbouring windows share samples, so a text has one per 69 bytes or so.
2. Samples are named by their hash; a name that occurs once ends the comparison for all
   windows around it.
3. The run of windows that share a sample is hashed over all the bytes it spans; runs
   whose hash occurs again under their name are repeats as a whole.
4. Runs left undecided under a shared name compare the hashes of their single windows.
5. Windows that occur again are the repeats; their spans are put together per document.

Every byte string of ``LENGTH`` bytes is thereby compared with every other one; none is
sampled away: windows are only left out when a part of them is known to be unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, in_arrow, looked_up, stored, with_row
from .text import VALUES, _powers, flat, mix

LENGTH = 200
GRAM = 64
SEGMENT = 1 << 20  # bytes of one text worked on at a time
LONGEST = 256  # windows in a run
CROWD = 4096  # runs under one name compared in one group; more are dealt by window hash

_U = np.uint64
_PLACE = _U((1 << 20) - 1)
RUNS = f"{ROW} bigint, name bigint, span bigint, first bigint, n int, twice boolean"


class Hashes:
    """Hashes of all substrings of one piece of text."""

    def __init__(self, raw: np.ndarray) -> None:
        up, self.down = _powers.upto(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, dtype=_U)
        np.cumsum(VALUES[False][raw] * up[: len(raw)], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(_U))

    def all(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return mix((self.total[size:] - self.total[:n]) * self.down[:n] + _U(size))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def text_runs(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[tuple[np.ndarray, ...]]:
    """Runs of windows with one sample: name, hash of the bytes spanned, first window, number of windows,
    and whether the sample stands at several places of the run, so that it may repeat within itself."""
    out = []
    for at in range(0, max(1, len(raw) - length + 1), SEGMENT):
        piece = raw[at : at + SEGMENT + length - 1]
        if len(piece) < length:
            continue
        hashes = Hashes(piece)
        places = np.arange(len(piece) - gram + 1, dtype=_U) & _PLACE
        least = sliding_least((hashes.all(gram) & ~_PLACE) | places, length - gram + 1)
        name = least & ~_PLACE
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff(np.append(first, len(name)))
        moves = np.concatenate([[0], np.cumsum(least[1:] != least[:-1]), [0]])
        moves[-1] = moves[-2]
        twice = moves[first + size - 1] > moves[first]
        if (size > LONGEST).any():
            times = -(-size // LONGEST)
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            size, twice = np.minimum(np.repeat(size, times) - inner * LONGEST, LONGEST), np.repeat(twice, times)
            first = np.repeat(first, times) + inner * LONGEST
        # the segment's end may hide that a run goes on, and the 20 bits of a place may come around
        twice |= (first + at) // SEGMENT != (first + at + size + length) // SEGMENT
        out.append((name[first], hashes.of(first, first + size - 1 + length), first + at, size, twice))
    return out


def _sampled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RUNS.split(", ")]
    for batch in batches:
        raw, offsets = flat(batch.column(1))
        rows, held = batch.column(0).to_numpy(), []
        for i in range(len(batch)):
            for run in text_runs(raw[offsets[i] : offsets[i + 1]], length):
                held.append((np.full(len(run[0]), rows[i]), *run))
            if held and (sum(len(h[0]) for h in held[-64:]) > 50_000 or i == len(batch) - 1 or len(held) >= 512):
                row, name, span, first, n, twice = (np.concatenate(x) for x in zip(*held))
                held = []
                yield pa.record_batch([pa.array(row), pa.array(name.view(np.int64)), pa.array(span.view(np.int64)), pa.array(first), pa.array(n.astype(np.int32)), pa.array(twice)], names=names)
        if held:
            row, name, span, first, n, twice = (np.concatenate(x) for x in zip(*held))
            yield pa.record_batch([pa.array(row), pa.array(name.view(np.int64)), pa.array(span.view(np.int64)), pa.array(first), pa.array(n.astype(np.int32)), pa.array(twice)], names=names)


ASKED = "array<struct<first: bigint, n: int, name: bigint, known: boolean, deals: int>>"
WINDOWS = f"name bigint, deal int, {ROW} bigint, first bigint, known boolean, places binary, hashes binary"


def _windows(batches: Iterator[pa.RecordBatch], length: int, text: int) -> Iterator[pa.RecordBatch]:
    """The single windows of undecided runs, dealt by hash where a name has a crowd of runs."""
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    for batch in batches:
        raw, offsets = flat(batch.column(text))
        rows, out = batch.column(batch.schema.get_field_index(ROW)).to_pylist(), []
        asked = batch.column(batch.schema.get_field_index("_asked")).to_pylist()
        for i in range(len(batch)):
            body = raw[offsets[i] : offsets[i + 1]]
            for a in asked[i]:
                h = Hashes(body[a["first"] : a["first"] + a["n"] - 1 + length]).all(length)
                place = np.arange(a["n"], dtype="<u2")
                deal = (h % _U(a["deals"])).astype(int) if a["deals"] > 1 else None
                for k in range(a["deals"]):
                    mine = slice(None) if deal is None else deal == k
                    if deal is None or mine.any():
                        out.append((a["name"], k, rows[i], a["first"], a["known"], place[mine].tobytes(), h[mine].tobytes()))
            if len(out) >= 4096 or (out and i == len(batch) - 1):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=names)
                out = []


SPANS = f"{ROW} bigint, start bigint, stop bigint"


def _compared(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of windows that occur again under the same name; rows come sorted by (name, deal)."""
    held: list[pa.RecordBatch] = []
    count = 0

    def settle(rows: pa.Table) -> pa.RecordBatch | None:
        group = rows.column("name").to_numpy(), rows.column("deal").to_numpy()
        hashes, offsets = flat(rows.column("hashes"))
        places, _ = flat(rows.column("places"))
        h, n = np.frombuffer(hashes.tobytes(), "<u8"), np.diff(offsets) // 8
        of = np.repeat(np.arange(len(n)), n)
        key = mix(h ^ mix(group[0].view(_U)[of]))
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=key[order[:1]] ^ _U(1)) != 0
        cls = np.cumsum(new) - 1
        known = rows.column("known").to_numpy(zero_copy_only=False)
        weight = np.bincount(cls, 1.0 + known[of[order]])  # a known run stands for two at least
        again = np.zeros(len(h), dtype=bool)
        again[order] = weight[cls] > 1
        again &= ~known[of]
        at = np.flatnonzero(again)
        if not len(at):
            return None
        where = np.frombuffer(places.tobytes(), "<u2")[at].astype(np.int64) + rows.column("first").to_numpy()[of[at]]
        row = rows.column(ROW).to_numpy()[of[at]]
        order = np.lexsort((where, row))
        where, row = where[order], row[order]
        head = np.concatenate([[True], (np.diff(where) != 1) | (np.diff(row) != 0)])
        tail = np.append(np.flatnonzero(head)[1:], len(where)) - 1
        return pa.record_batch([pa.array(row[head]), pa.array(where[head]), pa.array(where[tail] + length)], names=[ROW, "start", "stop"])

    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= 8192:
            rows = pa.Table.from_batches(held)
            name, deal = rows.column("name").to_numpy(), rows.column("deal").to_numpy()
            ends = np.flatnonzero((name[:-1] != name[-1]) | (deal[:-1] != deal[-1]))
            if len(ends):  # the last group may go on in the next batch
                full = int(ends[-1]) + 1
                if (found := settle(rows.slice(0, full).combine_chunks())) is not None:
                    yield found
                held, count = rows.slice(full).combine_chunks().to_batches(), len(rows) - full
    if held and count:
        if (found := settle(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield found


def repeat_spans(keyed: DataFrame, text: str, length: int = LENGTH) -> DataFrame:
    """Spans (row, start, stop) of bytes inside ``length``-byte strings that start elsewhere too; spans may overlap."""
    place = keyed.columns.index(text)
    runs = stored(in_arrow(keyed.select(ROW, text), lambda it: _sampled(it, length), RUNS), "runs")
    names = runs.groupBy("name").agg(F.count("*").alias("c"), F.max("twice").alias("t")).where("c > 1 OR t").select("name", "c")
    shared = looked_up(runs, stored(names, "names"), ["name"], "c").drop("twice", "c")
    shared = stored(shared, "shared")  # about a sixth of all runs, used three times below
    first = F.min_by(F.struct(ROW, "first", "n"), F.struct(ROW, "first")).alias("r")
    classes = stored(shared.groupBy("name", "span").agg(F.count("*").alias("c"), first), "classes")
    whole = looked_up(shared, classes.where("c > 1").select("name", "span", "c"), ["name", "span"], "c").select(ROW, F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + length).alias("stop"))
    undecided = classes.groupBy("name").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("least = 1")
    undecided = stored(undecided.select("name", "k", F.expr(f"cast((k + {CROWD - 1}) div {CROWD} as int)").alias("deals")), "undecided")
    asked = looked_up(classes, undecided, ["name"], "k")
    wanted = F.struct(F.col("r.first").alias("first"), F.col("r.n").alias("n"), "name", (F.col("c") > 1).alias("known"), "deals")
    per_row = asked.groupBy(F.col(f"r.{ROW}").alias(ROW)).agg(F.collect_list(wanted).alias("_asked"))  # no more than one text's runs
    windows = in_arrow(keyed.join(per_row, ROW).select(*keyed.columns, "_asked"), lambda it: _windows(it, length, place), WINDOWS)
    dealt = windows.repartition("name", "deal").sortWithinPartitions("name", "deal")
    return whole.unionByName(in_arrow(dealt, lambda it: _compared(it, length), SPANS))


def _kept(batches: Iterator[pa.RecordBatch], text: int, bodies: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = flat(batch.column(text))
        place = batch.schema.get_field_index("_spans")
        spans = batch.column(place).to_pylist()
        size, removed, runs, digest, body = np.diff(offsets), [], [], [], []
        for i in range(len(batch)):
            mine = raw[offsets[i] : offsets[i + 1]]
            cut = n = 0
            if spans[i]:
                edge = np.zeros(len(mine) + 1, dtype=np.int64)
                s = np.array([(x["start"], x["stop"]) for x in spans[i]], dtype=np.int64)
                np.add.at(edge, s[:, 0], 1)
                np.add.at(edge, s[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                cut, n = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                mine = mine[~gone]
            kept = mine.tobytes()
            removed.append(cut)
            runs.append(n)
            body.append(kept.decode("utf-8", "ignore")) if bodies else digest.append(hashlib.sha256(kept).hexdigest())
        columns = [c for k, c in enumerate(batch.columns) if k != place]
        names = [n for n in batch.schema.names if n != "_spans"]
        last = ("kept_text", body) if bodies else ("kept_sha256", digest)
        yield pa.record_batch([*columns, pa.array(size), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(last[1], pa.string())], names=[*names, "n_bytes", "n_removed", "n_spans", last[0]])


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, bodies: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``, or
    ``kept_text`` where ``bodies`` (a character cut in two at the edge of a removed span goes whole).

    Each byte covered by a ``length``-byte string that starts anywhere else as well is
    removed, all occurrences alike.  Null text is empty; texts below ``length`` bytes keep
    all; repeated rows are occurrences of each other; columns of ``docs`` that clash with
    the new ones are left out; an empty table gives an empty result.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_text" if bodies else "kept_sha256"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (*new, ROW, "_asked", "_spans")])
    keyed = with_row(docs)
    spans = repeat_spans(keyed, text, length).groupBy(ROW).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    joined = keyed.join(spans, ROW, "left").select(*keyed.columns, "_spans")
    place = keyed.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema), "n_bytes bigint, n_removed bigint, n_spans bigint", f"{new[-1]} string"])
    return in_arrow(joined, lambda it: _kept(it, place, bodies), schema).drop(ROW)
