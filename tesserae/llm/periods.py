"""Operator 11: runs of words that repeat with a period, by harmonic grid probing.

A stretch in which words ``p`` apart are equal and that is ``2p`` long holds two neighbouring
multiples of ``p``.  So for every period only the words at ``jp`` and ``(j+1)p`` are compared,
``n/p`` of them, which makes ``n log n`` tests for all periods of a text (the harmonic
sum).  Where two neighbouring tests succeed, a few words between them are tried, and what
survives is extended both ways by comparing arrays chunk by chunk.  Grid points inside a
run found before, of a period that divides the one tried, are skipped: by Fine and Wilf's
theorem what they belong to has the smaller period.

Texts are independent of each other: no row is shuffled, and a task holds one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .text import pieces

LEAST = 24  # words of a run
TIMES = 3  # periods of a run, at least
GRID = 1 << 18  # points probed together
BETWEEN = 16  # words tried between two grid points before a survivor is extended
CHUNK = 64  # words compared at first when extending; doubles up to GRID


def _forward(w: np.ndarray, i: int, p: int) -> int:
    """The first place from ``i`` on whose word differs from the one ``p`` later, or where that one is missing."""
    last, size = len(w) - p, CHUNK
    while i < last:
        same = w[i : min(i + size, last)] == w[i + p : min(i + size, last) + p]
        if not same.all():
            return i + int(same.argmin())
        i, size = i + len(same), min(2 * size, GRID)
    return last


def _backward(w: np.ndarray, i: int, p: int) -> int:
    """The first place of the stretch of places before ``i`` whose words equal the ones ``p`` later."""
    size = CHUNK
    while i > 0:
        a = max(0, i - size)
        differs = w[a:i] != w[a + p : i + p]
        if differs.any():
            return i - int(differs[::-1].argmax())
        i, size = a, min(2 * size, GRID)
    return 0


def _survivors(w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points of the periods ``low`` up to ``high`` that may lie in a run, and their periods."""
    counts = (len(w) - 1) // np.arange(low, high)
    p = np.repeat(np.arange(low, high), counts)
    at = (np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)) * p
    same = w[at] == w[at + p]
    kept = np.flatnonzero(same[:-1] & same[1:] & (p[:-1] == p[1:]))
    for k in range(1, BETWEEN + 1):
        if not len(kept):
            break
        between = at[kept] + k * p[kept] // (BETWEEN + 1)
        kept = kept[w[between] == w[between + p[kept]]]
    return at[kept], p[kept]


def word_runs(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``w``, by start and period; ``times`` is 3 or more.

    A run has its smallest period, is at least ``least`` and ``times`` periods long and
    cannot be made longer by a neighbouring word.
    """
    n, low, runs = len(w), 1, []
    inside: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends of the runs found, by period
    most = n // times if n >= least else 0
    while low <= most:
        # a block of periods with about GRID points: n/p of each, so the next periods double at least
        high = min(most, low + max(1, GRID * low // n)) + 1
        at, p = _survivors(w, low, high)
        edges = np.flatnonzero(np.diff(p, prepend=0, append=0)) if len(p) else p
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            period, points = int(p[a]), at[a:b]
            for q, (starts, ends) in inside.items():
                if period % q == 0:
                    k = np.searchsorted(starts, points, side="right") - 1
                    points = points[(k < 0) | (points + period > np.array(ends)[k])]
            reached = 0
            for i in points.tolist():
                if i < reached:
                    continue
                start, reached = _backward(w, i, period), _forward(w, i, period)
                if reached - start + period >= max(least, times * period):
                    runs.append((start, reached - start + period, period))
                    starts, ends = inside.setdefault(period, ([], []))
                    starts.append(start)
                    ends.append(reached + period)
        low = high
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _numbered(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(word, len(ids)) for word in words), np.int64, len(words))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words of no run and of the first period of every run, joined by one blank."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row ``key``, ``n_words``, ``runs`` (structs of start, length and period, by start, then period) and ``collapsed``.

    Words are what stands between ASCII blanks, compared exactly.  ``collapsed`` keeps the
    first period of every run and the words of none, joined by one blank.  Null, empty and
    blank texts have no words, no runs and an empty ``collapsed``; texts of any length are
    taken whole; rows that repeat an id, or have none, are judged apart; other columns are left
    out, whatever their names; an empty table gives an empty result.
    """
    if times < 3:
        raise ValueError("two neighbouring grid points lie in every run of three periods, not in shorter ones")
    run = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            counts, runs, kept = [], [], []
            for body in batch.column(1):
                words = (body.as_buffer().to_pybytes() if body.is_valid else b"").split()  # of bytes: at ASCII blanks alone
                counts.append(len(words))
                own = word_runs(_numbered(words), least, times)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                kept.append(_collapsed(words, own).decode())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, run), pa.array(kept, pa.string())], names=["key", "n_words", "runs", "collapsed"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    source = docs.select(F.col(key), F.col(text).cast("string"))
    return in_arrow(source, found, schema).withColumnRenamed("key", key)
