"""Vectorised word scanning and hashing of Arrow text columns.

Helpers for the Arrow-batched operators: they see one record batch at a time,
work in slices of about a megabyte and never loop over single words.  A text is
its UTF-8 bytes; null counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SLICE = 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift, multiply) over unsigned 64-bit values."""
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    return h ^ (h >> _U64(32))


def _byte_values(seed: int, fold_case: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=_U64) * _MULTIPLIER + _U64(seed))
    if fold_case:
        values[65:91] = values[97:123]
    return values


def _word_table(words: str) -> np.ndarray:
    """Which bytes belong to a word: ``space`` splits at ASCII blanks, ``alnum`` keeps
    ASCII letters, digits and every byte of a non-ASCII character, ``letter`` drops digits."""
    keep = np.ones(256, dtype=bool)
    if words == "space":
        keep[[9, 10, 11, 12, 13, 32]] = False
    else:
        keep[:128] = False
        keep[65:91] = keep[97:123] = True
        keep[48:58] = words == "alnum"
    return keep


TABLES = {w: _word_table(w) for w in ("space", "alnum", "letter")}
VALUES = {fold: _byte_values(7, fold) for fold in (True, False)}


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    base = 0x5851F42D4C957F2D

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _SLICE + (1 << 12))
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate([[_U64(1)], np.full(size - 1, _U64(b))])) for b in (self.base, inverse))
        return self.up, self.down


_powers = _Powers()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its ``n + 1`` offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    if column.null_count:  # a null may cover bytes that mean nothing
        null = column.is_null().to_numpy(zero_copy_only=False)
        if (np.diff(at)[null] > 0).any():
            sizes = np.where(null, 0, np.diff(at))
            raw = np.concatenate([raw[a:b] for a, b, x in zip(at[:-1], at[1:], null) if not x] or [raw[:0]])
            at = np.concatenate([[0], np.cumsum(sizes)])
    return raw, at


def slices(offsets: np.ndarray, most: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 * _SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut into smaller ones of at most ``most`` bytes of the text column, or of one longer text."""
    for batch in batches:
        for a, b in slices(flat(batch.column(text))[1], most):
            yield batch.slice(a, b - a)


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and the index of the first word of each text (``n + 1`` of them)."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = table[raw]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    for edge in np.unique(offsets):  # a word never crosses a text's edge
        if 0 < edge < len(raw) and inside[edge] and inside[edge + 1]:
            begins[edge] = ends[edge] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.searchsorted(starts, offsets)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span; spans must be sorted and disjoint."""
    out = np.empty(len(starts), dtype=_U64)
    values, i = VALUES[fold_case], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _powers.upto(high - low + 1)
        total = np.zeros(high - low + 1, dtype=_U64)
        np.cumsum(values[raw[low:high]] * up[: high - low], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U64))
        i = j
    return out


def text_words(raw: np.ndarray, offsets: np.ndarray, words: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """Case-folded word hashes of all texts, one after another, and the ``n + 1`` places where a text begins."""
    starts, ends, first = word_spans(raw, offsets, TABLES[words])
    return hash_spans(raw, starts, ends), first


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words of one text, in order and with repeats.

    A shorter text is one shingle, told from longer ones by its length; no words, no shingles.
    """
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    total = np.full(n - k + 1, _U64(k), dtype=_U64)
    for i in range(k):
        total = mix(total) * _U64(0xC2B2AE3D27D4EB4F) + words[i : n - k + 1 + i]
    return mix(total)


def shingle_sets(column: pa.Array, width: int, words: str = "space") -> Iterator[np.ndarray]:
    """For each text the sorted set of its shingle hashes."""
    raw, offsets = flat(column)
    for a, b in slices(offsets):
        base = offsets[a]
        hashes, first = text_words(raw[base : offsets[b]], offsets[a : b + 1] - base, words)
        for k in range(b - a):
            yield np.unique(shingle_hashes(hashes[first[k] : first[k + 1]], width))
