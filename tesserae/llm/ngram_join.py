"""Operator 2: n-gram Jaccard join by vertical partitioning.

Shingles stand in one global order: those of the lower hash range that are not frequent,
then the upper range, then the frequent ones, each by hash.  The order is cut into
fragments at fixed hashes; overlaps are counted fragment by fragment and summed per pair.

* Documents of equal shingle sets are one node from the start.
* Two sets of similarity 0.8 or more share a shingle among the first fifth of each
  (prefix filter), so lists of the nodes under one prefix shingle hold every pair.
* The first fragment groups alike nodes into units of a bounded size; lists are then
  pairs of units, not of documents, and the first fragment's overlap already shows for
  most unit pairs that the rest cannot bring a link.
* Each group's units are first counted against one unit of it alone.  What that links is
  one component; from then on pairs inside a component are not looked at, so a group of
  near copies costs as many unit pairs as it has units, not their square.
* What is left is counted in full, each fragment apart; links join up to components.

Nothing is capped: frequency only moves a shingle back in the order, and units only
bundle work.  Every linked pair lies in a unit pair that is counted in full, or inside
one component by then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, in_arrow, light, looked_up, masked, parts, stored, with_row
from .graphs import components
from .text import flat, mix, pieces, shingle_sets

WIDTH = 5
PERCENT = 80
FREQUENT = 32  # a shingle in more texts than this stands last
MOST_FREQUENT = 1 << 20  # shingles named frequent at most, those in most texts; the list is broadcast
SHORT = 128  # sets up to this size are profiled whole, longer ones over the lower range
UNIT = 128  # nodes of a unit, about
LOOSE = 0.3  # first-fragment similarity that puts two nodes in one unit
GROUP = 1 << 18  # keys of a deal, about
CROWDED = 8  # texts of one task under a shingle from which the task forwards one of them only

_U = np.uint64
_FIRST = _U((1 << 64) // 7)  # the first fragment ends here
_LOWER = _U(5 << 60)  # and the lower range here
_CUTS = [_U((1 << 64) * k // 7) for k in (1, 2, 3, 5)]  # pivots between the fragments counted in full
_KEY = _U(16)  # low bits left out of a shingle's key; keys that meet by chance only add candidates

PROFILE = f"{ROW} bigint, node bigint, n int, small binary, low binary"


def _profile(s: np.ndarray, whole: bool) -> tuple[int, bytes, bytes]:
    """Size of a set, its first fragment in 32 bits a shingle, and the keys of its lower range or all of it."""
    small = np.unique(s[: int(np.searchsorted(s, _FIRST))] >> _U(30)).astype("<u4")
    low = s if whole or len(s) <= SHORT else s[: int(np.searchsorted(s, _LOWER))]
    return len(s), small.tobytes(), (low >> _KEY).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _keys(low: bytes) -> np.ndarray:
    """The keys of a profile, 48 bits each, ascending."""
    out = np.zeros((len(low) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        nodes, cells = [], []
        for s in shingle_sets(batch.column(1), WIDTH):
            nodes.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
            cells.append(_profile(s, False))
        n, small, low = zip(*cells) if cells else ((), (), ())
        yield pa.record_batch([batch.column(0), pa.array(nodes, pa.int64()), pa.array(n, pa.int32()), pa.array(small, pa.binary()), pa.array(low, pa.binary())], names=[ROW, "node", "n", "small", "low"])


def _long_profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2):
        n, small, low = zip(*(_profile(s, True) for s in shingle_sets(batch.column(2), WIDTH))) if len(batch) else ((), (), ())
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(small, pa.binary()), pa.array(low, pa.binary())], names=[ROW, "node", "n", "small", "low"])


def _pack(ascending: np.ndarray) -> bytes:
    """Ascending keys as compressed planes of the bytes of their steps."""
    steps = np.diff(ascending, prepend=_U(0)).astype("<u8")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :6] = np.frombuffer(pa.decompress(blob, decompressed_size=6 * n, codec="zstd", asbytes=True), np.uint8).reshape(6, n).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=_U)


def _first_of(token: np.ndarray) -> np.ndarray:
    """Where each run of equal, sorted tokens begins."""
    return np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)


DEALT = "deal int, size int, tokens binary, counts binary"


def _dealt(batches: Iterator[pa.RecordBatch], deals: int) -> Iterator[pa.RecordBatch]:
    """Counts of the profiles' shingles, combined in the task and dealt by hash."""
    held: list[np.ndarray] = []

    def packed() -> pa.RecordBatch:
        token = np.sort(np.concatenate(held))
        first = _first_of(token)
        count, token = np.diff(np.append(first, len(token))), token[first]
        deal = (mix(token) % _U(deals)).astype(np.int64)
        out = []
        for many in (False, True):
            mine = np.flatnonzero((count > 1) == many)
            mine = mine[np.argsort(deal[mine], kind="stable")]
            edge = np.searchsorted(deal[mine], np.arange(deals + 1))
            out += [(k, b - a, _pack(token[mine[a:b]]), count[mine[a:b]].astype("<u4").tobytes() if many else b"") for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["deal", "size", "tokens", "counts"])

    for batch in batches:
        held.append(_keys(flat(batch.column(0))[0].tobytes()))
        if sum(map(len, held)) > 1 << 19:
            yield packed()
            held = []
    if sum(map(len, held)):
        yield packed()


def _by_deal(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each deal, which come one after another, without their first column."""
    held: list[tuple] = []
    at = None
    for batch in batches:
        for row in _rows(batch, *batch.schema.names):
            if held and row[0] != at:
                yield held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield held


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_deal(batches):
        token = np.concatenate([_unpack(t, n) for n, t, _ in rows])
        count = np.concatenate([np.frombuffer(c, "<u4") if c else np.ones(n, np.uint32) for n, _, c in rows])
        order = np.argsort(token)
        token = token[order]
        first = _first_of(token)
        total = np.add.reduceat(count[order].astype(np.int64), first)
        often = total > FREQUENT
        if often.any():
            yield pa.record_batch([pa.array(token[first][often].view(np.int64)), pa.array(total[often])], names=["token", "df"])


def _deals(spark: SparkSession, keys: int) -> int:
    """Into how many groups so many keys are dealt: groups are held by a task one at a time, partitions never."""
    n = parts(spark)
    return n * max(1, -(-keys // (n * GROUP)))


def _gathered(dealt: DataFrame) -> DataFrame:
    """Rows of one deal together, one deal after another in each partition."""
    n = parts(dealt.sparkSession)
    return dealt.repartitionById(n, F.col("deal") % n).sortWithinPartitions("deal")


def frequent_shingles(profiles: DataFrame, deals: int) -> np.ndarray:
    """The keys of shingles that stand last in the global order, ascending; counted over all texts, bounded in number."""
    dealt = in_arrow(profiles.select("low"), lambda it: _dealt(it, deals), DEALT)
    counted = in_arrow(_gathered(dealt), _frequent, "token bigint, df bigint")
    rows = counted.orderBy(F.desc("df"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy().view(_U))


def _prefix(keys: np.ndarray, n: int, frequent: np.ndarray) -> np.ndarray | None:
    """The first shingles of a set in the global order, one more than may differ; None if the profile is too short to tell."""
    need = n - -(-PERCENT * n // 100) + 1
    place = np.searchsorted(frequent, keys)
    last = frequent[np.minimum(place, len(frequent) - 1)] == keys if len(frequent) else np.zeros(len(keys), bool)
    first = keys[~last & (keys < (_LOWER >> _KEY))]
    if len(first) >= need:
        return first[:need]
    if len(keys) < n:
        return None
    return np.concatenate([first, keys[~last & (keys >= (_LOWER >> _KEY))], keys[last]])[:need]


POSTED = "deal int, done boolean, size int, tokens binary, nodes binary, hubs binary, sizes binary, places binary"
ENTRIES = "token bigint, node bigint, hub bigint"


def _posted(batches: Iterator[pa.RecordBatch], deals: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Prefix postings of a task, dealt by shingle; of a crowd the task forwards the least node and settles the rest itself."""
    held: list[tuple[np.ndarray, int, int]] = []
    names = [c.split()[0] for c in POSTED.split(", ")]
    types = (pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 5)
    turn = 0

    def packed() -> pa.RecordBatch:
        nonlocal turn
        each = [len(h[0]) for h in held]
        spread = lambda k, kind: np.repeat(np.array([h[k] for h in held], kind), each)
        at = np.concatenate([np.arange(n, dtype=np.uint32) for n in each])
        token, node, n, at = _sorted_postings(np.concatenate([h[0] for h in held]), spread(1, np.int64), spread(2, np.uint32), at)
        first = _first_of(token)
        size = np.diff(np.append(first, len(token)))
        crowd = np.repeat(size >= CROWDED, size)
        out = []
        if crowd.any():
            hub = np.repeat(node[first], size)
            turn += 1
            out.append(((turn * 7919 + int(mix(token[:1])[0] % _U(1 << 20))) % deals, True, int(crowd.sum()), _pack(token[crowd]), node[crowd].tobytes(), hub[crowd].tobytes(), b"", b""))
            at[crowd] = _ANYWHERE  # one node stands for many
        send = ~crowd
        send[first] = True
        token, node, n, at = token[send], node[send], n[send], at[send]
        deal = (mix(token) % _U(deals)).astype(np.int64)
        order = np.argsort(deal, kind="stable")
        edge = np.searchsorted(deal[order], np.arange(deals + 1))
        out += [(k, False, b - a, _pack(token[order[a:b]]), node[order[a:b]].tobytes(), b"", _planes(n[order[a:b]]), _planes(at[order[a:b]])) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    for batch in batches:
        for node, n, low in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("node", "n", "low"))):
            if n and (first := _prefix(_keys(low), n, frequent)) is not None:
                held.append((first, node, n))
        if sum(len(h[0]) for h in held) > 1 << 19:
            yield packed()
            held = []
    if held:
        yield packed()


_ANYWHERE = np.uint32(0xFFFFFFFF)


def _planes(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _from_planes(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T).view("<u4").ravel()


def _sorted_postings(token: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Postings in order, each once: copies of a text post alike, but for ``_ANYWHERE``, which wins."""
    order = np.lexsort((~at, node, token))
    token, node = token[order], node[order]
    keep = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
    return [token[keep], node[keep], n[order][keep], at[order][keep]]


def _hopeless(n: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For lists of two: whether what follows the shared shingle in both cannot bring a link.

    Were it the pair's first shared shingle, no earlier one would count; a linked pair
    passes this test at its first, so it stays in one list at least.
    """
    a, b = first, first + 1
    after = np.minimum(n[a].astype(np.int64) - at[a], n[b].astype(np.int64) - at[b])
    need = -(-PERCENT * (n[a].astype(np.int64) + n[b]) // (100 + PERCENT))
    return (after < need) & (at[a] != _ANYWHERE) & (at[b] != _ANYWHERE)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of two nodes or more, as rows with the list's least node as hub."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def cut(token: np.ndarray, node: np.ndarray, hub: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(token), 50_000):
            s = slice(i, i + 50_000)
            yield pa.record_batch([pa.array(token[s].view(np.int64)), pa.array(node[s]), pa.array(hub[s])], names=names)

    for rows in _by_deal(batches):
        held = []
        for done, size, tokens, nodes, hubs, sizes, places in rows:
            mine = _unpack(tokens, size), np.frombuffer(nodes, "<i8")
            if done:
                yield from cut(*mine, np.frombuffer(hubs, "<i8"))
            else:
                held.append((*mine, _from_planes(sizes, size), _from_planes(places, size)))
        if held:
            token, node, n, at = _sorted_postings(*(np.concatenate(x) for x in zip(*held)))
            first = _first_of(token)
            size = np.diff(np.append(first, len(token)))
            several = size > 1
            two = np.flatnonzero(size == 2)
            several[two[_hopeless(n, at, first[two])]] = False
            several = np.repeat(several, size)
            yield from cut(token[several], node[several], np.repeat(node[first], size)[several])


def _lacking(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(row, node) for row, node, n, low in zip(*(batch.column(k).to_pylist() for k in range(4))) if n > SHORT and _prefix(_keys(low), n, frequent) is None]
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=[ROW, "node"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose first fragments are loosely similar."""
    for batch in batches:
        a, b, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "x", "y"))
        keep = []
        for s, t in zip(x.to_pylist(), y.to_pylist()):
            s, t = np.frombuffer(s, "<u4"), np.frombuffer(t, "<u4")
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(both > 0 and both >= LOOSE * (len(s) + len(t) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.record_batch([a.filter(keep), b.filter(keep)], names=["a", "b"])


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of ``xs`` shares with each of ``ys``."""
    out = np.zeros((len(xs), len(ys)), dtype=np.int32)
    if len(xs) == 1 and len(ys) == 1:
        out[0, 0] = len(np.intersect1d(xs[0], ys[0], assume_unique=True))
        return out
    token = np.concatenate(ys)
    owner = np.repeat(np.arange(len(ys)), [len(y) for y in ys])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for i, x in enumerate(xs):
        low, high = np.searchsorted(token, x, side="left"), np.searchsorted(token, x, side="right")
        size = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(x) else np.zeros(0, int)
        out[i] = np.bincount(owner[at], minlength=len(ys))
    return out


def _required(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least overlap of sets of ``n`` and ``m`` shingles that links them."""
    return -(-PERCENT * (n[:, None] + m[None, :]) // (100 + PERCENT))


def _members(unit: list[dict], kind: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return np.array([m["node"] for m in unit], np.int64), np.array([m["n"] for m in unit], np.int64), [np.frombuffer(m["part"], kind) for m in unit]


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """One row at a time: units can be large."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return (tuple(c[i].as_py() for c in columns) for i in range(len(batch)))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit pairs in which the first fragment leaves room for a link."""
    for batch in batches:
        us, vs, keep = [], [], []
        for u, v, left, right in _rows(batch, "u", "v", "left", "right"):
            (a, n, x), (b, m, y) = _members(left, "<u4"), _members(right, "<u4")
            rest = np.minimum((n - [len(s) for s in x])[:, None], (m - [len(s) for s in y])[None, :])
            room = overlaps(x, y) + rest >= _required(n, m)
            room &= a[:, None] != b[None, :]
            if room.any():
                us.append(u)
                vs.append(v)
        yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


CELLS = "node bigint, n int, fragment int, part binary"
PARTIAL = "u bigint, v bigint, fragment int, at binary, shared binary, left binary, right binary, ns binary, ms binary"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets cut at the pivots of the global order."""
    for batch in pieces(batches, 2):
        out = []
        for node, s in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(2), WIDTH)):
            edges = [0, *np.searchsorted(s, _CUTS).tolist(), len(s)]
            out += [(node, len(s), k, s[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["node", "n", "fragment", "part"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps within one fragment, for every pair of a unit pair that has any."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6)
    names = [c.split()[0] for c in PARTIAL.split(", ")]
    out, size = [], 0
    for batch in batches:
        for u, v, f, left, right in _rows(batch, "u", "v", "fragment", "left", "right"):
            left, right = sorted(left, key=lambda m: m["node"]), sorted(right, key=lambda m: m["node"])
            (a, n, x), (b, m, y) = _members(left, "<u8"), _members(right, "<u8")
            shared = overlaps(x, y).ravel()
            at = np.flatnonzero(shared)
            out.append((u, v, f, at.astype("<u4").tobytes(), shared[at].astype("<u4").tobytes(), a.tobytes(), b.tobytes(), n.tobytes(), m.tobytes()))
            size += 8 * len(at)
            if size > 1 << 22:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out, size = [], 0
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


LINKS = "a bigint, b bigint, n bigint"


def _summed(batches: Iterator[pa.RecordBatch], degrees: bool) -> Iterator[pa.RecordBatch]:
    """Links of each unit pair from the sums of its fragments' overlaps; a spanning forest of them is enough for components.

    With ``degrees`` a row without ``b`` says besides how many nodes of the other unit ``a`` is linked with.
    """
    for batch in batches:
        left_out, right_out = [], []
        nodes, counts = [], []
        for (cells,) in _rows(batch, "cells"):
            a, b, n, m = (np.frombuffer(cells[0][k], "<i8") for k in ("left", "right", "ns", "ms"))
            total = np.zeros(len(a) * len(b), dtype=np.int64)
            for cell in cells:
                total[np.frombuffer(cell["at"], "<u4")] += np.frombuffer(cell["shared"], "<u4")
            total = total.reshape(len(a), len(b))
            linked = (total >= _required(n, m)) & (a[:, None] != b[None, :])
            parent: dict[int, int] = {}
            for i, j in zip(*np.nonzero(linked)):
                x, y = int(a[i]), int(b[j])
                rx, ry = _root(parent, x), _root(parent, y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    left_out.append(x)
                    right_out.append(y)
            if degrees:
                sides = [(a, linked.sum(axis=1))] + [(b, linked.sum(axis=0))] * (not np.array_equal(a, b))  # a unit with itself has one side
                for side, count in sides:
                    nodes.append(side[count > 0])
                    counts.append(count[count > 0])
        yield pa.record_batch([pa.array(left_out, pa.int64()), pa.array(right_out, pa.int64()), pa.nulls(len(left_out), pa.int64())], names=["a", "b", "n"])
        if nodes:
            node = np.concatenate(nodes)
            yield pa.record_batch([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(np.concatenate(counts).astype(np.int64))], names=["a", "b", "n"])


def _root(parent: dict[int, int], x: int) -> int:
    while x in parent:
        parent[x] = parent.get(parent[x], parent[x])
        x = parent[x]
    return x


def _bundled(rows: DataFrame) -> DataFrame:
    """``rows`` (``node``, ``label``, more) with ``unit``: about ``UNIT`` nodes of one label; a node without label is a unit by itself."""
    rows = stored(rows, "rows")
    sizes = stored(rows.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("_size")), "sizes")
    place = F.pmod(F.xxhash64("node"), F.expr(f"(_size + {UNIT - 1}) div {UNIT}"))
    together = looked_up(rows, sizes, ["label"], "_size").withColumn("unit", F.xxhash64("label", place)).drop("_size")
    return together.unionByName(rows.where("label IS NULL").withColumn("unit", F.col("node")))


def _units(first: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``node``, ``n``, ``label``, ``alike``, ``unit``: bundles of nodes whose pairs are looked at together.

    Nodes of one loose group go together (``alike``); the others of long lists by the
    longest list they stand in; what is left is a unit by itself.
    """
    loose = components(edges).select(F.col("v").alias("node"), F.col("label").alias("g"))
    long = stored(entries.groupBy("token").agg(F.count("*").alias("c")).where(f"c >= {UNIT // 8}"), "long")
    lists = looked_up(entries, long, ["token"], "c").groupBy("node").agg(F.max(F.struct("c", "token"))["token"].alias("t"))
    rows = first.select("node", "n").join(loose, "node", "left").join(lists, "node", "left")
    label = F.coalesce(F.when(F.col("g").isNotNull(), F.xxhash64(F.lit("group"), "g")), F.when(F.col("t").isNotNull(), F.xxhash64(F.lit("list"), "t")))
    return _bundled(rows.select("node", "n", F.col("g").isNotNull().alias("alike"), label.alias("label")))


def _spokes(units: DataFrame) -> DataFrame:
    """Unit pairs that connect most of a loose group: every unit with itself and with its group's first unit."""
    each = stored(units.groupBy("unit").agg(F.first("label").alias("label"), F.first("alike").alias("alike"), F.count("*").alias("size")), "each")
    hubs = stored(each.where("alike").groupBy("label").agg(F.min("unit").alias("hub"), F.count("*").alias("_size")), "hubs")
    spokes = looked_up(each.where("alike"), hubs, ["label"], "_size").where("unit <> hub").select(F.col("hub").alias("u"), F.col("unit").alias("v"))
    return spokes.unionByName(each.where("size > 1").select(F.col("unit").alias("u"), F.col("unit").alias("v")))


def _meeting(entries: DataFrame, units: DataFrame) -> DataFrame:
    """Unit pairs under one shingle whose sizes may link and that are not of one component already.

    Components meet first, a row each and shingle, so a large one is one row there; only
    those that meet another are taken apart into their units again.
    """
    listed = entries.join(units, "node").groupBy("token", "owner", "unit")
    listed = listed.agg(F.min("n").alias("low"), F.max("n").alias("high"), (~F.first("kin") & (F.min("node") < F.max("node"))).alias("several"))
    listed = stored(listed, "listed")
    owners = listed.groupBy("token", "owner").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    fits = f"{PERCENT} * a_low <= 100 * b_high AND {PERCENT} * b_low <= 100 * a_high"
    side = lambda df, s: df.toDF("token", s, f"{s}_low", f"{s}_high")
    met = side(owners, "a").join(side(owners, "b"), "token").where(f"a < b AND {fits}").select("token", F.col("a").alias("left"), F.col("b").alias("right"))
    apart = listed.select("token", "owner", F.col("unit"), "low", "high")
    u = apart.toDF("token", "left", "u", "a_low", "a_high")
    v = apart.toDF("token", "right", "v", "b_low", "b_high")
    across = met.join(u, ["token", "left"]).join(v, ["token", "right"]).where(fits).select("u", "v")
    return across.unionByName(listed.where("several").select(F.col("unit").alias("u"), F.col("unit").alias("v"))).distinct()


class _Found(NamedTuple):
    """What the prefix filter leaves to compare, all of it stored."""

    keyed: DataFrame  # _row, _key, _text
    profiles: DataFrame  # PROFILE
    entries: DataFrame  # ENTRIES
    chosen: DataFrame  # a node of the entries and the first row that has it
    first: DataFrame  # node, n, part: sizes and first fragments
    units: DataFrame  # node, n, alike, label, unit


def _found(docs: DataFrame, key: str, text: str) -> _Found:
    keyed = with_row(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")))
    spark = docs.sparkSession
    profiles = stored(in_arrow(keyed.select(ROW, "_text"), _profiles, PROFILE), "profiles")
    size, asked = profiles.agg(F.coalesce(F.sum(F.length("low")) / 6, F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = spark.sparkContext.broadcast(frequent_shingles(profiles, _deals(spark, int(size))))
    deals = _deals(spark, asked * (100 - PERCENT) // 100)
    lacking = stored(in_arrow(profiles.select(ROW, "node", "n", "low"), lambda it: _lacking(it, frequent.value), f"{ROW} bigint, node bigint"), "lacking")
    longer = in_arrow(keyed.join(light(lacking), ROW).select(ROW, "node", "_text"), _long_profiles, PROFILE)
    posted = in_arrow(profiles.unionByName(longer), lambda it: _posted(it, deals, frequent.value), POSTED)
    entries = stored(in_arrow(_gathered(posted), _listed, ENTRIES), "entries")

    # units: bundles of nodes that the first fragment shows to be alike; a node's copies are joined by row, not by node
    rows_of = profiles.groupBy("node").agg(F.min(ROW).alias(ROW))
    chosen = stored(entries.select("node").distinct().join(rows_of, "node"), "chosen")
    first = stored(profiles.select(ROW, "n", F.col("small").alias("part")).join(light(chosen), ROW).drop(ROW), "first")
    pairs = entries.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    both = pairs.join(first.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("part").alias("x")), "a")
    both = both.join(first.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("part").alias("y")), "b")
    alike = in_arrow(both.where("na <= 2 * nb AND nb <= 2 * na"), _alike, "a bigint, b bigint")
    units = stored(_units(first, alike, entries), "units")
    return _Found(keyed, profiles, entries, chosen, first, units)


def _links(pairs: DataFrame, units: DataFrame, found: _Found, degrees: bool = False) -> DataFrame:
    """Links between the nodes of each unit pair: fragment by fragment, then summed."""
    pairs = stored(pairs, "pairs")
    either = lambda df: df.select(F.col("u").alias("unit")).union(df.select("v")).distinct()
    bundles = units.join(either(pairs), "unit").select("node", "unit").join(found.first, "node").groupBy("unit").agg(F.collect_list(F.struct("node", "n", "part")).alias("members"))
    sides = pairs.join(bundles.toDF("u", "left"), "u").join(bundles.toDF("v", "right"), "v")
    open_pairs = stored(in_arrow(sides, _possible, "u bigint, v bigint"), "open")
    asked = stored(units.join(either(open_pairs), "unit").select("node").join(found.chosen, "node"), "asked")
    whole = in_arrow(found.keyed.join(light(asked), ROW).select(ROW, "node", "_text"), _fragments, CELLS)
    cells = whole.join(units.select("node", "unit"), "node")
    cells = stored(cells.groupBy("unit", "fragment").agg(F.collect_list(F.struct("node", "n", "part")).alias("members")), "cells")
    counted = open_pairs.join(cells.toDF("u", "fragment", "left"), "u").join(cells.toDF("v", "fragment", "right"), ["v", "fragment"])
    partial = in_arrow(counted.select("u", "v", "fragment", "left", "right"), _partial, PARTIAL)
    summed = partial.groupBy("u", "v").agg(F.collect_list(F.struct("at", "shared", "left", "right", "ns", "ms")).alias("cells"))  # one cell a fragment
    return stored(in_arrow(summed, lambda it: _summed(it, degrees), LINKS), "links")


def _classed(found: _Found, links: DataFrame, key: str) -> DataFrame:
    """Every row with its set's size, component and ``node``, the least id of a component as its name."""
    rows = found.profiles.where("n > 0").select(ROW, "node", "n")
    sets = rows.groupBy("node").agg(F.count("*").alias("_copies")).join(components(links).toDF("node", "label"), "node", "left")
    sets = stored(sets.select("node", F.coalesce("label", "node").alias("label"), "_copies"), "sets")
    placed = looked_up(rows, sets, ["node"], "_copies").select(ROW, "node", "n", "label").join(found.keyed.select(ROW, "_key"), ROW)
    placed = stored(placed, "placed")
    least = stored(placed.groupBy("label").agg(F.min("_key").alias("component_id"), F.count("*").alias("_size")), "least")
    joined = looked_up(placed, least, ["label"], "_size")
    joined = joined.select(ROW, "_key", F.col("n").cast("long").alias("n_shingles"), "component_id", "label", "node")
    alone = found.keyed.select(ROW, "_key").join(found.profiles.where("n = 0").select(ROW), ROW)
    none = F.lit(None).cast("long")
    alone = alone.select(ROW, "_key", F.lit(0).cast("long").alias("n_shingles"), F.col("_key").alias("component_id"), none.alias("label"), none.alias("node"))
    return joined.unionByName(alone).withColumnRenamed("_key", key)


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as (``_row``, key, ``n_shingles``, ``component_id``, ``label``).

    Linked are sets with ``100 * intersection >= 80 * union`` of the distinct five-word
    shingles (fewer words: all of them as one); null or wordless texts have none and link
    with nothing.  ``component_id`` is the least id reachable; rows with a null id take
    part and show the least id of the others, null if there is none;
    ``label`` names a component by itself and is null for rows without shingles.  Repeated rows are
    linked like any equal texts; an empty table gives an empty result.
    """
    found = _found(docs, key, text)
    # what the hub of a group links needs no further pairs; the rest of its units meet by shingle
    links = _links(_spokes(found.units), found.units, found)
    kin = components(links).toDF("node", "c")
    label = F.when(F.col("c").isNotNull(), F.xxhash64(F.lit("kin"), "c")).when(F.col("label").isNotNull(), F.xxhash64(F.lit("rest"), "label"))
    again = found.units.join(kin, "node", "left").select("node", "n", F.col("c").isNotNull().alias("kin"), label.alias("label"))
    again = _bundled(again).select("node", "n", "kin", F.when(F.col("kin"), F.col("label")).otherwise(F.col("unit")).alias("owner"), "unit")
    again = stored(again, "units")
    links = links.unionByName(_links(_meeting(found.entries, again), again, found))
    return _classed(found, links, key).drop("node")


def near_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``near_components`` with every link counted: ``n_links``, the other sets a row's set is linked
    with, and ``n_equal``, the other rows of the same set.

    Rows without shingles have none of either.  No pair is left out for being of one
    component, so a group of n near copies costs the square of its n/128 units, where
    ``near_components`` costs their number; pairs are counted in the tasks and never
    become rows.  Nulls, repeated rows and empty tables are as there.
    """
    found = _found(docs, key, text)
    units = stored(found.units.select("node", "n", F.lit(False).alias("kin"), F.col("unit").alias("owner"), "unit"), "units")
    counted = _links(_meeting(found.entries, units), units, found, degrees=True)
    rows = stored(_classed(found, counted.where("b IS NOT NULL"), key), "classed")
    linked = counted.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    sets = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("_copies")).join(linked, "node", "left")
    sets = stored(sets.select("node", "_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("_copies") - 1).alias("n_equal")), "sets")
    alone = rows.where("node IS NULL").withColumns({"n_links": F.lit(0).cast("long"), "n_equal": F.lit(0).cast("long")})
    return looked_up(rows, sets, ["node"], "_copies").drop("_copies").unionByName(alone).drop("node")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the least id (of equal or null ids, the first in the table).

    Rows without words stay, all of them.  All columns stay, whatever their names.
    """
    plain = masked(docs)
    name = dict(zip(docs.columns, plain.columns))
    found = near_components(plain, name[key], name[text]).where("label IS NOT NULL")
    found = stored(found.select(ROW, "label", F.col(name[key]).alias("_key")), "found")
    first = F.min_by(ROW, F.struct(F.col("_key").isNull(), "_key", ROW)).alias(ROW)
    kept = found.groupBy("label").agg(first)
    extra = stored(found.join(kept, ROW, "left_anti").select(ROW), "extra")
    return with_row(plain).join(light(extra), ROW, "left_anti").select(*plain.columns).toDF(*docs.columns)
