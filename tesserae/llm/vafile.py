"""Operator 12: hard negatives by a vector-approximation file.

The file holds the vectors in blocks.  In a block every dimension is quantised into 64 cells of
like population, and a cell keeps the least and greatest component it really holds; a
vector's approximation is a byte a dimension.  An anchor brings two tables a block: what
each cell of each dimension adds to an inner product at least and at most.  The sums of
the entries looked up bound every score of the block, and only vectors that may enter
what is asked for are scored exactly, in integers.

* Positives: only vectors whose upper bound reaches the k-th greatest lower bound.
* Negatives: only vectors whose bounds reach into the window of scores below a positive,
  and, where k vectors are surely inside it, reach the k-th greatest of their lower bounds.

Blocks of anchors meet blocks of vectors; a meeting leaves k rows an anchor (and window) at
most, of which a ranking that is cut before its exchange keeps the first k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, parts, stored

BLOCK = 1 << 12  # vectors; a row is named by its block and its place in it
CELLS = 64
ANCHORS = 1 << 10  # of a block of them, about
BROADCAST = 1 << 22  # components of all anchors up to which they are sent to every executor, 32 MB

FILE = "block bigint, dims int, ids binary, labels binary, anchors binary, low binary, high binary, codes binary, vectors binary"
ANCHOR = "anchor bigint, anchor_id bigint, label bigint, vector array<bigint>"
FOUND = "anchor bigint, k int, id bigint, row bigint, score bigint"


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Approximations of the rows of ``x`` (``dims`` by rows) and the bounds of all cells."""
    n, dims = x.shape
    low, high = np.zeros((2, dims, CELLS), np.int64)
    codes = np.zeros((dims, n), np.uint8)
    for d in range(dims):
        edges = np.sort(x[:, d])[np.arange(1, CELLS) * n // CELLS]
        codes[d] = np.searchsorted(edges, x[:, d], side="right")
        for c in np.unique(codes[d]):
            held = x[codes[d] == c, d]
            low[d, c], high[d, c] = held.min(), held.max()
    return codes, low, high


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}  # by the number of dimensions

    def block(dims: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        nonlocal number
        ids, labels, anchors, x = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(labels, kind="stable")
        ids, labels, anchors, x = ids[order], labels[order], anchors[order], x[order]
        codes, low, high = _quantised(x)
        small = not x.size or max(-int(x.min()), int(x.max())) < 1 << 15
        body = [ids, labels, anchors, low, high, codes, x.astype("<i2" if small else "<i8")]
        number += 1
        return pa.record_batch([pa.array([number - 1], pa.int64()), pa.array([dims], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in body)], names=[c.split()[0] for c in FILE.split(", ")])

    for batch in batches:
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False).astype("<i8") for k in (0, 1))
        anchors = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype("<i8")
        sizes = np.diff(batch.column(3).offsets.to_numpy()).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        for dims in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dims)
            have = held.setdefault(dims, [])
            while len(own):
                room = BLOCK - sum(len(h[0]) for h in have)
                some, own = own[:room], own[room:]
                have.append((ids[some], labels[some], anchors[some], flat[first[some][:, None] + np.arange(dims)]))
                if len(some) == room:
                    yield block(dims, have)
                    have.clear()
    for dims, have in held.items():
        if have:
            yield block(dims, have)


def approximation_file(vectors: DataFrame) -> DataFrame:
    """The stored file of ``id``, ``label``, ``anchor`` and ``vector``: one row a block."""
    return stored(in_arrow(vectors.select("id", "label", "anchor", "vector"), _filed, FILE), "vafile")


class Block:
    """One block of the file, its vectors by label."""

    def __init__(self, number: int, dims: int, ids: bytes, labels: bytes, anchors: bytes, low: bytes, high: bytes, codes: bytes, vectors: bytes) -> None:
        self.dims, self.ids, self.labels = dims, np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        n = len(self.ids)
        self.rows = (number << 12) + np.arange(n)
        self.anchors = np.flatnonzero(np.frombuffer(anchors, bool))
        self.low, self.high = (np.frombuffer(b, "<i8").reshape(-1, CELLS) for b in (low, high))
        codes = np.frombuffer(codes, np.uint8).reshape(dims, n)
        self.entries = np.arange(dims)[:, None] * CELLS + codes  # of an anchor's table
        self.vectors = np.frombuffer(vectors, "<i8" if len(vectors) == 8 * n * dims and n * dims else "<i2").reshape(n, dims)

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())

    def bounds(self, anchor: np.ndarray, some: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of ``some`` vectors, by table lookup."""
        one, other = anchor[:, None] * self.low, anchor[:, None] * self.high
        entries = self.entries[:, some]
        if not entries.size:
            return np.zeros(entries.shape[1], np.int64), np.zeros(entries.shape[1], np.int64)
        return np.take(np.minimum(one, other), entries).sum(0), np.take(np.maximum(one, other), entries).sum(0)

    def scores(self, anchor: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self.vectors[places].astype(np.int64) @ anchor

    def first(self, places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """The places of the ``k`` greatest scores; of equal ones, those of the least id, then row."""
        return np.lexsort((self.rows[places], self.ids[places], -scores))[:k]


def _greatest(values: np.ndarray, k: int) -> int | None:
    """The ``k``-th greatest of the values, if there are so many."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, *body in zip(*(c.to_pylist() for c in batch.columns)):
            b = Block(number, *body)
            at = b.anchors
            yield pa.record_batch([pa.array(b.rows[at]), pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array(list(b.vectors[at].astype(np.int64)), pa.list_(pa.int64()))], names=["anchor", "anchor_id", "label", "vector"])


def _likely_positives(b: Block, row: int, label: int, vector: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first ``k`` other vectors of the anchor's label in the block."""
    own = b.of_label(label)
    least, most = b.bounds(vector, own)
    places = np.arange(own.start, own.stop)
    other = b.rows[own] != row
    places, least, most = places[other], least[other], most[other]
    sure = _greatest(least, k)
    places = places if sure is None else places[most >= sure]
    scores = b.scores(vector, places)
    best = b.first(places, scores, k)
    yield 0, places[best], scores[best]


def _likely_negatives(b: Block, label: int, vector: np.ndarray, asked: list[int], k: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each positive's score, the first ``k`` vectors of other labels whose score lies in its window."""
    least, most = b.bounds(vector)
    allowed = b.labels != label
    maybe = np.zeros(len(allowed), bool)
    for score in asked:
        inside = allowed & (100 * most >= low * score) & (100 * least <= high * score)
        sure = _greatest(least[inside & (100 * least >= low * score) & (100 * most <= high * score)], k)
        maybe |= inside if sure is None else inside & (most >= sure)
    places = np.flatnonzero(maybe)
    scores = b.scores(vector, places)
    for number, score in enumerate(asked):
        held = np.flatnonzero((100 * scores >= low * score) & (100 * scores <= high * score))
        best = held[b.first(places[held], scores[held], k)]
        yield number, places[best], scores[best]


def _met(file: DataFrame, anchors: DataFrame, find) -> DataFrame:
    """What ``find(block, anchor, label, vector, scores)`` returns for every block and anchor.

    The blocks of anchors stay in memory where all of them are small; else both sides are
    dealt by block of anchors and a salt, which spreads the file over all tasks.
    """
    spark = file.sparkSession
    count, size = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-count // ANCHORS))
    salts = max(1, parts(spark) // blocks)
    grouped = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")).groupBy("group")
    grouped = grouped.agg(*[F.collect_list(c).alias(f"a_{c}") for c in ("anchor", "label", "vector", "scores")])  # about ANCHORS of them
    if size <= BROADCAST:
        asked = F.broadcast(grouped.withColumn("salt", F.lit(0)))
    else:
        asked = grouped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.lit(0) if size <= BROADCAST else F.pmod("block", F.lit(salts)).cast("int")
    spread = file.withColumn("salt", salt).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = spread.join(asked, ["group", "salt"]).drop("group", "salt")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                *body, rows, labels, vectors, scores = (c[i].as_py() for c in batch.columns)
                b, out = Block(*body), ([], [], [], [], [])
                for row, label, vector, asked in zip(rows, labels, vectors, scores):
                    if len(vector) == b.dims:
                        for k, places, found in find(b, row, label, np.array(vector, np.int64), asked):
                            for column, values in zip(out, (np.full(len(places), row), np.full(len(places), k), b.ids[places], b.rows[places], found)):
                                column.append(values)
                columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
                yield pa.record_batch([pa.array(c.astype(np.int32 if name == "k" else np.int64)) for name, c in zip(("anchor", "k"), columns)] + [pa.array(c.astype(np.int64)) for c in columns[2:]], names=["anchor", "k", "id", "row", "score"])

    return in_arrow(pairs, scored, FOUND)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and each of its first ``positives`` other vectors of its label, the first ``negatives`` vectors
    of other labels that score between ``low`` and ``high`` hundredths of the positive.

    ``vectors`` has ``id`` and ``label`` (integers), ``anchor`` (boolean) and ``vector`` (array of
    integers).  Scores are inner products in 64 bits; higher ones come first, of equal ones the lesser
    id, then the earlier row.  Rows with a null id, label, vector or component take no part; a null
    ``anchor`` is none; rows that repeat an id are vectors of their own; vectors meet only those of as many
    dimensions; other columns are left out; a pair without negatives has no row; an
    empty table gives an empty result.  Returns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.
    """
    whole = F.expr("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")
    plain = vectors.where(whole).select(F.col("id").cast("long"), F.col("label").cast("long"), F.coalesce("anchor", F.lit(False)).alias("anchor"), F.col("vector").cast("array<bigint>"))
    file = approximation_file(plain)
    anchors = stored(in_arrow(file, _anchors, ANCHOR), "anchors")

    none = anchors.withColumn("scores", F.array().cast("array<bigint>"))
    near = _met(file, none, lambda b, row, label, vector, _: _likely_positives(b, row, label, vector, positives))
    near = _ranked(near, ["anchor"], positives)
    near = stored(near.select("anchor", (F.col("rank") - 1).alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    scores = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    asked = stored(anchors.join(scores, "anchor"), "asked")
    far = _met(file, asked, lambda b, _, label, vector, s: _likely_negatives(b, label, vector, s, negatives, low, high))
    far = _ranked(far, ["anchor", "k"], negatives).select("anchor", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    full = far.join(near, ["anchor", "k"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return full.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
