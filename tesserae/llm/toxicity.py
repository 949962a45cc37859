"""Operator 3: toxicity grades by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(threshold_k - w . x)``: one weight vector over hashed words and word beginnings is
shared by all ordered thresholds.  Documents get the expected grade, ``sum of k P(k)``.

Labels say toxic or not; grades above 0 come from how dense a toxic document is in words
that tell toxic documents from others, cut at the terciles of the learnt sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .quality import held_out
from .text import TABLES, flat, hash_spans, mix, slices, word_spans

DIMENSIONS = 1 << 20
SAMPLE = 8000  # labelled documents learnt from, at most
GRADES = 3  # above 0
BEGINNINGS = (4, 5)  # bytes of a word that count as features besides the word, for inflected forms
SPARSITY = 4e-3  # L1 weight by which words are chosen: those that tell nothing drop out
SEEN = 5  # documents of the sample a feature must stand in
RELAXED = 1e-4  # and by which the chosen ones are fitted again

_U = np.uint64


def word_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words and word beginnings of each text with their counts, and the ``n + 1`` places where a text's begin."""
    starts, ends, first = word_spans(raw, offsets, TABLES["alnum"])
    text_of = np.repeat(np.arange(len(offsets) - 1, dtype=_U), np.diff(first))
    kinds = [hash_spans(raw, starts, ends)]
    kinds += [mix(hash_spans(raw, starts, np.minimum(starts + n, ends)) + _U(n)) for n in BEGINNINGS]
    key = np.sort(np.concatenate([(text_of << _U(20)) | (h >> _U(44)) for h in kinds]))
    fresh = np.flatnonzero(np.diff(key, prepend=key[:1] ^ _U(1)) != 0)
    count = np.diff(np.append(fresh, len(key)))
    key = key[fresh]
    return (key & _U(DIMENSIONS - 1)).astype(np.int64), count, np.searchsorted(key >> _U(20), np.arange(len(offsets), dtype=_U))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    """Shared weights and ordered thresholds, fitted by proximal adaptive gradients."""

    def __init__(self, grades: int = GRADES) -> None:
        self.weights = np.zeros(DIMENSIONS, dtype=np.float32)
        self.thresholds = np.arange(grades, dtype=np.float64) + 1.0

    def probabilities(self, s: np.ndarray) -> np.ndarray:
        """``P(grade = k)`` for k from 0, a column each."""
        below = _sigmoid(self.thresholds[None, :] - s[:, None])
        edges = np.concatenate([np.zeros((len(s), 1)), below, np.ones((len(s), 1))], axis=1)
        return np.maximum(np.diff(edges, axis=1), 1e-12)

    def fit(self, index: np.ndarray, of: np.ndarray, grade: np.ndarray) -> CumulativeLink:
        """``index``: feature of each entry, ``of``: its document.  Features are chosen under a strong
        L1 weight, which also shrinks them, and then fitted again under a weak one."""
        self._descend(index, of, grade, SPARSITY, 200)
        chosen = self.weights[index] > 0
        return self._descend(index[chosen], of[chosen], grade, RELAXED, 300)

    def _descend(self, index: np.ndarray, of: np.ndarray, grade: np.ndarray, sparsity: float, rounds: int, rate: float = 0.3) -> CumulativeLink:
        n, k = len(grade), len(self.thresholds)
        used = np.flatnonzero(np.bincount(index, minlength=DIMENSIONS) >= SEEN)  # a feature of a few documents is dropped by the L1 weight anyway
        place = np.full(DIMENSIONS, -1, dtype=np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        column = place[index]
        of, column = of[column >= 0], column[column >= 0]
        w, seen_w, seen_t = np.zeros(len(used)), np.full(len(used), 1e-6), np.full(k, 1e-6)
        share = np.bincount(grade, minlength=k + 1) / n
        weight = np.where(grade > 0, 0.5 / max(1 - share[0], 1e-9), 0.5 / max(share[0], 1e-9)) / n
        for _ in range(rounds):
            s = np.bincount(of, w[column], n)
            theta = np.concatenate([[-60.0], self.thresholds, [60.0]])
            high, low = _sigmoid(theta[grade + 1] - s), _sigmoid(theta[grade] - s)
            span = np.maximum(high - low, 1e-9)
            gs = (1 - high - low) * weight
            gw = np.bincount(column, gs[of], len(used))
            gt = np.zeros(k + 2)
            np.add.at(gt, grade + 1, -high * (1 - high) / span * weight)
            np.add.at(gt, grade, low * (1 - low) / span * weight)
            seen_w += gw**2
            seen_t += gt[1:-1] ** 2
            step = rate / np.sqrt(seen_w)
            # no word makes a text less severe: with signs, long texts would sum up to anything
            w = np.maximum(w - step * (gw + sparsity), 0)
            moved = self.thresholds - rate / np.sqrt(seen_t) * gt[1:-1]
            self.thresholds = np.maximum.accumulate(moved + 1e-3 * np.arange(k))  # ordered
        self.weights[:] = 0
        self.weights[used] = w
        return self


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = flat(batch.column(1))
        for a, b in slices(offsets):
            base = offsets[a]
            index, count, first = word_features(raw[base : offsets[b]], offsets[a : b + 1] - base)
            cells = [(index[first[i] : first[i + 1]].astype("<u4").tobytes(), count[first[i] : first[i + 1]].astype("<u4").tobytes()) for i in range(b - a)]
            yield pa.record_batch([batch.column(0)[a:b], batch.column(2)[a:b], pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["id", "label", "words", "counts"])


def graded(index: np.ndarray, count: np.ndarray, of: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades of a labelled sample: 0, or 1 upward by the density of telling words among toxic documents."""
    yes = np.bincount(index, toxic[of], DIMENSIONS)
    no = np.bincount(index, 1 - toxic[of], DIMENSIONS)
    odds = (yes + 0.5) / (toxic.sum() + 1) * (len(toxic) - toxic.sum() + 1) / (no + 0.5)
    telling = (yes >= 3) & (odds > 8)
    dense = np.bincount(of, count * telling[index], len(toxic)) / np.maximum(np.bincount(of, count, len(toxic)), 1)
    bounds = np.quantile(dense[toxic == 1], np.arange(1, grades) / grades) if toxic.any() else np.zeros(grades - 1)
    return np.where(toxic == 1, 1 + (dense[:, None] > bounds[None, :]).sum(1), 0).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> CumulativeLink:
    """Fit on at most ``sample`` labelled rows, those of least hashed id; rows that are held out are not learnt from.

    Rows without label or id are left out; of repeated labels the highest counts, of
    repeated documents the least text.  Without
    both labels present every document is graded 0.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(known), F.col("_key") == F.col("_id"))
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))  # at most ``sample``
    kind = labels.schema[key].dataType.simpleString()
    found = in_arrow(rows, _featured, f"id {kind}, label int, words binary, counts binary").toArrow()
    found = found.sort_by("id").combine_chunks()
    toxic, model = found.column("label").to_numpy().astype(np.float64), CumulativeLink()
    if len(set(toxic.tolist())) < 2:
        model.thresholds[:] = 40.0
        return model
    words, offsets = flat(found.column("words"))
    of = np.repeat(np.arange(len(found), dtype=np.int32), np.diff(offsets) // 4)
    index = np.frombuffer(words.tobytes(), "<u4").astype(np.int32)
    count = np.frombuffer(flat(found.column("counts"))[0].tobytes(), "<u4")
    return model.fit(index, of, graded(index, count, of, toxic))


def severities(docs: DataFrame, model: CumulativeLink, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``expected_severity``, ``severity`` (likeliest grade), ``p_toxic``, ``toxic`` for every row.

    Null text is empty; texts of any length are read whole; repeated rows are graded alike;
    other columns are left out; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            s = np.zeros(len(batch))
            for a, b in slices(offsets):
                base = offsets[a]
                index, _, first = word_features(raw[base : offsets[b]], offsets[a : b + 1] - base)
                total = np.concatenate([[0.0], np.cumsum(shared.value.weights[index], dtype=np.float64)])
                s[a:b] = total[first[1:]] - total[first[:-1]]
            p = shared.value.probabilities(s)
            yield pa.record_batch([batch.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1).astype(np.int32)), pa.array(1 - p[:, 0]), pa.array(p[:, 0] < 0.5)], names=["id", "expected_severity", "severity", "p_toxic", "toxic"])

    kind = docs.schema[key].dataType.simpleString()
    found = in_arrow(docs.select(F.col(key), F.col(text).cast("string")), scored, f"id {kind}, expected_severity double, severity int, p_toxic double, toxic boolean")
    return found.withColumnRenamed("id", key)
