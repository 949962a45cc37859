"""Operator 9: document quality by gated-attention multiple-instance learning.

A document is a bag of passages.  Every passage of every text is encoded from its
bytes and words; a small network embeds it, gated attention weighs the passages of
a document against each other, and the weighted sum is scored.  Only document labels
are learnt from: which passage gave a document away is what attention finds out.

Training takes a bounded sample of labelled rows (``SAMPLE``); scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .text import TABLES, flat, hash_spans, slices, word_spans

PASSAGE = 64  # words
SAMPLE = 6000  # labelled documents learnt from, at most
PAIRS = 64  # hashed byte pairs
THRESHOLD = 0.7

#: Groups of bytes counted apart: control, blank, newline, digit, upper, lower, non-ASCII, then single marks.
_MARKS = b".,!?|#-_/\\<>{}()[]:;\"'&%$*=+@~^`"
_GROUP = np.full(256, 6, dtype=np.int64)
_GROUP[:128] = 7
_GROUP[:32] = 0
_GROUP[[9, 32]] = 1
_GROUP[[10, 13]] = 2
_GROUP[48:58], _GROUP[65:91], _GROUP[97:123] = 3, 4, 5
for _i, _c in enumerate(_MARKS):
    _GROUP[_c] = 8 + _i
GROUPS = 8 + len(_MARKS)
FEATURES = GROUPS + PAIRS + 6


def passage_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of some texts, and the ``n + 1`` places where a text's passages begin (one at least)."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(raw, offsets, TABLES["space"])
    words = np.diff(first)
    count = np.maximum(1, -(-words // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(count)])
    total = int(begin[-1])
    text_of = np.repeat(np.arange(n), words)
    word_passage = begin[text_of] + (np.arange(len(starts)) - first[text_of]) // PASSAGE
    # a passage's bytes run from its first word to the next passage's, all of the text in all
    edge = np.zeros(total + 1, dtype=np.int64)
    edge[-1] = len(raw)
    edge[begin[:-1]] = offsets[:-1]
    if len(starts):
        head = np.flatnonzero(np.diff(word_passage, prepend=-1))
        inner = (np.arange(len(starts)) - first[text_of])[head] > 0
        edge[word_passage[head][inner]] = starts[head][inner]
    size = np.diff(edge)
    passage = np.repeat(np.arange(total), size)
    group = np.bincount(passage * GROUPS + _GROUP[raw], minlength=total * GROUPS).reshape(total, GROUPS)
    folded = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.int64)
    code = (folded[:-1] * 31 + folded[1:] * 7919 >> 2) % PAIRS if len(raw) > 1 else np.zeros(0, np.int64)
    inner = np.ones(len(code), dtype=bool)
    inner[[e - 1 for e in np.unique(offsets) if 0 < e < len(raw)]] = False  # no pair crosses a text's edge
    pair = np.bincount(passage[: len(code)][inner] * PAIRS + code[inner], minlength=total * PAIRS).reshape(total, PAIRS)
    per_byte = 1.0 / np.maximum(size, 1)[:, None]

    out = np.zeros((total, FEATURES), dtype=np.float32)
    out[:, :GROUPS] = np.sqrt(group * per_byte)
    out[:, GROUPS : GROUPS + PAIRS] = np.sqrt(pair * per_byte)
    here = np.bincount(word_passage, minlength=total)
    some = np.maximum(here, 1)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(word_passage, length, total) / some
    spread = np.sqrt(np.maximum(np.bincount(word_passage, length**2, total) / some - mean**2, 0))
    key = np.sort((word_passage.astype(np.uint64) << np.uint64(40)) | (hash_spans(raw, starts, ends) >> np.uint64(24)))
    fresh = np.diff(key, prepend=np.uint64(0)) != 0
    fresh[:1] = True
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=total)
    capital = np.bincount(word_passage, _GROUP[raw[starts]] == 4, total) if len(starts) else np.zeros(total)
    out[:, GROUPS + PAIRS :] = np.stack([mean / 10, spread / 10, distinct / some, capital / some, np.log1p(here) / 5, np.log1p(np.repeat(words, count)) / 10], axis=1)
    return out, begin


class AttentionModel:
    """Gated attention over passages, trained by Adam on the documents' log loss."""

    def __init__(self, hidden: int = 24, attention: int = 12, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean = np.zeros(FEATURES, np.float32)
        self.scale = np.ones(FEATURES, np.float32)
        self.p = {"W": draw(FEATURES, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, attention), "U": draw(hidden, attention), "w": draw(attention), "c": draw(hidden), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        s = {"x": (x - self.mean) / self.scale}
        s["h"] = np.tanh(s["x"] @ p["W"] + p["b"])
        s["t"], s["g"] = np.tanh(s["h"] @ p["V"]), 1 / (1 + np.exp(-(s["h"] @ p["U"])))
        e = (s["t"] * s["g"]) @ p["w"]
        of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        e = np.exp(e - np.maximum.reduceat(e, begin[:-1])[of])
        s["a"], s["of"] = e / np.add.reduceat(e, begin[:-1])[of], of
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], begin[:-1])
        s["y"] = 1 / (1 + np.exp(-np.clip(s["z"] @ p["c"] + p["d"], -30, 30)))
        return s

    def gradients(self, s: dict[str, np.ndarray], dy: np.ndarray) -> dict[str, np.ndarray]:
        """``dy``: derivative of the loss by each document's logit."""
        p, of = self.p, s["of"]
        dz = dy[:, None] * p["c"]
        da = (dz[of] * s["h"]).sum(1)
        start = np.flatnonzero(np.diff(of, prepend=-1))
        de = s["a"] * (da - np.add.reduceat(s["a"] * da, start)[of])
        dt = de[:, None] * p["w"] * s["g"] * (1 - s["t"] ** 2)
        dg = de[:, None] * p["w"] * s["t"] * s["g"] * (1 - s["g"])
        dh = (s["a"][:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T) * (1 - s["h"] ** 2)
        return {"W": s["x"].T @ dh, "b": dh.sum(0), "V": s["h"].T @ dt, "U": s["h"].T @ dg, "w": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, begin: np.ndarray, labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 6) -> AttentionModel:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-2
        share = np.clip(labels.mean(), 0.02, 0.98)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        rng, moments, step = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(labels))
            for i in range(0, len(order), batch):
                docs = order[i : i + batch]
                rows = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
                edges = np.concatenate([[0], np.cumsum(begin[docs + 1] - begin[docs])])
                s = self.forward(x[rows], edges)
                grads = self.gradients(s, ((s["y"] - labels[docs]) * weight[docs] / len(docs)).astype(np.float32))
                step += 1
                for k, g in grads.items():
                    m = moments[k]
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.99 * m[1] + 0.01 * g * g
                    pace = rate * (1 - epoch / epochs) + 1e-4
                    self.p[k] = self.p[k] - pace * ((m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8) + decay * self.p[k])
        return self

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self.forward(x, begin)["y"]


def held_out(key: str) -> F.Column:
    """Rows whose ``crc32`` of the id's text leaves 2 modulo 4 are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = flat(batch.column(1))
        for a, b in slices(offsets):
            base = offsets[a]
            x, begin = passage_features(raw[base : offsets[b]], offsets[a : b + 1] - base)
            blobs = [x[begin[i] : begin[i + 1]].tobytes() for i in range(b - a)]
            yield pa.record_batch([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(blobs, pa.binary())], names=["id", "label", "passages"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> AttentionModel:
    """Fit on at most ``sample`` labelled rows that are not held out, those of least hashed id.

    Rows without a label or an id are left out; of repeated labels the lowest counts, of
    repeated documents the least text.  Ids may be of any type that sorts.  Without both labels present the model knows nothing and scores one half.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(known), F.col("_key") == F.col("_id"))
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))  # at most ``sample``
    kind = labels.schema[key].dataType.simpleString()
    found = in_arrow(rows, _featured, f"id {kind}, label int, passages binary").collect()
    found = sorted(found, key=lambda r: r["id"])
    model, y = AttentionModel(), np.array([r["label"] for r in found], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        model.p["c"][:] = 0
        return model
    bags = [np.frombuffer(r["passages"], np.float32).reshape(-1, FEATURES) for r in found]
    return model.fit(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y)


def quality_scores(docs: DataFrame, model: AttentionModel, text: str = "text", score: str = "score", passages: str = "passages") -> DataFrame:
    """Every row of ``docs`` with its ``score`` (0 to 1) and ``passages``, its number of passages.

    Null or empty text is one empty passage and is scored as such.  Columns that clash
    with the two new ones are left out; name the new ones otherwise to keep them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(*[c for c in docs.columns if c.lower() in (score, passages)])
    place = kept.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(place))
            found, size = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for a, b in slices(offsets):
                base = offsets[a]
                x, begin = passage_features(raw[base : offsets[b]], offsets[a : b + 1] - base)
                found[a:b], size[a:b] = shared.value.score(x, begin), np.diff(begin)
            yield pa.record_batch([*batch.columns, pa.array(found), pa.array(size)], names=[*batch.schema.names, score, passages])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return in_arrow(kept, scored, ", ".join([*schema, f"`{score}` double", f"`{passages}` bigint"]))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, ``passages`` for every row, learnt and scored here.

    Null and empty texts score as one empty passage, long ones whole, passage by passage;
    equal texts score alike, so repeated rows do; other columns are left out; an empty
    table gives an empty result.
    """
    model = train(docs, labels, key, text)
    scored = quality_scores(docs.select(F.col(key), F.col(text).cast("string").alias(text)), model, text)
    return scored.select(F.col(key), held_out(key).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
