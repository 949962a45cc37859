"""Operator 10: benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: one shard holds, for a few hundred documents, the
sorted positions of every indexed term, delta coded and stored in the shared folder.

* Every window of a benchmark item is a *probe*, kept under its rarest term of the whole
  corpus.  A join by that term sends it to the shards that hold the term, and to no others.
* In a shard all its probes are looked up together: the positions of each one's rarest
  term there, moved back by the term's offset, are intersected with the next rarest
  term's list until all agree; most probes end after a list or two.
* Proximity needs the rarest terms of an item near their places, not at them.

Benchmark and documents meet in joins alone; neither passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, light, stored
from .text import flat, slices, text_words

WINDOW = 13
SHARD_WORDS = 1 << 20
SLOP = 4  # words by which a near term may be off its place
NEAR_TERMS = 4
VOCABULARY = 1 << 22  # terms of a benchmark up to which the index leaves out all others; their hashes are broadcast
PROBES = 1 << 15  # that meet a shard at a time, about
CANDIDATES = 1 << 20  # places looked at together

ITEMS = "item bigint, name string, words binary"
HITS = "shard bigint, place int, spans binary, names array<string>, near array<string>"


def _shards(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    keys: list[pa.Array] = []
    sizes: list[int] = []
    hashes: list[np.ndarray] = []
    total, number = 0, TaskContext.get().partitionId() << 33

    def shard() -> pa.RecordBatch:
        nonlocal number
        number += 1
        lengths = np.array(sizes, dtype=np.int64)
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        # a gap of one position after each document keeps phrases inside it
        at = np.arange(len(words), dtype=np.int64) + np.repeat(np.arange(len(lengths)), lengths)
        if vocabulary is not None:
            slot = np.searchsorted(vocabulary, words)
            keep = vocabulary[np.minimum(slot, len(vocabulary) - 1)] == words if len(vocabulary) else np.zeros(len(words), bool)
            words, at = words[keep], at[keep]
        order = np.argsort(words, kind="stable")
        terms, first, counts = np.unique(words[order], return_index=True, return_counts=True)
        at = at[order]
        steps = np.diff(at, prepend=0)
        steps[first] = at[first]
        packed = pa.compress(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)
        held = pa.concat_arrays(keys)
        held = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
        columns = [pa.array([number - 1], pa.int64()), held, pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in (terms.astype("<u8").tobytes(), counts.astype("<u4").tobytes(), packed))]
        return pa.record_batch(columns, names=["shard", "keys", "n_words", "terms", "counts", "positions"])

    for batch in batches:
        raw, offsets = flat(batch.column(1))
        for a, b in slices(offsets):
            base = offsets[a]
            words, first = text_words(raw[base : offsets[b]], offsets[a : b + 1] - base, "alnum")
            if total and total + len(words) > SHARD_WORDS:
                yield shard()
                keys, sizes, hashes, total = [], [], [], 0
            keys.append(batch.column(0).slice(a, b - a))
            sizes, total = sizes + np.diff(first).tolist(), total + len(words)
            hashes.append(words)
    if sizes:
        yield shard()


def positional_index(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray | None = None) -> DataFrame:
    """The stored index of ``docs``: one row a shard.  ``vocabulary`` (sorted term hashes) leaves out all other terms."""
    shared = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = f"shard bigint, keys array<{docs.schema[key].dataType.simpleString()}>, n_words array<int>, terms binary, counts binary, positions binary"
    source = docs.select(F.col(key), F.col(text).cast("string"))
    return stored(in_arrow(source, lambda it: _shards(it, None if shared is None else shared.value), schema), "index")


class Shard:
    """One shard's lists, unpacked once, as ascending pairs (term's slot, position) in one number each."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, lengths: np.ndarray) -> None:
        self.terms = np.frombuffer(terms, "<u8")
        counts = np.frombuffer(counts, "<u4").astype(np.int64)
        ends = np.cumsum(counts)
        self.counts, self.starts = counts, ends - counts
        n = int(ends[-1]) if len(counts) else 0
        steps = np.frombuffer(pa.decompress(positions, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
        at = np.cumsum(np.ascontiguousarray(steps.reshape(4, n).T).view("<u4").ravel().astype(np.int64))
        if n:  # the running sum restarts at each term
            at -= np.repeat(np.concatenate([[0], at[ends[:-1] - 1]]), counts)
        self.first = np.cumsum(lengths + 1) - (lengths + 1)  # position of each document's first word
        self.lengths = lengths
        self.size = int((lengths + 1).sum()) + 1
        self.pairs = np.repeat(np.arange(len(counts)), counts) * self.size + at

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each term's list, -1 where the shard lacks it."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        i = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[i] == hashes, i, -1)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def _places(self, slots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The lists of some slots, some at a time: which of the slots, and the position."""
        size = self.counts[slots]
        upto, a = np.cumsum(size), 0
        while a < len(slots):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CANDIDATES, side="right")))
            of = np.repeat(np.arange(a, b), size[a:b])
            yield of, self.pairs[self.starts[slots[of]] + np.arange(len(of)) - (upto[of] - size[of] - (upto[a - 1] if a else 0))] % self.size
            a = b

    def phrases(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the terms of each row of ``slots`` stand one after another: row and first position."""
        rank = np.argsort(self.counts[slots], axis=1, kind="stable")
        rows, found = [np.zeros(0, int)], [np.zeros(0, int)]
        for of, at in self._places(slots[np.arange(len(slots)), rank[:, 0]]):
            begin = at - rank[of, 0]
            of, begin = of[begin >= 0], begin[begin >= 0]
            for j in range(1, slots.shape[1]):
                k = rank[of, j]
                want = slots[of, k] * self.size + begin + k
                held = self.pairs[np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)] == want
                of, begin = of[held], begin[held]
            rows.append(of)
            found.append(begin)
        return np.concatenate(rows), np.concatenate(found)

    def near(self, slots: np.ndarray, offsets: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the other terms of a row stand at most ``slop`` words off their places by the first one, in one document: row and the first one's position."""
        rows, found = [np.zeros(0, int)], [np.zeros(0, int)]
        for of, at in self._places(slots[:, 0]):
            for j in range(1, slots.shape[1]):
                doc, middle = self.document(at), at + offsets[of, j] - offsets[of, 0]
                low = np.maximum(middle - slop, self.first[doc])
                high = np.minimum(middle + slop, self.first[doc] + self.lengths[doc] - 1)
                i = np.searchsorted(self.pairs, slots[of, j] * self.size + low)
                held = (low <= high) & (i < len(self.pairs)) & (self.pairs[np.minimum(i, len(self.pairs) - 1)] <= slots[of, j] * self.size + high)
                of, at = of[held], at[held]
            rows.append(of)
            found.append(at)
        return np.concatenate(rows), np.concatenate(found)


def _itemised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            raw, offsets = flat(pa.array([body.as_py()], pa.string()))
            words, _ = text_words(raw, offsets, "alnum")
            if len(words):
                yield pa.record_batch([pa.array([item]), pa.array([name or ""]), pa.array([words.tobytes()], pa.binary())], names=["item", "name", "words"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            terms = np.frombuffer(words, "<i8")
            yield pa.record_batch([pa.array(np.full(len(terms), item)), pa.array(np.arange(len(terms), dtype=np.int32)), pa.array(terms)], names=["item", "place", "term"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, terms, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found = np.frombuffer(terms, "<i8")
            yield pa.record_batch([pa.array(np.full(len(found), shard)), pa.array(found), pa.array(np.frombuffer(counts, "<u4").astype(np.int64))], names=["shard", "term", "c"])


PROBE = "term bigint, name string, near boolean, words binary, places binary"


def _probes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of items that may occur, and the rarest terms of each item, under the rarest of their terms."""
    for batch in batches:
        for name, body, weights in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words, df, out = np.frombuffer(body, "<u8"), np.zeros(len(body) // 8, np.int64), []
            for place, c in ((x["place"], x["c"]) for x in weights):
                df[place] = c
            width = min(window, len(words))
            total = np.concatenate([[0], np.cumsum(df > 0)])
            begins = np.flatnonzero(total[width:] - total[:-width] == width)
            windows = np.lib.stride_tricks.sliding_window_view(words, width)[begins]
            for s in begins[np.unique(windows, axis=0, return_index=True)[1]].tolist():  # a window that an item repeats is one probe
                rarest = s + int(np.argmin(df[s : s + width]))
                out.append((words[rarest].view(np.int64), name, False, words[s : s + width].tobytes(), np.arange(width, dtype="<i4").tobytes()))
            present = np.flatnonzero(df > 0)
            if len(present) >= min(NEAR_TERMS, len(words)):
                rare = present[np.argsort(df[present], kind="stable")[:NEAR_TERMS]]
                out.append((words[rare[0]].view(np.int64), name, True, words[rare].tobytes(), rare.astype("<i4").tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in PROBE.split(", ")])


def _merged(shard: Shard, begins: np.ndarray, width: int) -> np.ndarray:
    """Rows (document, first word, end) of the words that phrases of ``width`` words from ``begins`` on cover."""
    docs = shard.document(begins)
    fresh = (np.diff(docs, prepend=-1) != 0) | (np.diff(begins, prepend=0) > width)
    head = np.flatnonzero(fresh)
    last = np.concatenate([head[1:], [len(begins)]])[: len(head)] - 1
    first = shard.first[docs[head]]
    return np.stack([docs[head], begins[head] - first, begins[last] + width - first], axis=1)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the probes of one row hit in its shard, by document."""
    for batch in batches:
        for i in range(len(batch)):
            number, lengths, terms, counts, positions, probes = (batch.column(k)[i].as_py() for k in range(6))
            shard = Shard(terms, counts, positions, np.array(lengths, dtype=np.int64))
            spans, names, close = ([np.zeros((0, 3), np.int64)], {}, {})
            kinds: dict[tuple[bool, int], dict[tuple[bytes, bytes], list[str]]] = {}
            for p in probes:  # the items of a window share its search
                kinds.setdefault((p["near"], len(p["words"]) // 8), {}).setdefault((p["words"], p["places"]), []).append(p["name"])
            for (near, width), asked in kinds.items():
                items = list(asked.values())
                slots = shard.slots(np.frombuffer(b"".join(w for w, _ in asked), "<u8").reshape(-1, width))
                whole = np.flatnonzero((slots >= 0).all(1))
                if not len(whole):
                    continue
                if near:
                    places = np.frombuffer(b"".join(p for _, p in asked), "<i4").reshape(-1, width).astype(np.int64)
                    of, at = shard.near(slots[whole], places[whole], SLOP)
                else:
                    of, at = shard.phrases(slots[whole])
                    spans.append(_merged(shard, np.unique(at), width))
                docs = len(shard.lengths)
                for pair in np.unique(whole[of] * docs + shard.document(at)).tolist():
                    (close if near else names).setdefault(pair % docs, set()).update(items[pair // docs])
            spans = np.concatenate(spans)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            docs = sorted(names.keys() | close.keys())
            if docs:
                edges = np.searchsorted(spans[:, 0], [docs, [d + 1 for d in docs]])
                bodies = [spans[x:y, 1:].astype("<i4").tobytes() for x, y in edges.T.tolist()]
                columns = [[number] * len(docs), docs, bodies, *([sorted(held.get(d, ())) for d in docs] for held in (names, close))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())))], names=[c.split()[0] for c in HITS.split(", ")])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of a document its spans cover."""
    for batch in batches:
        hits = []
        for spans in batch.column(2).to_pylist():
            s = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2).astype(np.int64)
            s = s[np.argsort(s[:, 0], kind="stable")]
            reach = np.maximum.accumulate(s[:, 1]) if len(s) else s[:, 1]
            before = np.concatenate([[0], reach[:-1]])[: len(s)]
            hits.append(int(np.maximum(reach - np.maximum(before, s[:, 0]), 0).sum()))
        yield pa.record_batch([*batch.columns[:2], pa.array(hits, pa.int64()), *batch.columns[3:]], names=["shard", "place", "n_hit", "names", "near"])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document the words inside exact occurrences of item windows, and whether they are a twentieth of it.

    ``n_near`` counts items of which the ``NEAR_TERMS`` words rarest in the corpus (the
    first of equals; all words of a shorter item) stand at most ``SLOP`` words off their
    places, seen from the rarest.  Null text has no words; items without words match
    nothing; a null item id counts as the empty text; rows that repeat an id, in either
    table, are judged apart (items: named once); an empty table gives an empty result, an
    empty benchmark clean documents; other columns are left out.
    """
    named = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).cast("string").alias("name"), F.col(item_text).cast("string").alias("text"))
    asked = stored(in_arrow(named, _itemised, ITEMS), "items")
    words = in_arrow(asked.select("item", "words"), _terms, "item bigint, place int, term bigint")
    terms = stored(words.select("term").distinct(), "terms")
    few = terms.count() <= VOCABULARY
    vocabulary = np.sort(terms.toArrow().column(0).to_numpy().astype("<i8").view(np.uint64)) if few else None
    index = positional_index(docs, key, text, vocabulary)

    lists = in_arrow(index.select("shard", "terms", "counts"), _lists, "shard bigint, term bigint, c bigint")
    lists = stored(lists.join(light(terms), "term", "left_semi"), "lists")
    df = stored(lists.groupBy("term").agg(F.sum("c").alias("c")), "df")
    weights = words.join(light(df), "term").groupBy("item").agg(F.collect_list(F.struct("place", "c")).alias("weights"))  # no more than one item's words
    weighed = asked.join(weights, "item").select("name", "words", "weights")
    probes = stored(in_arrow(weighed, lambda it: _probes(it, window), PROBE), "probes")

    chunks = -(-probes.count() // PROBES)
    probe = F.struct("name", "near", "words", "places")
    sent = probes.join(lists.select("term", "shard"), "term").withColumn("chunk", F.pmod(F.xxhash64("name", "words"), F.lit(max(1, chunks))))
    sent = sent.groupBy("shard", "chunk").agg(F.collect_list(probe).alias("probes"))  # about PROBES of them
    met = index.select("shard", "n_words", "terms", "counts", "positions").join(sent, "shard").drop("chunk")
    hits = in_arrow(met, _matched, HITS).groupBy("shard", "place")
    distinct = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    hits = hits.agg(F.collect_list("spans").alias("spans"), distinct("names"), distinct("near"))  # of one document
    hits = stored(in_arrow(hits, _covered, "shard bigint, place int, n_hit bigint, names array<string>, near array<string>"), "hits")

    each = index.select("shard", F.posexplode(F.arrays_zip("keys", "n_words")).alias("place", "d"))
    each = each.select("shard", "place", F.col("d.keys").alias(key), F.col("d.n_words").cast("long").alias("n_words"))
    found = each.join(light(hits), ["shard", "place"], "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.expr("array()").cast("array<string>")
    names, near = F.coalesce("names", none), F.coalesce("near", none)
    dirty = (n_hit > 0) & (20 * n_hit >= F.col("n_words"))
    digests = F.sha2(F.array_join(F.array_sort(names), ","), 256)
    return found.select(key, "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), digests.alias("items_sha256"), dirty.alias("contaminated"), F.size(near).cast("long").alias("n_near"))


def digest(names: list[str]) -> str:
    """What ``items_sha256`` holds for these item ids."""
    return hashlib.sha256(",".join(sorted(set(names))).encode()).hexdigest()
