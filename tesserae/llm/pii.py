"""Operator 13: personal data by patterns and by a character-level tagger.

Patterns find mail addresses, IP addresses, card and phone numbers in their plain forms; these
spans always stay.  Spans found so in a bounded sample of documents are the labels of a
bidirectional LSTM with CRF transitions (:mod:`.tagger`), trained in numpy.  In part of its
training texts a labelled span is rewritten into a form the patterns miss (``VARIANTS``),
so that the tagger learns such forms in context; numbers that are no personal data (dates,
versions, sums, the given texts' own) are its counterexamples.

Every span holds a digit or an at sign.  Around each of them lies a stretch of
``REACH`` characters either way; stretches that meet are one.  Windows of ``WINDOW`` characters
that overlap by half are laid over every stretch and decoded, each on its own, to probabilities
of labels at every place.  They are reconciled globally: the probabilities of all windows
over a place are averaged, those of a window's middle counting most, and one best allowed
sequence is taken over the whole stretch, so that spans of any length come out whole.
A span is added if the labels in it are sure enough, no plain span overlaps it, and it is
none that a pattern matched and its check refused.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .tagger import Tagger, best_paths, characters
from .text import pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # outside, and the first and further characters of each kind
WINDOW = 64
REACH = 24
TOGETHER = 1024  # windows decoded at a time
SURE = 0.97  # mean probability of an added span's labels
LEAST_SURE = 0.8  # and that of the least sure of them

SAMPLE = 4000  # documents that labels are learnt from, at most, chosen by hashed id
SNIPPETS = 4  # of each, at most
MARGIN = 80  # characters of a snippet on either side of its place
TRAINING = 6000  # windows
EPOCHS = 8

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GATE = re.compile(r"[0-9@]")

#: ``allowed[a, b]``: label ``b`` may follow ``a``.  A span goes on only in its own kind.
ALLOWED = np.array([[b == 0 or b % 2 == 1 or a in (b - 1, b) for b in range(LABELS)] for a in range(LABELS)])

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, by start, then kind, and those whose check refused them although they have the right size.

    Per kind the leftmost matches that do not overlap; a match that fails its check is passed
    over whole.  Every pattern takes time in proportion to the text: a mail address is
    sought from its at sign, and runs of digits are never entered in their middle.
    """
    if not _GATE.search(text):
        return [], []
    found, refused, last, at = [], [], 0, 0
    for m in _DOMAIN.finditer(text):
        before = text[max(last, text.rfind("@", 0, m.start()) + 1) : m.start()]
        start = m.start() - (len(before) - len(before.rstrip(_LOCAL)))
        if start < m.start():
            found.append((0, start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())
        (found if fits else refused).append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() >= 14 else ""
        if 14 <= len(digits) <= 19:
            (found if luhn(digits) else refused).append((2, *m.span()))
    for m in _PHONE.finditer(text):
        (found if 10 <= sum(c.isdigit() for c in m.group()) <= 15 else refused).append((3, *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0])), refused


def _grouped(rng: random.Random, text: str) -> str:
    digits = re.sub(r"[^0-9]", "", text)
    return rng.choice([".", "_", "/", "  ", " "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))


#: How a labelled span is rewritten for training, by kind: forms that the patterns miss.
VARIANTS = {
    0: (
        lambda rng, t: t.replace("@", rng.choice([" @ ", "@ ", " @"])),
        lambda rng, t: t.replace("@", "@" + rng.choice(["[", "("])).replace(".", rng.choice([".", "[.]"])) + rng.choice(["]", ")"]),
        lambda rng, t: t.split("@")[0] + "@" + t.split("@")[1].replace(".", rng.choice(["[.]", "(.)", " . "])),
    ),
    1: (
        lambda rng, t: t.replace(".", rng.choice(["[.]", "(.)", " . "])),
        lambda rng, t: t.replace(".", rng.choice(["[.]", "(.)"]), 1),
    ),
    2: (_grouped, _grouped),
    3: (
        lambda rng, t: t[1:],
        lambda rng, t: re.sub(r"^\+[0-9]+[ -]*(?=\()", "", t),
        lambda rng, t: re.sub(r"[() .-]+", rng.choice([".", "-"]), t[1:]).strip(".-"),
        lambda rng, t: "00" + t[1:],
    ),
}


def _innocent(rng: random.Random) -> str:
    """A made-up piece with digits or an at sign that is no personal data."""
    n = lambda a, b: str(rng.randint(a, b))
    two = lambda: f"{rng.randint(0, 59):02d}"
    word = "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    return rng.choice(
        [
            lambda: f"{n(1900, 2099)}-{two()}-{two()}",
            lambda: f"{n(1, 31)}.{n(1, 12)}.{n(1900, 2099)}",
            lambda: f"{n(1, 12)}/{n(1, 31)}/{n(1990, 2030)}",
            lambda: f"{n(0, 23)}:{two()}" + rng.choice(["", f":{two()}"]),
            lambda: f"{n(0, 20)}.{n(0, 40)}" + rng.choice(["", f".{n(0, 90)}", f".{n(0, 9)}-rc{n(1, 4)}"]),
            lambda: f"{n(1, 999)},{n(100, 999)}" + rng.choice(["", ".00", f",{n(100, 999)}"]),
            lambda: rng.choice("$€£#") + n(1, 10**6),
            lambda: n(1, 10 ** rng.randint(1, 12)),
            lambda: f"{n(1900, 2030)}-{n(1900, 2030)}",
            lambda: f"978-{n(0, 9)}-{n(1000, 9999)}-{n(1000, 9999)}-{n(0, 9)}",
            lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 40))),
            lambda: f"{word}{n(1, 999)}",
            lambda: f"@{word}",
            lambda: f"{word} @ {n(1, 99)}",
            lambda: f"{word}@{word}",
            lambda: f"{n(1, 99)}%",
            lambda: f"({n(1, 99)})",
            lambda: f"{n(1, 9)}x{n(1, 99)}",
        ]
    )()


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to ``SNIPPETS`` pieces of each text around digits and at signs, far apart, with their plain spans."""
    for batch in batches:
        out: list[str] = []
        for text in batch.column(0).to_pylist():
            until, taken = 0, 0
            for m in _GATE.finditer(text):
                if m.start() >= until and taken < SNIPPETS:
                    a, until, taken = max(0, m.start() - MARGIN), m.start() + 2 * MARGIN, taken + 1
                    out.append(text[a : m.start() + MARGIN])
        yield pa.record_batch([pa.array(out, pa.string())], names=["snippet"])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 3) -> Tagger | None:
    """A tagger learnt from the plain spans of at most ``SAMPLE`` documents, or None where those have no span.

    The documents are those of the least hashed ids among the ones with a digit or an at sign;
    snippets of some 160 characters leave the tasks, ``SNIPPETS`` a document at most.
    Reruns learn the same.
    """
    seen = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).where(F.col("_text").rlike("[0-9@]"))
    keys = seen.groupBy("_key").agg(F.count("*").alias("_n")).orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE)  # rows that repeat an id count once
    some = in_arrow(seen.join(F.broadcast(keys.select("_key")), "_key", "left_semi").select("_text"), _snippets, "snippet string")
    rows = some.orderBy(F.xxhash64("snippet"), "snippet").limit(SAMPLE * SNIPPETS).toPandas()["snippet"].tolist()
    return fitted(rows, seed)


def _window(rng: random.Random, snippet: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and labels of a piece of the snippet, of ``WINDOW`` characters if there are so many."""
    codes = np.frombuffer(snippet.encode("utf-32-le", "surrogatepass"), "<u4")
    labels = np.zeros(len(codes), np.int64)
    for kind, a, b in spans:
        labels[a:b] = 2 * kind + 2
        labels[a] = 2 * kind + 1
    a = rng.randint(0, max(0, len(codes) - WINDOW))
    return characters(codes[a : a + WINDOW]), labels[a : a + WINDOW]


def examples(snippets: list[str], count: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``count`` training windows: characters, mask and labels.  Of the windows with spans a part is rewritten, every kind of span counts alike."""
    rng = random.Random(seed)
    by_kind: dict[int, list[tuple[str, list[Span]]]] = {}
    bare: list[str] = []
    for s in snippets:
        spans, _ = plain_spans(s)
        spans = [x for i, x in enumerate(spans) if not any(y[1] < x[2] and x[1] < y[2] for y in spans[:i])]
        for kind in {k for k, _, _ in spans}:
            by_kind.setdefault(kind, []).append((s, spans))
        if not spans:
            bare.append(s)
    windows = []
    while by_kind and len(windows) < count:
        draw = rng.random()
        if draw < 0.3:  # without personal data: the texts' own, or with a made-up piece in place of a span
            s, spans = (rng.choice(bare), []) if bare and rng.random() < 0.4 else rng.choice(by_kind[rng.choice(sorted(by_kind))])
            for _, a, b in reversed(spans):
                s = s[:a] + _innocent(rng) + s[b:]
            windows.append(_window(rng, s, []))
            continue
        kind = rng.choice(sorted(by_kind))
        s, spans = rng.choice(by_kind[kind])
        if draw < 0.65:
            moved, out = 0, []
            for k, a, b in spans:
                old = s[a + moved : b + moved]
                new = rng.choice(VARIANTS[k])(rng, old) if rng.random() < 0.8 else old
                s = s[: a + moved] + new + s[b + moved :]
                out.append((k, a + moved, a + moved + len(new)))
                moved += len(new) - len(old)
            spans = out
        windows.append(_window(rng, s, spans))
    chars, labels = np.zeros((len(windows), WINDOW), np.int32), np.zeros((len(windows), WINDOW), np.int64)
    mask = np.zeros((len(windows), WINDOW), bool)
    for i, (c, y) in enumerate(windows):
        chars[i, : len(c)], labels[i, : len(c)], mask[i, : len(c)] = c, y, True
    return chars, mask, labels


def fitted(snippets: list[str], seed: int = 3, count: int = TRAINING, epochs: int = EPOCHS) -> Tagger | None:
    chars, mask, labels = examples(snippets, count, seed)
    return Tagger(LABELS, seed=seed, allowed=ALLOWED).fit(chars, mask, labels, epochs) if len(chars) else None


def _stretches(codes: np.ndarray) -> np.ndarray:
    """Start and end of the stretches of a text, ``[n, 2]``."""
    at = np.flatnonzero(((codes >= 48) & (codes < 58)) | (codes == 64))
    if not len(at):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(at) > 2 * REACH)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return np.stack([np.maximum(first - REACH, 0), np.minimum(last + REACH + 1, len(codes))], axis=1)


def window_marginals(model: Tagger, chars: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Averaged probabilities of the labels for every character of stretches laid end to end; ``edges`` has where each begins and ends."""
    step = WINDOW // 2
    counts = np.maximum(1, -(-(np.diff(edges) - step) // step))
    stretch = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(stretch)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = edges[stretch] + number * step
    size = np.minimum(edges[stretch + 1] - start, WINDOW)
    weights = (1 + np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))).astype(np.float32)
    total, weight = np.zeros((len(chars), LABELS), np.float32), np.zeros(len(chars), np.float32)
    for parity in (0, 1):  # windows of one parity do not overlap
        own = np.flatnonzero(number % 2 == parity)
        for i in range(0, len(own), TOGETHER):
            w = own[i : i + TOGETHER]
            mask = np.arange(WINDOW)[:, None] < size[w]
            at = np.where(mask, start[w] + np.arange(WINDOW)[:, None], 0)
            found = model.marginals(chars[at], mask)
            held = at[mask]
            share = np.broadcast_to(weights[:, None], mask.shape)[mask]
            total[held] += found[mask] * share[:, None]
            weight[held] += share
    return total / np.maximum(weight, 1)[:, None]


def tagged_spans(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """The tagger's spans of every text, reconciled over its windows."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    out: list[list[Span]] = [[] for _ in texts]
    parts = [(k, a, b) for k, c in enumerate(codes) for a, b in _stretches(c).tolist()]
    if not parts:
        return out
    edges = np.concatenate([[0], np.cumsum([b - a for _, a, b in parts])])
    marginal = window_marginals(model, characters(np.concatenate([codes[k][a:b] for k, a, b in parts])), edges)
    logs, sizes = np.log(np.maximum(marginal, 1e-9)), np.diff(edges)
    order, i = np.argsort(sizes, kind="stable"), 0
    while i < len(order):  # stretches of like length together
        j = i + 1
        while j < len(order) and j - i < TOGETHER and sizes[order[j]] <= 1.3 * sizes[order[i]] + 8:
            j += 1
        some, longest = order[i:j], int(sizes[order[j - 1]])
        at = np.minimum(edges[some] + np.arange(longest)[:, None], edges[some + 1] - 1)
        paths = best_paths(logs[at], sizes[some], ALLOWED)
        for column, part in enumerate(some.tolist()):
            k, a, _ = parts[part]
            path = paths[: sizes[part], column].astype(np.int64)
            sure = marginal[edges[part] + np.arange(len(path)), path]
            begins = np.flatnonzero(path % 2 == 1)
            for b in begins.tolist():
                e = b + 1
                while e < len(path) and path[e] == path[b] + 1:
                    e += 1
                if sure[b:e].mean() >= SURE and sure[b:e].min() >= LEAST_SURE:
                    out[k].append(((int(path[b]) - 1) // 2, a + b, a + e))
        i = j
    return [sorted(s, key=lambda x: (x[1], x[0])) for s in out]


def with_added(plain: list[Span], refused: list[Span], tagged: list[Span]) -> list[Span]:
    """The plain spans and those of the tagger's that overlap neither them nor what was refused."""
    starts, reach = [], []
    for _, a, b in sorted(plain + refused, key=lambda s: s[1]):
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))
    ends = [bisect.bisect_left(starts, e) for _, _, e in tagged]  # held spans that begin before the tagged one ends
    added = [s for s, k in zip(tagged, ends) if not k or reach[k - 1] <= s[1]]
    return sorted(plain + added, key=lambda s: (s[1], s[0]))


def personal_data(docs: DataFrame, model: Tagger | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``key`` and ``spans`` (structs of kind, start, end in code points, and whether a pattern found it), by start, then kind.

    Null and empty texts have none; texts of any length are searched whole; rows that
    repeat an id, or have none, are judged apart; other columns are left out, whatever
    their names; an empty table gives an empty result; without a model, the plain spans are all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 20 KB

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())])
        for batch in pieces(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tagged = tagged_spans(shared.value, texts) if shared.value else [[] for _ in texts]
            rows = []
            for t, more in zip(texts, tagged):
                plain, refused = plain_spans(t)
                have = set(plain)
                rows.append([{"kind": KINDS[s[0]], "start": s[1], "end": s[2], "plain": s in have} for s in with_added(plain, refused, more)])
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(kind))], names=["key", "spans"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,plain:boolean>>"
    source = docs.select(F.col(key), F.col(text).cast("string"))
    return in_arrow(source, found, schema).withColumnRenamed("key", key)
