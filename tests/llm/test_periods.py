"""Operator 11 against brute force: every period of every place, smallest periods by definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tesserae.llm import periods
from tesserae.llm.queries import looped, op11_periodic_runs

CLASH = "doc_id long, text string, runs string, collapsed int, n_words string, key string"


def brute_runs(w):
    n, out = len(w), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            a = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            s = w[a : i + p]
            if i > a and len(s) >= max(24, 3 * p) and not any(s[q:] == s[:-q] for q in range(1, p)):
                out.append((a, len(s), p))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, edit=True):
    w = (text or "").encode().split()
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if edit and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    return doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(listed), sha(kept)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda k: rng.choice(["a", "b", "é", "D", "d", "ẞ", "xy", "\x1c", "z\x85", " "][:k])
    out = [None, "", " \t\n", "one", " ".join("ab" * 12), "a " * 23, "a " * 24, "A a " * 12, "a b c d e f g h " * 3, "a b c d e f g h i " * 2 + "a b c d e f g h"]
    for _ in range(150):
        w = [word(rng.choice([1, 2, 3, 10])) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 4)):
            if len(w) > 30:
                a, p, e = rng.randrange(len(w)), rng.randint(1, 40), rng.randrange(len(w) + 1)
                for i in range(a + p, e):
                    w[i] = w[i - p]
        out.append(rng.choice([" ", "\n", "\t \x0b", " \r\n"]).join(w))
    return out


def test_query_equals_brute_force(spark, tmp_path, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (7, texts[-2]), (7, texts[-2])]
    spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], CLASH).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted((brute_row(*r) for r in rows), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert sum(r[1] > 0 for r in want) > 30 and max(r[1] for r in want) > 1


def test_operator_returns_texts_and_spans(table_of, texts):
    docs = table_of([(i, t, "x", 1, "y", "z") for i, t in enumerate(texts)], CLASH)
    for row in periods.periodic_runs(docs, "doc_id", "text").collect():
        got = row["doc_id"], len(row["runs"]), hashlib.sha256(row["collapsed"].encode()).hexdigest()
        want = brute_row(row["doc_id"], texts[row["doc_id"]], edit=False)
        assert got == (want[0], want[1], want[-1]) and row["n_words"] == len((texts[row["doc_id"]] or "").encode().split())
        assert [tuple(r) for r in row["runs"]] == brute_runs((texts[row["doc_id"]] or "").encode().split())
    empty = table_of([], CLASH, "none")
    assert periods.periodic_runs(empty).count() == 0 and looped(empty).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(empty, times=2)


def test_long_texts_take_seconds():
    """A hundred thousand equal words, a long period, and a text of two words only."""
    n = 100_000
    assert periods.word_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periods.word_runs(np.arange(n) % 30_000) == [(0, n, 30_000)]
    two = np.random.default_rng(1).integers(0, 2, n)
    assert all(length >= 24 for _, length, _ in periods.word_runs(two))
