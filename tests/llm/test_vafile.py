"""Operator 12 against brute force, and the bounds of its file against exact scores."""

import math
import random

import numpy as np
import pytest

from tesserae.llm import vafile
from tesserae.llm.queries import op12_hard_negatives

ROW = "vec_id long, embedding array<float>, label int, score string, anchor int, k string, rank string"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, b) for b, (j, w, _) in enumerate(kept) if b != a and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if kept[x[2]][2] == label)[:5]:
            inside = sorted(x for x in scored if kept[x[2]][2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(i, j, rank + 1, n, -s, -t) for rank, (t, n, _) in enumerate(inside)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [(int(i), (rng.normal(size=9) * 0.3 + 0.2 * (i % 3)).tolist(), int(i % 3)) for i in range(900)]
    same = rng.normal(size=9).tolist()
    out += [(1000 + k, same, 1 if k < 40 else 2) for k in range(90)]  # ties in every score, more than are asked for
    out += [(100, out[3][1], 0), (100, out[3][1], 0)]  # repeated ids and rows
    out += [(200, None, 1), (300, same, None), (400, [*same[:8], None], 1), (500, [*same[:8], math.nan], 1), (600, [*same[:8], math.inf], 1), (None, same, 1)]
    out += [(700, [], 1), (701, [], 1), (702, [], 2), (800, [0.5, 0.25], 0), (801, [0.5, 0.3], 0), (802, [0.5, 0.24], 2), (900, [-1.0, 0.0], 4), (901, [1.0, 0.0], 4), (902, [0.9, 0.0], 3)]
    out += [(1100, [3000.0, -2000.0, 1.0], 5), (1101, [2999.5, -2000.0, 0.0], 5), (1102, [2500.0, -2000.0, 0.5], 6)]  # components beyond 16 bits
    random.Random(2).shuffle(out)
    return out


@pytest.mark.parametrize("limit", [vafile.BROADCAST, 0])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, rows, limit):
    """With blocks of anchors in memory, and dealt by block and salt."""
    monkeypatch.setattr(vafile, "BROADCAST", limit)
    monkeypatch.setattr(vafile, "ANCHORS", vafile.ANCHORS if limit else 8)
    spark.createDataFrame([(i, v, label, "x", 1, "y", "z") for i, v, label in rows], ROW).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_hard_negatives(spark, str(tmp_path))
    assert got.columns == OUT
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    spark.createDataFrame([], ROW).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op12_hard_negatives(spark, f"{tmp_path}/none").count() == 0


def test_bounds_hold_and_leave_few(rows):
    """Every exact score lies between its bounds; of unit vectors less than a fifth is left to score."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(vafile.BLOCK, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    labels, ids = np.sort(rng.integers(0, 4, len(x))), np.arange(len(x))
    codes, low, high = vafile._quantised(x)
    block = vafile.Block(0, 64, *(b.tobytes() for b in (ids, labels, ids % 100 == 0, low, high, codes, x.astype("<i2"))))
    left = 0
    for a in block.anchors:
        least, most = block.bounds(x[a])
        exact = x @ x[a]
        assert (least <= exact).all() and (exact <= most).all()
        own = block.of_label(labels[a])
        assert (labels[own] == labels[a]).all() and (labels == labels[a]).sum() == own.stop - own.start
        left += (most[own] >= vafile._greatest(least[own], 5)).sum() / (own.stop - own.start)
    assert left / len(block.anchors) < 0.2
