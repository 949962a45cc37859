"""Each stage of the pipeline against a plain model of it, on a small folder of tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tesserae.llm import quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, n_bytes int, score string, label string"
CONTRACT = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    shared, item = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(60)]
    texts += [t.upper() + "!!! ###" for t in texts[:20]]  # junk
    texts += [texts[0], texts[1] + " x", texts[2] + " " + word(), texts[3], texts[3]]
    texts += [" ".join(word() for _ in range(30)) + " " + shared + " " + word() for _ in range(4)]
    texts += [" ".join(word() for _ in range(k)) + " " + item + " " + word() for k in (5, 30, 900)]
    texts += [None, "", "  \n", " ".join(word() for _ in range(4000))]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or ""), -i, 7, "s", "l") for i, t in enumerate(texts)]
    rows += [(3, *rows[3][1:]), (None, texts[5] + " end", "en", "a", len(texts[5]) + 4, 0, 7, "s", "l")]
    path = tmp_path_factory.mktemp("sf")
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")
    save(rows, SCHEMA, "documents")
    save([(i, int(not 60 <= i < 80), 0) for i in range(80)], "doc_id long, quality int, toxic int", "labels")
    save([(1, item), (2, "never seen words stand here alone"), (3, None)], "item_id long, text string", "benchmark")
    return str(path)


def plain_join(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for k, (g, s) in enumerate(zip(group, sets)):
        if s:
            rank = (rows[k]["doc_id"] is None, rows[k]["doc_id"], k)
            best[g] = min(best.get(g, rank), rank)
    return [r for k, (r, g, s) in enumerate(zip(rows, group, sets)) if not s or best[g][2] == k]


def plain_repeats(rows):
    bodies = [(r["text"] or "").encode() for r in rows]
    counts = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    out = []
    for r, b in zip(rows, bodies):
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        text = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        out.append(r | ({"text": text, "n_chars": len(text)} if gone.any() else {}))
    return out


def plain_clean(rows, items):
    import re

    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {tuple(q[s : s + 13]) for q in map(split, items) for s in range(max(0, len(q) - 12))} | {tuple(q) for q in map(split, items) if 0 < len(q) < 13}
    out = []
    for r in rows:
        w, hit = split(r["text"]), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def same(got, want, names):
    plain = lambda r: repr([r[n] for n in names])
    assert sorted(map(plain, got)) == sorted(map(plain, want))


@pytest.mark.parametrize("columns", [SCHEMA.replace(" long", "").replace(" int", "").replace(" string", "").split(", "), CONTRACT[:4]])
def test_stages(spark, folder, tmp_path, columns):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "ngram_join", "suffix_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*columns)
    rows = lambda df: [r.asDict() for r in df.collect()]

    def kept(name, docs):
        path = f"{tmp_path}/{name}"
        stages[name](spark, docs, folder).write.parquet(path)
        return spark.read.parquet(path)

    first = kept("quality", docs)
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = rows(quality.quality_scores(docs.select("doc_id", "text"), model))
    good = Counter((r["doc_id"], r["text"]) for r in scored if r["score"] >= quality.THRESHOLD)
    assert first.columns == columns and Counter((r["doc_id"], r["text"]) for r in rows(first)) == good and 0 < first.count() < docs.count()
    # later stages are judged on all documents, so that each meets every case
    joined = kept("ngram_join", docs)
    same(rows(joined), plain_join(rows(docs)), columns)
    assert joined.count() < docs.count()
    cut = kept("suffix_dedup", joined)
    same(rows(cut), plain_repeats(rows(joined)), columns)
    assert sum(len(r["text"] or "") for r in rows(cut)) < sum(len(r["text"] or "") for r in rows(joined))
    clean = kept("decontamination", joined)
    items = [r["text"] for r in rows(spark.read.parquet(f"{folder}/benchmark.parquet"))]
    same(rows(clean), plain_clean(rows(joined), items), columns)
    assert joined.count() - clean.count() == 2  # the long document holds too little of the item
    mixed = rows(kept("mixing", clean))
    sizes = Counter((r["doc_id"], len((r["text"] or "").split())) for r in rows(clean))
    assert Counter((r["doc_id"], r["size"]) for r in mixed) == sizes
    targets = {(r["source_size"], r["target"]) for r in mixed}
    assert abs(sum(t for _, t in targets) - 1.5 * sum(s for s, _ in targets)) < 1 and all(r["taken"] <= 2 * r["size"] for r in mixed)
    assert abs(sum(r["taken"] for r in mixed) - sum(t for _, t in targets)) < 0.02 * sum(t for _, t in targets)


def test_run_is_the_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    digest = lambda df: hashlib.sha256(repr(sorted(map(str, df.collect()))).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, folder)) == digest(docs)
