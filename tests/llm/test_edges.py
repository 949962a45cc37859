"""Brute force on small tables with nulls, empty and long texts, ties, repeats, clashing columns and no rows."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import chat, chunking, common, decontamination, fingerprints, graphs, mixing, ngram_join, quality, suffixes, tokens, toxicity

DOC = "doc_id long, text string"
CLASH = "doc_id long, text string, score double, label string, n_bytes int, size string, _spans string, kept_text string, n_words int"
BLANK = b" \t\n\r\x0b\x0c"


def clashing(rows):
    return [(i, t, 0.5, "x", 1, "y", "z", "k", 2) for i, t in rows]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(120)]
    out = [None, "", "   \n", "one", "one two three", "ONE two  three", " ".join(base), " ".join(base), " ".join(base).upper().replace("É", "é")]
    for k in (1, 3, 9, 30):
        changed = list(base)
        for _ in range(k):
            changed[rng.randrange(120)] = word()
        out.append("\t".join(changed))
    passage = [word() for _ in range(60)]
    for _ in range(6):
        out.append(" ".join([word() for _ in range(40)] + passage + [word() for _ in range(rng.randint(1, 90))]))
    out.append(" ".join(word() for _ in range(9000)))
    out.append("x" * 5000)
    return out


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts, ids):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    least = {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}
    return [(ids[i], len(s), least[i]) for i, s in enumerate(sets)]


def test_ngram_join(table_of, texts):
    ids = [100 - i for i in range(len(texts))]
    ids[7] = None  # a copy without an id
    ids[9] = ids[6]  # and one that repeats another's
    df = table_of(clashing(list(zip(ids, texts))), CLASH)
    got = ngram_join.near_components(df).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute_components(texts, ids), key=key)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    classes = {r["label"] for r in got if r["label"] is not None}
    assert kept.count() == len(classes) + sum(r["label"] is None for r in got)


def brute_links(sets):
    """For each set: how many different sets it is linked with, and how many others equal it."""
    different = set(map(frozenset, sets)) - {frozenset()}
    linked = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in different) for a in different}
    return [(linked.get(frozenset(s), 0), sum(s == t for t in sets) - 1 if s else 0) for s in sets]


def test_every_link_is_counted(table_of, texts):
    """Links inside a group count too: chains, copies, near copies in several units, and rows without words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = list(texts)
    for _ in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(120)] = word()
        rows.append(" ".join(w))
    for k in range(12):  # a chain whose ends are not linked
        rows.append(" ".join(base[k * 3 :] + [f"tail{i}" for i in range(k * 3)]))
    ids = list(range(len(rows)))
    got = ngram_join.near_links(table_of(list(zip(ids, rows)), DOC)).collect()
    counts = brute_links([shingles(t) for t in rows])
    want = [(i, n, c, *k) for (i, n, c), k in zip(brute_components(rows, ids), counts)]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"], r["n_equal"]) for r in got) == sorted(want)
    assert max(k for k, _ in counts) > 128
    empty = ngram_join.near_links(table_of([], DOC))
    assert empty.columns[-2:] == ["n_links", "n_equal"] and empty.count() == 0


def test_ngram_join_of_many_near_copies(table_of):
    """A group larger than units and crowds, with frequent shingles and outsiders that share a passage."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, line = [word() for _ in range(150)], [word() for _ in range(40)]
    rows = []
    for i in range(330):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 5])):
            w[rng.randrange(150)] = word()
        rows.append(" ".join(w))
    for i in range(120):
        rows.append(" ".join([word() for _ in range(rng.randint(5, 60))] + line))
    ids = list(range(len(rows)))
    got = ngram_join.near_components(table_of(list(zip(ids, rows)), DOC)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, ids))


def test_a_crowd_keeps_its_mark_beside_a_copy_of_its_hub():
    """The hub of a crowd, longer than the others, is posted by another task too; an outsider meets the crowd all the same."""

    def posted(*nodes):
        low = lambda node, n: np.array([5] + [1000 * node + k for k in range(1, n)], "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        batch = pa.record_batch([pa.array([a for a, _ in nodes]), pa.array([n for _, n in nodes]), pa.array([low(a, n) for a, n in nodes])], names=["node", "n", "low"])
        return list(ngram_join._posted(iter([batch]), 1, np.zeros(0, np.uint64)))

    tasks = [posted((1, 10), *((k, 5) for k in range(10, 17))), posted((1, 10)), posted((30, 5))]
    for order in itertools.permutations(tasks):
        listed = [r for b in ngram_join._listed(b for task in order for b in task) for r in b.to_pylist() if next(iter(r.values())) == 5]
        assert {1, *range(10, 17), 30} == {list(r.values())[1] for r in listed}


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 30, 40)]
    assert ngram_join.overlaps(sets, sets[::-1]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]


def test_components(table_of):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (7, 7), (20, 21), (21, 20)] + [(100 + i, 101 + i) for i in range(40)]
    edges += [(500, 501 + i) for i in range(300)] + [(499, 800)]  # a node of most edges
    got = {r["v"]: r["label"] for r in graphs.components(table_of(edges, "a long, b long")).collect()}
    assert all(got[v] == 1 for v in range(1, 6)) and got[9] == got[7] == 7 and got[21] == 20 and all(got[v] == 100 for v in range(100, 141))
    assert all(got[v] == 499 for v in range(499, 801))


def test_suffixes(table_of, texts):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    p = noise(230)
    texts = [*texts, "x" * 1000, "ab" * 400, noise(150) + p + noise(80), noise(90) + p + noise(300) + p, noise(199), "y" * 199, "y" * 200, p[:200], noise(50) + p[3:207] + noise(60), "abc" * 90 + noise(20) + "abc" * 70]
    df = table_of(clashing(list(enumerate(texts))), CLASH)
    counts = Counter(b[i : i + 200] for b in ((t or "").encode() for t in texts) for i in range(len(b) - 199))
    got = {r["doc_id"]: r for r in suffixes.without_repeats(df).collect()}
    bodies = {r["doc_id"]: r["kept_text"] for r in suffixes.without_repeats(df, bodies=True).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                gone[k : k + 200] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want = (len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want
        assert bodies[i] == kept.decode("utf-8", "ignore")


@pytest.fixture
def moving_cores(spark, monkeypatch):
    """A cluster whose cores change with every stored result, and scans that are split by them."""
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.unset(keys[0])
    spark.conf.set(keys[2], "1")
    cores = itertools.cycle((1, 8))

    def moved(df, name, f=common.stored):
        out = f(df, name)
        spark.conf.set(keys[1], str(next(cores)))
        return out

    for module in (ngram_join, suffixes):
        monkeypatch.setattr(module, "stored", moved)
    spark.conf.set(keys[1], "8")
    yield moved
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_keep_their_numbers_as_executors_come_and_go(spark, tmp_path, moving_cores):
    rng = random.Random(3)
    texts = [" ".join(str(rng.random()) for _ in range(3 + 2 * i)) for i in range(16)]
    path = str(tmp_path / "t")
    for i, t in enumerate(texts):  # files of different sizes
        spark.createDataFrame([(i, t), (i + 100, t)], DOC).coalesce(1).write.mode("append").parquet(path)
    df = spark.read.schema(DOC).parquet(path)
    numbered = moving_cores(common.with_row(df), "a").collect(), moving_cores(common.with_row(df), "b").collect()
    assert sorted(map(str, numbered[0])) == sorted(map(str, numbered[1]))
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.near_components(df).collect()) == sorted((i + k, i) for i in range(16) for k in (0, 100))
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(df).collect()) == list(range(16))
    kept = {r["doc_id"]: r["kept_text"] for r in suffixes.without_repeats(df, bodies=True).collect()}
    assert kept == {i + k: t if len(t) < suffixes.LENGTH else "" for i, t in enumerate(texts) for k in (0, 100)}


def test_contamination(table_of, texts):
    passage = texts[14].split()[40:100]
    items = [(1, " ".join(passage[:30])), (2, "three!"), (3, None), (4, "..."), (10, " ".join(passage[5:18])), (10, " ".join(passage[5:18])), (None, "one two")]
    docs = list(enumerate(texts))
    got = {r["doc_id"]: r for r in decontamination.contamination(table_of(clashing(docs), CLASH), table_of(items, "item_id long, text string", "b")).collect()}
    import re

    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for name, body in items:
            q = split(body)
            n = min(13, len(q))
            for s in range(len(q) - n + 1) if n else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == q[s : s + n]:
                        hit |= set(range(k, k + n))
                        names.add("" if name is None else str(name))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(names), decontamination.digest(list(names)), len(hit) > 0 and 20 * len(hit) >= len(w))
    empty = table_of([], "item_id long, text string", "none")
    assert decontamination.contamination(table_of(docs, DOC), empty).where("contaminated OR n_hit > 0").count() == 0


def brute_near(docs, items):
    """Items near each document: their rarest words of the corpus, at most four off their places."""
    import re

    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    words = {i: split(t) for i, t in docs}
    df = Counter(w for ws in words.values() for w in ws)
    out = {i: set() for i in words}
    for name, body in items:
        q = split(body)
        held = sorted((df[w], k) for k, w in enumerate(q) if df[w])
        if not q or len(held) < min(4, len(q)):
            continue
        (_, first), *others = held[:4]
        for i, ws in words.items():
            at = [p for p, w in enumerate(ws) if w == q[first]]
            if any(all(any(0 <= p + k - first + e < len(ws) and ws[p + k - first + e] == q[k] for e in range(-4, 5)) for _, k in others) for p in at):
                out[i].add("" if name is None else str(name))
    return {i: len(x) for i, x in out.items()}


def test_near_terms_are_found(table_of):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(2))
    docs = [(f"d{i}", " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(60)] + [("none", None), ("empty", "")]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 6)))) for i in range(40)] + [(3, "zz top"), (None, "aa bb"), (77, None)]
    found = decontamination.contamination(table_of(docs, "doc_id string, text string"), table_of(items, "item_id long, text string", "b")).collect()
    want = brute_near(docs, items)
    assert {r["doc_id"]: r["n_near"] for r in found} == want and sum(want.values()) > 20


def test_contamination_in_small_pieces(table_of, monkeypatch):
    """Many probes, candidates and shards: the same rows as in one piece."""
    rng = random.Random(9)
    word = lambda: rng.choice("the a of some many few red blue green".split())
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 200)))) for i in range(40)]
    items = [(i, " ".join(docs[i][1].split()[:20])) for i in range(30)]
    d, b = table_of(docs, DOC), table_of(items, "item_id long, text string", "b")
    whole = sorted(map(str, decontamination.contamination(d, b).collect()))
    for name, value in (("PROBES", 20), ("SHARD_WORDS", 300), ("CANDIDATES", 7), ("VOCABULARY", 3)):
        monkeypatch.setattr(decontamination, name, value)
    assert sorted(map(str, decontamination.contamination(d, b).collect())) == whole


def sketch_of(text):
    words = (text or "").lower().translate(str.maketrans("\t\n\r\x0b\x0c", "     ")).split(" ")
    h, out = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words if w], []
    chain = lambda hs: __import__("functools").reduce(lambda seed, x: xxhash.xxh64(int(x).to_bytes(8, "little"), seed=seed).intdigest(), hs, 42)
    out = [chain(h[i : i + 5]) for i in range(len(h) - 4)] if len(h) >= 5 else [chain(h)] if h else []
    signed = {x - (1 << 64) if x >= 1 << 63 else x for x in out}
    low = {x for x in signed if x < fingerprints.limit()}
    return low or ({min(signed)} if signed else set())


def test_fingerprints(table_of, texts):
    rows = list(zip([3 * i for i in range(len(texts))], texts))
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(table_of(rows, DOC)).collect()}
    clean = [t or "" for t in texts]
    jaccard = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for n, (i, _) in enumerate(rows):
        t, after = clean[n], clean[(n + 1) % len(clean)]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        r, a, b = got[i], sketch_of(t), sketch_of(edited)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{x & (2**64 - 1):016x}" for x in sorted(a))
        assert abs(r["near_edited"] - jaccard(a, b)) < 1e-12 and abs(r["near_next"] - jaccard(a, sketch_of(after))) < 1e-12
    both = table_of([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, None)], DOC, "r")
    again = fingerprints.edited_fingerprints(both).collect()
    assert len(again) == 3 and len({r["fingerprint"] for r in again if r["n_chars"]}) == 1
    assert fingerprints.edited_fingerprints(table_of([], DOC, "e")).count() == 0


def test_sketches_merge(spark):
    a, b = "the quick brown fox jumps over the lazy dog again " * 3, "some other words stand here in a row for once"
    one = spark.range(1).select(fingerprints.merge(fingerprints.sketch(F.lit(a)), fingerprints.sketch(F.lit(b))).alias("m")).first()["m"]
    both = spark.range(1).select(fingerprints.thinned(F.concat(fingerprints.shingles(F.lit(a)), fingerprints.shingles(F.lit(b)))).alias("m")).first()["m"]
    assert one == both


def test_mixing(table_of):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(400, None, "a"), (401, "", "empty"), (7, "again and again", "b"), (None, "no id here", "c")]
    df = table_of(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect())) and len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    source_of = {i: s for i, _, s in rows if i not in (7, None)}  # ids that name one row
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        if r["doc_id"] in source_of:
            assert abs(r["target"] - target[source_of[r["doc_id"]]]) < 1e-6
            taken[source_of[r["doc_id"]]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 200)
    assert mixing.mix(table_of([], "doc_id long, text string, source string", "e")).count() == 0


@pytest.mark.parametrize("slots", [16, 64, 1024])
def test_mixing_of_tiny_sources_beside_a_huge_one(table_of, slots):
    """Blocks are large against the tiny sources, one of which is just over a block at 64 slots."""
    texts = [("a", 300, 500), ("b", 60, 50), ("c", 20, 181), ("d", 1, 7), ("e", 3, 1)]
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, k, n in texts for _ in range(k))]
    taken, target = defaultdict(int), {}
    for r in mixing.mix(table_of(rows, "doc_id long, text string, source string"), slots=slots).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[rows[r["doc_id"]][2]] += r["taken"]
        target[rows[r["doc_id"]][2]] = r["target"]
    for s in "bcde":
        assert taken[s] == round(target[s])
    assert abs(taken["a"] - target["a"]) <= 0.02 * target["a"]


def test_chunking(table_of):
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 123, 20_000).astype(np.uint8)
    ends = chunking.cuts(raw)
    assert ends[-1] == len(raw) and (np.diff(ends, prepend=0)[:-1] >= chunking.LEAST).all()
    moved = chunking.cuts(np.concatenate([raw[:5000], np.frombuffer(b"insert", np.uint8), raw[5000:]]))
    assert len(set(ends[ends > 5600]) - set(moved - 6)) == 0  # cuts past the insertion are the same
    slow = []
    h = 0
    for b in raw[:200]:
        h = (2 * h + int(chunking._GEAR[b])) & 0xFFFF
        slow.append(h)
    assert chunking.gear(raw[:200])[16:].tolist() == slow[16:]
    text = raw.tobytes().decode()
    other = rng.integers(97, 123, 3000).astype(np.uint8).tobytes().decode()
    rows = [(1, text), (2, text), (3, other[:1500] + text[4000:4600] + other[1500:]), (4, None), (5, ""), (6, other[:90])]
    got = {r["doc_id"]: r for r in chunking.chunk_dedup(table_of(clashing(rows), CLASH)).collect()}
    assert got[1]["n_removed"] + got[2]["n_removed"] == len(text)
    assert 400 <= got[3]["n_removed"] <= 600 and other[:1400] in got[3]["kept_text"]
    assert got[4]["kept_text"] == "" and got[6]["n_removed"] == 0


def test_token_files(spark, tmp_path, table_of, monkeypatch):
    """Flat files cut into ranges for several tasks, with separators at the seams."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(tokens, "RANGE", 2)
    lengths = [0, 5, 0, 70, 3, 200, 1, 15, 31, 0, 32]
    stream = np.concatenate([np.append(rng.integers(0, 99, n), 99) for n in lengths] + [rng.integers(0, 99, 4)]).astype("<u2")
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "a.ids").write_bytes(stream.tobytes() + b"x")  # and a byte that is no id
    (tmp_path / "flat" / "b.ids").write_bytes(b"")
    (tmp_path / "flat" / "c.ids").write_bytes(np.full(64, 99, "<u2").tobytes())
    files = tokens.listed_files(spark, str(tmp_path / "flat"))
    found = tokens.token_counts(files, end=99, block=16).orderBy("file", "ordinal").collect()
    a, c = ([r for r in found if r["file"].endswith(n)] for n in ("a.ids", "c.ids"))
    assert len(found) == len(a) + len(c) and [r["n_tokens"] for r in c] == [0] * 64
    assert [r["n_tokens"] for r in a] == [*lengths, 4] and [r["closed"] for r in a] == [True] * len(lengths) + [False]
    assert [r["first_token"] for r in a] == np.cumsum([0, *(n + 1 for n in lengths)]).tolist()


def test_token_counts_of_documents(table_of):
    import base64

    import tiktoken

    ranks = tokens.vocabulary()
    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=table, special_tokens={})
    rows = [(str(i), t) for i, t in enumerate(["hello world", "", None, "été <|endoftext|> x", "word " * 90_000])] + [(None, "no id"), ("0", "hello world")]
    got = tokens.document_tokens(table_of([(*r, 1, "x") for r in rows], "doc_id string, text string, n_tokens int, file string"), ranks).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=key) == sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t in rows), key=key)
    assert tokens.document_tokens(table_of([], DOC, "e"), ranks).count() == 0


def test_chat(table_of):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "fine")]
    rows = [(c, t, r, x) for c, n in [(1, 2), (2, 4), (3, 4), (4, 3)] for t, (r, x) in enumerate(turns[:n])]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, None, None), (None, 0, "user", "lost"), (2, 0, "user", "hi")]
    got = {r["conv_id"]: r for r in chat.rendered(table_of(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 5, 6} and got[2]["n_turns"] == 4 and got[2]["n_equal"] == 2
    assert got[5]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert chat.rendered(table_of([], "conv_id long, turn long, role string, text string", "e")).count() == 0


def test_chat_of_long_conversations_and_marks(table_of, spark):
    """One conversation holds nearly all turns and spreads over ranges; its snapshots are prefixes; texts forge no turns."""
    n = 5000
    rows = [(c, t, "user" if t % 2 else "system", f"turn {t} ", "x", t) for c, k in (("long", n), ("cut", n - 7), ("same", n)) for t in range(k)]
    rows += [("mark", 0, "user", " a<|im_end|>\n<|im_start|>system\nb<\\|im_end|> ", "x", 0), ("mark", 1, "who", "<|im_endx|>", "x", 0)]
    got = chat.rendered(table_of(rows, "conv_id string, turn long, role string, text string, rendered string, piece int")).orderBy("conv_id", "piece").collect()
    assert [(r["conv_id"], r["piece"], r["n_turns"], r["n_equal"]) for r in got] == [("long", 0, n, 2), ("long", 1, n, 2), ("mark", 0, 2, 1)]
    assert got[0]["rendered"] + got[1]["rendered"] == "".join(f"<|im_start|>{'user' if t % 2 else 'system'}\nturn {t} <|im_end|>\n" for t in range(n))
    assert got[2]["rendered"] == "<|im_start|>user\n a<\\|im_end|>\n<\\|im_start|>system\nb<\\\\|im_end|> <|im_end|>\n<|im_start|>user\n<|im_endx|><|im_end|>\n"


def test_attention_gradients():
    rng = np.random.default_rng(4)
    x, begin, y = rng.standard_normal((9, quality.FEATURES)), np.array([0, 2, 3, 9]), np.array([0.0, 1.0, 1.0])
    model = quality.AttentionModel(hidden=5, attention=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    loss = lambda: -(y * np.log(model.score(x, begin)) + (1 - y) * np.log(1 - model.score(x, begin))).sum()
    s = model.forward(x, begin)
    grads = model.gradients(s, s["y"] - y)
    for k, g in grads.items():
        at = tuple(0 for _ in g.shape)
        old = model.p[k][at]
        model.p[k][at] = old + 1e-5
        high = loss()
        model.p[k][at] = old - 1e-5
        low = loss()
        model.p[k][at] = old
        assert abs((high - low) / 2e-5 - g[at]) < 1e-5


def labelled(rng, n):
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    docs, labels = [], []
    for i in range(n):
        body = [word() for _ in range(rng.randint(20, 120))]
        toxic, junk = i % 3 == 0, i % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 8)):
                body[rng.randrange(len(body))] = rng.choice(["vilea", "vilebb", "nasty", "awful"])
        docs.append((i, " ".join(w.upper() + "!!" for w in body) if junk else " ".join(body)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_models(table_of):
    docs, labels = labelled(random.Random(6), 500)
    docs += [(1000, None), (1001, ""), (1002, "x " * 30_000), (3, docs[3][1]), (None, "no id")]
    d, l = table_of(clashing(docs), CLASH), table_of([*labels, (3, 1, 1), (4, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int", "l")
    scored = quality.quality(d, l).collect()
    truth = {i: (q, t) for i, q, t in labels}
    unseen = [r for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert len(scored) == len(docs) and sum(r["predicted"] == truth[r["doc_id"]][0] for r in unseen) >= 0.95 * len(unseen)
    kept = quality.quality_scores(d, quality.AttentionModel(), score="_score", passages="_p")
    assert set(d.columns) <= set(kept.columns)
    model = toxicity.train(d, l)
    found = toxicity.severities(d, model).withColumn("held_out", quality.held_out("doc_id")).collect()
    unseen = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(found) == len(docs) and sum(r["toxic"] == bool(truth[r["doc_id"]][1]) for r in unseen) >= 0.9 * len(unseen)
    assert (np.diff(model.thresholds) >= 0).all()
    none = table_of([], "doc_id long, quality int, toxic int", "n")
    assert {r["score"] for r in quality.quality(d, none).collect()} == {0.5}
    assert toxicity.severities(d, toxicity.train(d, none)).where("toxic").count() == 0


def test_chunk_dedup_by_brute_force(table_of, texts):
    """Chunks cut byte by byte, in table order; those seen before go in runs of 100 bytes and more."""
    texts = [*texts, texts[6] + " and more", "z" * 5000, "é" * 3000]
    df = table_of([(i, t, "f", b"c", 1) for i, t in enumerate(texts)], "doc_id long, text string, file string, digest binary, n_removed int")
    seen, want = set(), {}
    for row in df.collect():  # the table's order
        raw = (row["text"] or "").encode()
        h, last, pieces = 0, 0, []
        for k, byte in enumerate(raw, 1):
            h = (2 * h + int(chunking._GEAR[byte])) & 0xFFFF
            if k - last >= chunking.MOST or (k - last >= chunking.LEAST and h >> 11 == 0 and len(raw) - last > chunking.LEAST):
                pieces.append((last, k))
                last = k
        if last < len(raw):
            pieces.append((last, len(raw)))
        gone, runs = [], []
        for a, b in pieces:
            if raw[a:b] in seen:
                gone.append((a, b))
            seen.add(raw[a:b])
        for a, b in gone:
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        keep = bytearray(raw)
        for a, b in reversed(runs):
            if b - a >= chunking.SHORTEST:
                del keep[a:b]
        want[row["doc_id"]] = (len(raw), len(raw) - len(keep), keep.decode("utf-8", "ignore"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_text"]) for r in chunking.chunk_dedup(df).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 2000


def plain_passages(text):
    """Features of the passages of one text, counted one by one."""
    raw = (text or "").encode()
    spans, at = [], None
    for k, byte in enumerate([*raw, 32]):
        if byte in (9, 10, 11, 12, 13, 32):
            if at is not None:
                spans.append((at, k))
            at = None
        elif at is None:
            at = k
    groups = [spans[i : i + quality.PASSAGE] for i in range(0, len(spans), quality.PASSAGE)] or [[]]
    edges = [0, *(g[0][0] for g in groups[1:]), len(raw)]
    fold = [b + 32 if 65 <= b <= 90 else b for b in raw]
    out = []
    for g, a, b in zip(groups, edges[:-1], edges[1:]):
        kinds, pairs = [0] * quality.GROUPS, [0] * quality.PAIRS
        for k in range(a, b):
            kinds[quality._GROUP[raw[k]]] += 1
            if k + 1 < len(raw):
                pairs[(fold[k] * 31 + fold[k + 1] * 7919 >> 2) % quality.PAIRS] += 1
        n, sizes = max(1, len(g)), [y - x for x, y in g]
        mean = sum(sizes) / n
        spread = max(sum(x * x for x in sizes) / n - mean**2, 0) ** 0.5
        distinct = len({bytes(fold[x:y]) for x, y in g})
        capital = sum(65 <= raw[x] <= 90 for x, _ in g)
        size = max(1, b - a)
        out.append([(k / size) ** 0.5 for k in (*kinds, *pairs)] + [mean / 10, spread / 10, distinct / n, capital / n, np.log1p(len(g)) / 5, np.log1p(len(spans)) / 10])
    return np.array(out)


def plain_score(model, x):
    """Gated attention over the rows of ``x``, one passage at a time."""
    p = model.p
    h = [np.tanh((row - model.mean) / model.scale @ p["W"] + p["b"]) for row in x]
    e = [float((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"]) for v in h]
    share = np.exp(np.array(e) - max(e))
    z = sum(s * v for s, v in zip(share / share.sum(), h))
    return float(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))))


def test_quality_scores_by_brute_force(table_of, texts):
    texts = [*texts, "One Two\t3,4!\n" * 150, "  x  ", "ÀÉ" * 40]
    model = quality.AttentionModel()
    model.mean, model.scale = np.linspace(0, 0.3, quality.FEATURES).astype(np.float32), np.linspace(0.2, 1, quality.FEATURES).astype(np.float32)
    got = {r["doc_id"]: r for r in quality.quality_scores(table_of(list(enumerate(texts)), DOC), model).collect()}
    for i, t in enumerate(texts):
        x = plain_passages(t)
        assert got[i]["passages"] == len(x) and abs(got[i]["score"] - plain_score(model, x)) < 2e-4


def test_severities_by_brute_force(table_of, texts):
    """Grades of a model with known weights, summed word by word."""
    texts = [*texts, "vile viler vilest words", "VILE! nasty; Nastily", "nasty " * 400]
    model, rng = toxicity.CumulativeLink(), np.random.default_rng(3)
    model.weights[:] = np.maximum(rng.standard_normal(toxicity.DIMENSIONS), 0) / 50
    model.thresholds[:] = [0.5, 1.5, 2.0]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    import re

    def features(t):
        found = set()
        for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower()):
            for k, part in [(0, w), (4, w[:4]), (5, w[:5])]:
                raw = np.frombuffer(part, np.uint8)
                h = toxicity.hash_spans(raw, np.array([0]), np.array([len(raw)]))
                found.add(int((toxicity.mix(h + np.uint64(k)) if k else h)[0] >> np.uint64(44)))
        return found

    got = {r["doc_id"]: r for r in toxicity.severities(table_of(list(enumerate(texts)), DOC), model).collect()}
    for i, t in enumerate(texts):
        s = sum(float(model.weights[f]) for f in features(t))
        below = [sigmoid(x - s) for x in model.thresholds]
        p = np.diff([0, *below, 1])
        assert abs(got[i]["expected_severity"] - p @ np.arange(4)) < 1e-6 and abs(got[i]["p_toxic"] - (1 - p[0])) < 1e-6
        assert got[i]["severity"] == int(np.argmax(p)) and got[i]["toxic"] == (p[0] < 0.5)


def test_classifiers_take_ids_of_any_kind_and_repeated_rows(table_of):
    """Text ids, and one labelled id that fills more rows than the sample: all labelled ids are learnt from."""
    docs, labels = labelled(random.Random(6), 60)
    rows = [(f"k{i}", t) for i, t in docs] + [("k0", f"again {i}") for i in range(300)]
    d, l = table_of(rows, "doc_id string, text string"), table_of([(f"k{i}", *x) for i, *x in labels], "doc_id string, quality int, toxic int", "l")
    one, two = (quality.train(d, l, sample=40) for _ in range(2))
    assert all((one.p[k] == two.p[k]).all() for k in one.p)
    assert quality.quality(d, l).count() == len(rows) and toxicity.severities(d, toxicity.train(d, l, sample=40)).count() == len(rows)


def test_empty_tables(table_of):
    e, none = table_of([], DOC, "e"), table_of([], "doc_id long, quality int, toxic int", "n")
    assert ngram_join.near_components(e).count() == 0 and ngram_join.one_of_each(e).count() == 0
    assert suffixes.without_repeats(e).count() == 0 and chunking.chunk_dedup(e).count() == 0
    assert decontamination.contamination(e, table_of([(1, "a b")], "item_id long, text string", "i")).count() == 0
    assert quality.quality(e, none).count() == 0 and toxicity.severities(e, toxicity.train(e, none)).count() == 0


def test_large_keys_are_looked_up_apart(table_of, spark):
    rows = [(1, i) for i in range(900)] + [(2 + i // 2, i) for i in range(100)] + [(None, 7)]
    keyed = Counter(k for k, _ in rows if k is not None)
    left = table_of(rows, "k long, x long")
    right = table_of([(k, n, f"of {k}") for k, n in keyed.items() if k != 5] + [(99, 1, "of none")], "k long, n long, y string", "right")
    found = common.looked_up(left, right, ["k"], "n")
    assert Counter((r.k, r.x, r.y) for r in found.collect()) == Counter((k, x, f"of {k}") for k, x in rows if k not in (None, 5))
    empty = common.looked_up(left.where("false"), right.where("false"), ["k"], "n")
    assert empty.columns == found.columns and empty.count() == 0
