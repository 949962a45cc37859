"""Cases that operators once got wrong: many and tiny sources, very long blank runs, repetitive texts, one long conversation."""

import base64
import random
import time
from collections import defaultdict

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F

from tesserae.llm import chat, common, decontamination, fingerprints, mixing, oracles, tokens
from tesserae.llm.queries import op5_source_mixing

DOC = "doc_id long, text string, source string"


def by_statement(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return sorted(con.execute(oracles.OP5).fetchall())


@pytest.mark.parametrize("case", ["equal", "millionth"])
def test_mixing_deals_every_source_by_its_schedule(spark, tmp_path, monkeypatch, case):
    """Ten thousand equal sources; sources of a millionth of the mix beside large ones."""
    rng = random.Random(2)
    if case == "equal":
        rows = [(i, "w " * (3 + i % 2), f"s{i % 10_000:05d}") for i in range(20_000)]
    else:
        sizes = [("a", 40, 30_000), ("b", 30, 1000), ("c", 1, 3), ("d", 1, 1), ("e", 9, 40)]
        rows = [(i, "w " * n, s) for i, (s, n) in enumerate((s, rng.randint(1, 2 * n) if n > 3 else n) for s, k, n in sizes for _ in range(k))]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_source_mixing(spark, str(tmp_path)).collect()
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_at"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == by_statement(tmp_path)
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["first_at"] is None) == (r["taken"] == 0)
        taken[rows[r["doc_id"]][2]] += r["taken"]
        target[rows[r["doc_id"]][2]] = r["target"]
    assert all(taken[s] == round(t) for s, t in target.items())
    places = sorted(r["first_at"] for r in got if r["first_at"] is not None)
    assert places[0] < 0.1 and places[len(places) // 2] < 0.9
    plan = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda dealt: plan(dealt).where("false"))
    assert all(r["taken"] == 0 for r in op5_source_mixing(spark, str(tmp_path)).collect())


def test_mixing_of_null_and_repeated_ids_and_other_columns(table_of):
    rows = [(None if i % 3 else 5, "one two three " * 4, None, 1, "x", 2.0) for i in range(600)] + [(9, "w " * 30_000, "a", 1, "x", 2.0), (10, None, "a", 1, "x", 2.0)]
    df = table_of(rows, "doc_id long, text string, source string, size int, sid string, taken double")
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "first_at"]
    found = got.collect()
    assert len(found) == 602 and sorted(map(str, found)) == sorted(map(str, mixing.mix(df).collect()))
    null = [r for r in found if r["doc_id"] in (None, 5)]
    assert sum(r["taken"] for r in null) == round(null[0]["target"]) and {r["size"] for r in null} == {12}


def test_streams_spread_one_id_over_tasks(spark, table_of):
    """A null id holds a third of all rows; no task of the running sums has more than a fair share."""
    df = table_of([(None, "a b", "s") for _ in range(4000)] + [(i, "a b", "s") for i in range(8000)], DOC)
    sized = mixing.with_row(df.select(F.col("doc_id").alias("_key"), F.lit(0).alias("sid"), F.lit(2).alias("size")))
    placed = mixing.streams(sized)
    assert sorted(r["start"] for r in placed.select("start").collect()) == list(range(0, 24_000, 2))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = mixing.in_order(sized, "sid", F.md5(F.coalesce(F.col("_key").cast("string"), F.lit("null"))), "_row").groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 6000


def test_very_long_blank_runs_are_encoded():
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in tokens.vocabulary().splitlines() if line)}
    encoding = tiktoken.Encoding("flat", pat_str=tokens.PATTERN, mergeable_ranks=table, special_tokens={})
    for blank in (" ", "\t", "\n", " \n", "　", "\r\n"):
        for before in ("", "word", "x 1"):
            for after in ("", "word", "'s", "!", "1"):
                for n in (tokens.LONG - 1, tokens.LONG, 3 * tokens.LONG + 1):
                    t = before + (blank * n)[:n] + after
                    assert tokens.encoded(encoding, t) == encoding.encode_ordinary(t)
                t = before + blank * 1_000_000 + after
                assert encoding.decode(tokens.encoded(encoding, t)) == t


def test_token_counts_of_a_million_blanks(table_of):
    rows = [(1, " " * 1_000_000), (2, "\n" * 1_000_000 + "word"), (3, "a"), (4, "\t" * 1_000_000)]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.document_tokens(table_of(rows, "doc_id long, text string"), tokens.vocabulary()).collect()}
    assert got[3] == 1 and got[1] > 0 and got[2] > 1 and got[4] > 0


@pytest.mark.parametrize("words", [["w"], ["a", "b"], ["x", "y", "z", "x"]])
def test_repetitive_item_and_document(table_of, words):
    """Item and document of 20,000 words that repeat take no pair of windows and places each."""
    n = 20_000
    text = " ".join(words[i % len(words)] for i in range(n))
    docs = table_of([(1, text), (2, f"other {text} words"), (3, "nothing here")], "doc_id long, text string")
    items = table_of([(7, text), (8, text), (9, " ".join(words * 9))], "item_id long, text string", "b")
    began = time.time()
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, items).collect()}
    assert time.time() - began < 60
    assert [got[i]["n_hit"] for i in (1, 2, 3)] == [n, n, 0] and [got[i]["n_items"] for i in (1, 2, 3)] == [3, 3, 0]
    assert got[2]["n_words"] == n + 2 and got[1]["items_sha256"] == decontamination.digest(["7", "8", "9"])


def test_one_conversation_of_most_turns_is_spread(spark, table_of):
    """No exchange of the plan gathers it by its id, and its ranges are many."""
    rows = [("long", t, "user", f"turn {t}") for t in range(20_000)] + [(f"c{i}", t, "user", f"turn {t}") for i in range(50) for t in range(3)]
    df = table_of(rows, "conv_id string, turn long, role string, text string")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        prefixes = common.stored(chat.rolled(df), "prefixes")
        kept = chat.rendered(df)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = kept.collect()
        parts = [r["n"] for r in prefixes.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sorted((r["conv_id"], r["piece"], r["n_turns"]) for r in got) == [("long", k, 20_000) for k in range(5)]
    assert "BroadcastHashJoin" in plan and len(parts) > 2 and max(parts) < 16_000
    assert prefixes.where("_last").count() == 51


def test_a_text_that_looks_like_a_null_is_none(table_of):
    rows = [(1, 0, "user", None), (2, 0, "user", "\x00null"), (3, 0, None, "x"), (4, 0, "\x00null", "x")]
    assert chat.rendered(table_of(rows, "conv_id long, turn long, role string, text string")).count() == 4


def test_fingerprints_beside_clashing_columns(table_of):
    rows = [(1, "a b c d e f g", "x", "y", 3), (2, None, "x", "y", 3), (None, "a b c d e f g", "x", "y", 3), (1, "", "x", "y", 3)]
    df = table_of(rows, "doc_id long, text string, Sketch string, fingerprint string, n_chars int")
    got = fingerprints.fingerprints(df).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "sketch", "fingerprint", "n_chars"} and {r["n_chars"] for r in got} == {3}
    by_text = {r["text"]: r["fingerprint"] for r in got}
    assert by_text[None] == by_text[""] != by_text["a b c d e f g"] and "y" not in by_text.values()
    edited = fingerprints.edited_fingerprints(df)
    assert "Sketch" not in edited.columns and edited.columns[:4] == ["doc_id", "n_chars", "edited_sha256", "fingerprint"]
    found = edited.collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in found) == [(0, 13), (1, 0), (1, 13), (2, 0)]
    assert {r["fingerprint"] for r in found if r["n_chars"]} == {by_text["a b c d e f g"]}
