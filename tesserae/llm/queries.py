"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table, and derives the contract's columns from its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunking, decontamination, fingerprints, mixing, ngram_join, periods, pii, quality, suffixes, tokens, toxicity, vafile
from .common import table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents")).drop("_row", "label")


def op3_toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.severities(docs, model).withColumn("held_out", quality.held_out("doc_id"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_tokens(table(spark, sf_dir, "documents"), tokens.vocabulary())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def looped(docs: DataFrame) -> DataFrame:
    """``documents`` in which a tenth of the texts, by their id's hash, repeat themselves from some word on.

    With ``h`` the hash, ``g = floor(h / 10)`` and ``n`` words, word ``i >= a`` becomes word ``a + (i - a) % p``,
    ``a = g % n`` and ``p = 1 + floor((n - a) / (3 + g % 8))``.  A null id has no hash and changes nothing.
    """
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("_h"))
    words = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = hashed.withColumn("_words", words).withColumn("_g", F.expr("_h div 10")).withColumn("_n", F.size("_words"))
    cut = cut.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    cut = cut.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    again = F.transform(F.expr("sequence(0L, _n - 1L)"), lambda i: F.get("_words", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return cut.select("doc_id", F.when(F.col("_n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(looped(table(spark, sf_dir, "documents")))
    first = "a.length * b.period > b.length * a.period"  # the exact quotients of lengths and periods
    then = "a.length * b.period < b.length * a.period"
    best = F.get(F.expr(f"array_sort(runs, (a, b) -> CASE WHEN {first} THEN -1 WHEN {then} THEN 1 ELSE 0 END)"), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("_best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.when(finite, F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double"))))
    return vafile.hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), (F.col("vec_id") % 100 == 0).alias("anchor"), vector.alias("vector")))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.personal_data(docs, pii.train(docs))
    plain = F.filter("spans", lambda s: s["plain"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


OPERATORS = (
    op1_document_fingerprints,
    op2_ngram_jaccard_join,
    op3_toxicity_grades,
    op4_chat_formatting,
    op5_source_mixing,
    op6_chunk_dedup,
    op7_suffix_dedup,
    op8_token_counts,
    op9_quality_classifier,
    op10_benchmark_decontamination,
    op11_periodic_runs,
    op12_hard_negatives,
    op13_personal_data,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}
