"""From raw documents to a training mix: five stages over whole tables.

``STAGES`` lists them in order.  Each takes (spark, docs, sf_dir) and works on all rows
its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontamination, mixing, ngram_join, quality, suffixes
from tesserae.llm.common import ROW, light, masked, stored, table, with_row


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names that clash with nothing, and the new name of each column."""
    plain = masked(docs)
    return plain, dict(zip(docs.columns, plain.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go; it learns from the labelled ones of ``docs`` that are not held out.

    Null and empty texts are scored as one empty passage, long ones whole; repeated rows go
    or stay together; rows with a null id are scored like others; all columns stay, whatever
    their names.  Without labels of both kinds every score is one half, so all documents go;
    an empty table gives an empty result.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    plain, name = _plain(docs)
    scored = quality.quality_scores(plain, model, text=name["text"])
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*plain.columns).toDF(*docs.columns)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id; of equal or null ids the first row.

    Documents without words (null, empty, blank) stay, all of them; long texts are compared
    whole; of repeated rows one stays; all columns stay, whatever their names; an empty
    table gives an empty result.
    """
    return ngram_join.one_of_each(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes and more that stand elsewhere too go from the texts; documents stay, if with less text.

    ``n_chars``, where there is such a column, follows the text.  Null texts stay null,
    short ones whole; repeated rows of 200 bytes and more lose what they share, all of
    them; no row goes; all columns stay, whatever their names; an empty table gives an
    empty result.
    """
    plain, name = _plain(docs)
    found = suffixes.without_repeats(plain, text=name["text"], bodies=True)
    text = F.when(F.col(name["text"]).isNotNull(), F.col("kept_text"))
    if "n_chars" in name:
        kept = F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(name["n_chars"]))
        found = found.withColumn(name["n_chars"], kept)
    return found.withColumn(name["text"], text).select(*plain.columns).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make up a twentieth or more go.

    Null and empty texts have no words and stay; long texts are searched whole; repeated
    rows are judged apart and alike; all columns stay, whatever their names; an empty table
    gives an empty result, an empty benchmark removes nothing.
    """
    found = decontamination.contamination(with_row(docs.select("text")), table(spark, sf_dir, "benchmark"), key=ROW)
    dirty = stored(found.where("contaminated").select(ROW), "dirty")
    plain = masked(docs)
    return with_row(plain).join(light(dirty), ROW, "left_anti").select(*plain.columns).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes.

    Documents without words take none; a null source is a source of its own; repeated rows
    and rows that share an id are dealt apart; other columns are left out; an empty table
    gives an empty result.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("ngram_join", ngram_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: A learnt classifier decides the first stage; no SQL states it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
