"""Operator 1 [native]: threshold-scaled document sketches.

A sketch keeps every five-word shingle hash below a fixed fraction of the hash
range, so its size follows the document's and sketches of very unequal documents
stay comparable: the union of two sketches is the sketch of the union, and the
share of a small document's hashes found in a large one estimates containment.
Where no hash is below the fraction, the smallest one alone is kept; merging
keeps that rule (:func:`merge`), so a text with words never has an empty sketch.

Only DataFrame functions run: no Python touches the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, in_order, with_row

WIDTH = 5
FRACTION = 8  # one shingle hash in so many is kept
BLANKS = r"[\x20\x09-\x0D]+"


def limit(fraction: int = FRACTION) -> int:
    """Signed 64-bit hashes below this value are the kept ``1 / fraction`` of the range."""
    return -(1 << 63) + (1 << 64) // fraction


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the word shingles of ``text``, with repeats; a shorter text is one shingle, no words give none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # a one-element array binds the word hashes once for the lambdas below
    return F.element_at(
        F.transform(
            F.array(hashes),
            lambda h: F.when(F.size(h) == 0, F.slice(h, 1, 0))
            .when(F.size(h) < width, F.array(F.xxhash64(h)))
            .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))),
        ),
        1,
    )


def thinned(hashes: Column, fraction: int = FRACTION) -> Column:
    """The sketch of a bag of hashes: distinct, ascending, those below the limit or else the smallest."""

    def pick(h: Column) -> Column:
        low = F.filter(h, lambda x: x < F.lit(limit(fraction)))
        return F.when(F.size(low) > 0, low).otherwise(F.slice(F.array(F.array_min(h)), 1, F.least(F.size(h), F.lit(1))))

    return F.array_sort(F.array_distinct(F.element_at(F.transform(F.array(hashes), pick), 1)))


def sketch(text: Column, width: int = WIDTH, fraction: int = FRACTION) -> Column:
    """The ascending array of kept hashes of ``text``; null or wordless text gives an empty array."""
    return thinned(shingles(text, width), fraction)


def merge(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """The sketch of two texts' shingles together."""
    return thinned(F.concat(a, b), fraction)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the sketched shingle sets; 1 for two empty sketches."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first set found in the second; 1 for an empty first sketch."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def encoded(hashes: Column) -> Column:
    """A sketch as text: sixteen lowercase hex digits a hash."""
    return F.lower(F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH, fraction: int = FRACTION) -> DataFrame:
    """``docs`` with ``sketch`` and its text form ``fingerprint``; a row-wise projection, so every row, null or repeated, keeps its place.

    Null text has the sketch of an empty one; columns of these two names, whatever their case, are replaced, all others stay; an
    empty table gives an empty result.
    """
    kept = docs.withColumn("sketch", sketch(F.col(text), width, fraction))
    return kept.withColumn("fingerprint", encoded(F.col("sketch")))


def following(docs: DataFrame, key: str) -> DataFrame:
    """Pairs (row, next row) in ascending ``key`` order, nulls first and ties by row; after the last comes the first.

    Only keys are sorted: a range exchange puts them in order, a window inside each
    range finds the neighbour, and the seams between ranges are stitched from one
    row a range.
    """
    ids = in_order(docs.select(key, ROW), F.col(key).asc_nulls_first(), ROW)
    inside = ids.withColumn("_next", F.lead(ROW).over(Window.partitionBy("_part").orderBy("_inside")))
    # one row a range, as many as shuffle partitions at most
    heads = inside.groupBy("_part").agg(F.min_by(ROW, "_inside").alias("_head"))
    order = Window.orderBy("_part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seams = heads.select("_part", F.coalesce(F.lead("_head").over(order), F.first("_head").over(whole)).alias("_seam"))
    return inside.join(F.broadcast(seams), "_part").select(ROW, F.coalesce("_next", "_seam").alias("_next"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sketches of every text and of its edit, with their likeness and that to the next document.

    The edit replaces the last quarter of the code points (rounded down) by as many
    leading ones of the next document, or all it has.  Null text is empty; rows that
    share an id follow each other in table order, those without one come first; a lone document is its own next;
    other columns are left out, whatever their names; an empty table gives an empty result.
    """
    docs = with_row(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")))
    cuts = docs.select(F.col(ROW).alias("_to"), F.expr("length(_text) div 4").alias("_cut"))
    needs = following(docs.select("_key", ROW), "_key").join(cuts, F.col(ROW) == F.col("_to")).select("_to", "_next", "_cut")
    # sketched before the shuffle: both joins take the same columns by the same key, so texts are sketched and shuffled once
    docs = docs.withColumn("_sketch", sketch(F.col("_text")))
    given = docs.join(needs, F.col(ROW) == F.col("_next"))
    tail = F.expr("substring(_text, 1, cast(_cut as int))").alias("_tail")
    given = given.select("_to", F.col("_key").alias("_next_key"), tail, F.col("_sketch").alias("_next_sketch"))
    edited = docs.join(given, F.col(ROW) == F.col("_to")).withColumn("_n", F.length("_text").cast("long"))
    edited = edited.withColumn("_edited", F.concat(F.expr("substring(_text, 1, cast(_n - _n div 4 as int))"), "_tail"))
    edited = edited.withColumn("_edited_sketch", sketch(F.col("_edited")))
    a, b, c = F.col("_sketch"), F.col("_edited_sketch"), F.col("_next_sketch")
    return edited.select(
        F.col("_key").alias(key),
        F.col("_n").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        encoded(a).alias("fingerprint"),
        encoded(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"),
        likeness(a, c).alias("near_next"),
        containment(a, b).alias("kept_share"),
        F.col("_next_key").alias("next_id"),
    )
