"""Operator 5: mixing sources to target weights by low-discrepancy schedules.

Golden-ratio points ``frac((i + 1/2) / phi)`` fall through the cumulative target shares and
name the source of slot ``i``; the k-th slot of a source takes the k-th equal-word block of
that source's shuffled stream, starting over after its end.  A source's last slot is
brought up or down so that its words end at the target.

No source is too small for slots.  Sources within a factor of ``SPREAD`` of each other's targets
form a level; a level has a schedule of its own, whose blocks follow from its least target, so
that every source has some ``SLOTS`` blocks, or blocks of one word.  Slot ``i`` of ``n`` stands at
``(i + 1/2) / n`` of the mix, whatever its level.

Running sums over a source go range by range of one sorted table and are carried over, so
no source, no null and no repeated id is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, in_order, stored, with_row

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SLOTS = 1024  # of the least source of a level, at least, where it has so many words
SPREAD = 16  # between the targets of a level
LEVELS = 16
SURELY = 4  # points a mean gap; fewer might leave a source of a few words without a slot
CHUNK = 4096  # slots ranked together
CELLS = 1024  # of the unit interval, at least, for the lookup of a slot's source
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row a source (``source``, ``source_size``, ``target``): ``share`` of all words dealt by weight,
    none above ``repeats`` times its size.  Dealing the excess again and again ends where
    every uncapped source has the same level per weight, which sorted caps give at once."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("room", F.col("cap") / F.col("weight"))
    by_room = Window.orderBy("room", "sid")
    per = per.withColumn("total", F.sum("source_size").over(everything) * share)
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("open", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("total") - F.col("before")) / F.col("open")
    per = per.withColumn("level", F.min(F.when(level <= F.col("room"), F.struct("room", "sid", level.alias("level")))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("sid", "source", "source_size", target.alias("target"))


def levels(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The sources that get ``words`` (their targets in whole ones) with their ``level``, its ``block`` and number of slots ``n``, and the source's share of it, from ``low`` up to ``high``."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = sum((F.col("words") * float(SPREAD) ** k <= F.col("_most")).cast("int") for k in range(1, LEVELS + 1))
    some = targets.withColumn("words", F.round("target").cast("long")).where("words > 0").withColumn("_most", F.max("words").over(everything)).withColumn("level", level)
    own = Window.partitionBy("level")
    some = some.withColumn("_upto", F.sum("words").over(own.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)))
    some = some.withColumn("_all", F.sum("words").over(own)).withColumn("_least", F.min("words").over(own)).withColumn("sources", F.count("*").over(own))
    some = some.withColumn("block", F.expr(f"greatest(1, _least div {slots})"))
    some = some.withColumn("n", F.expr(f"greatest((_all + block - 1) div block, ({SURELY} * _all + _least - 1) div _least)"))
    shares = [((F.col("_upto") - F.col("words")) / F.col("_all")).alias("low"), (F.col("_upto") / F.col("_all")).alias("high")]
    return some.select("sid", "source_size", "words", "level", "block", "n", "sources", *shares)


def schedule(dealt: DataFrame) -> DataFrame:
    """The mix itself, from stored :func:`levels`: the ``slot`` of a level, its place ``at`` in the mix, its source ``sid``
    and the words ``begin`` up to ``end`` of ``block`` that it takes from the source's stream, in ``round`` 0 or again."""
    spark = dealt.sparkSession
    frame = dealt.groupBy("level").agg(F.max("n").alias("n"), F.max("sources").alias("sources")).collect()  # LEVELS + 1 rows at most
    points = None
    for level, n, sources in frame:
        some = spark.range(n).select(F.lit(level).alias("level"), F.col("id").alias("slot"), F.lit(max(CELLS, sources)).alias("cells"))
        points = some if points is None else points.unionByName(some)
    if points is None:
        points = spark.range(0).selectExpr("0 AS level", "id AS slot", "1L AS cells")
    points = points.withColumn("point", F.expr(f"(slot + 0.5D) * {GOLDEN!r}D"))
    points = points.withColumn("point", F.col("point") - F.floor("point")).withColumn("cell", F.floor(F.col("point") * F.col("cells")))
    cells = F.greatest(F.lit(CELLS), "sources")
    spans = dealt.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), cells - 1))))
    hit = (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))
    named = points.join(spans, ["level", "cell"]).where(hit).select("slot", "n", "sid", "source_size", "words", F.col("block").alias("size"), F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = named.groupBy("sid", "chunk").agg(F.count("*").alias("here"))
    over = Window.partitionBy("sid")
    earlier = over.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "chunk", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(over).alias("slots"))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = named.withColumn("inside", inside).join(counts, ["sid", "chunk"]).withColumn("rank", F.col("before") + F.col("inside"))
    # the source's words end in block `over` of its last round, after `rest` words
    ranked = ranked.withColumn("blocks", F.expr("(source_size + size - 1) div size"))
    ranked = ranked.withColumn("rest", F.expr("words % source_size")).withColumn("ranks", F.expr("words div source_size * blocks + (rest + size - 1) div size"))
    ranked = ranked.where("rank < ranks").withColumn("last", F.when(F.col("rank") == F.col("slots") - 1, F.col("ranks") - 1).otherwise(F.col("rank")))
    taken = ranked.withColumn("r", F.explode(F.sequence("rank", "last"))).withColumn("block", F.expr("r % blocks"))
    end = F.when((F.col("r") == F.col("ranks") - 1) & (F.col("rest") > 0), F.col("rest")).otherwise(F.least((F.col("block") + 1) * F.col("size"), "source_size"))
    return taken.select("sid", "slot", ((F.col("slot") + 0.5) / F.col("n")).alias("at"), "block", F.expr("r div blocks").alias("round"), (F.col("block") * F.col("size")).alias("begin"), end.alias("end"))


def streams(sized: DataFrame, seed: str = "mix") -> DataFrame:
    """``sized`` (row, key, sid, size) with ``start``: where the row begins in its source's shuffled stream."""
    name = F.coalesce(F.col("_key").cast("string"), F.concat(F.lit("null:"), F.col(ROW).cast("string")))
    mixed = in_order(sized.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), name))), "sid", "_h", ROW)
    sums = mixed.groupBy("sid", "_part").agg(F.sum("size").alias("n"))  # a source's ranges
    earlier = Window.partitionBy("sid").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("sid", "_part").orderBy("_inside").rowsBetween(Window.unboundedPreceding, -1)
    mixed = mixed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return mixed.join(sums, ["sid", "_part"]).withColumn("start", F.col("_before") + F.col("start")).drop("_h", "_part", "_inside", "_before")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", slots: int = SLOTS) -> DataFrame:
    """Per row ``size``, ``source_size``, ``target``, ``taken`` words and ``first_at``, where in the mix (0 to 1) its first words stand.

    Null text has no words; a null source is a source of its own, the last; rows of no
    words take none and stand nowhere (null); rows sharing an id, or without one, are dealt apart; the
    other columns are left out, whatever their names; an empty table gives an empty result.
    """
    sized = with_row(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), F.col(text).alias("_text")))
    sized = stored(sized.select(ROW, "_key", "source", words(F.col("_text")).alias("size")), "sizes")
    targets = stored(source_targets(sized), "targets")
    dealt = stored(levels(targets, slots), "levels")
    named = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(ROW, "_key", "sid", "size", "source_size", "target")
    placed = streams(named).where("size > 0").join(dealt.select("sid", F.col("block").alias("_size")), "sid")
    spread = F.sequence(F.expr("start div _size"), F.expr("(start + size - 1) div _size"))
    pieces = placed.select(ROW, "sid", "start", "size", F.explode(spread).alias("block"))
    part = F.least(F.col("start") + F.col("size"), "end") - F.greatest("start", "begin")
    met = pieces.join(schedule(dealt).drop("slot", "round"), ["sid", "block"]).withColumn("part", part).where("part > 0")
    taken = met.groupBy(ROW).agg(F.sum("part").alias("taken"), F.min("at").alias("first_at"))
    full = named.join(taken, ROW, "left")
    return full.select(F.col("_key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_at")
