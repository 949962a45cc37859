"""Operator 4: collapse of cumulative conversation snapshots, then chat formatting.

Logs often hold a conversation once per turn, each time a little longer.  Every turn
gets a rolling hash of all turns so far; a conversation whose last hash stands inside a
longer one is a prefix of it and goes, by an anti-join.  Of equal conversations the one
of least id stays.  What remains is rendered turn by turn.

Turns are hashed with their place, and prefixes combine by exclusive or, so the rolling
hash is a running aggregate.  All turns are sorted together and scanned range by range, so
a conversation of any length is spread over tasks: counts and hashes are carried from range to
range, and whether a range's last turn is its conversation's shows in the next range's first row.  The one join by
conversation, of what is kept with its turns, broadcasts conversations of many turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, looked_up, stored

PIECE = 4096  # turns rendered into one row; a longer conversation takes several
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ROLES = ("system", "user", "assistant", "tool")
MARK = r"<(\\*\|im_(?:start|end)\|>)"  # in a text, with any backslashes of its own; one more tells it from a real one


def _carried(rows: DataFrame, **totals: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """``rows`` with a column for each total (an aggregate and its running form) of the conversation's turns in earlier ranges, null where there are none.

    Only conversations that reach into another range have such a row, one a range at most.
    """
    sums = rows.groupBy("_conv", "_part").agg(*[total.alias(f"_{name}") for name, (total, _) in totals.items()])
    reach = Window.partitionBy("_conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_conv", "_part", *[running(f"_{name}").over(reach).alias(name) for name, (_, running) in totals.items()])
    return rows.join(F.broadcast(carried.where(F.col(next(iter(totals))).isNotNull())), ["_conv", "_part"], "left")


def rolled(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with their place ``_at`` in the conversation, two 64-bit hashes of all turns up to there, and whether they are the ``_last``."""
    base = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).cast("string").alias("_role"), F.col(text).cast("string").alias("_text"))
    base = in_order(base.distinct(), "_conv", F.col("_turn").asc_nulls_first(), F.col("_role").asc_nulls_first(), F.col("_text").asc_nulls_first())
    heads = base.where("_inside = 0").select("_part", "_conv")  # a row a range; ranges may be empty
    heads = heads.select(F.lag("_part").over(Window.orderBy("_part")).alias("_part"), F.col("_conv").alias("_head"))
    inner = Window.partitionBy("_conv", "_part").orderBy("_inside")
    base = base.withColumn("_more", F.lead("_inside").over(inner)).join(F.broadcast(heads), "_part", "left")
    base = base.withColumn("_last", F.col("_more").isNull() & ~F.col("_head").eqNullSafe(F.col("_conv"))).drop("_more", "_head")
    base = _carried(base.withColumn("_at", F.row_number().over(inner).cast("long")), before=(F.count("*"), F.sum))
    base = base.withColumn("_at", F.col("_at") + F.coalesce("before", F.lit(0))).drop("before")
    marks = [c for name in ("_role", "_text") for c in (F.col(name), F.col(name).isNull())]  # the hash itself passes over nulls
    for name, salt in (("_h1", "a"), ("_h2", "b")):
        base = base.withColumn(name, F.xxhash64(F.lit(salt), "_at", *marks))
    base = _carried(base, e1=(F.bit_xor("_h1"), F.bit_xor), e2=(F.bit_xor("_h2"), F.bit_xor))
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    hashes = [F.bit_xor(f"_h{k}").over(so_far).bitwiseXOR(F.coalesce(f"e{k}", F.lit(0))).alias(f"_p{k}") for k in (1, 2)]
    return base.select("_conv", "_role", "_text", "_at", "_last", *hashes)


def maximal(prefixes: DataFrame) -> DataFrame:
    """``_conv`` and ``_n`` of the conversations that are no proper prefix of another one and the least of their equals."""
    ends = prefixes.where("_last").select("_conv", F.col("_at").alias("_n"), "_p1", "_p2")
    first = ends.groupBy("_n", "_p1", "_p2").agg(F.min("_conv").alias("_conv"), F.count("*").alias("_equal"))
    inner = prefixes.where("NOT _last").groupBy(F.col("_at").alias("_n"), "_p1", "_p2").agg(F.count("*").alias("c"))  # a shared opening counts once
    return first.join(inner, ["_n", "_p1", "_p2"], "left_anti").select("_conv", "_n", "_equal")


def rendered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The maximal conversations in chat markup: ``conv_id``, ``piece``, ``n_turns`` (of the whole), ``n_equal``, ``rendered``.

    A piece holds up to ``PIECE`` turns; pieces in order make up the conversation.  Rows
    without a conversation id are left out; repeated turn rows count once; turns of one
    number go by role and text, nulls first; null text is empty, other texts stand as they
    are but for marks of the format in them, which get a backslash (``<\\|im_end|>``); unknown
    or null roles speak as ``user``.  Other columns are left out.  An empty table gives an
    empty result.
    """
    prefixes = stored(rolled(turns, conv, turn, role, text), "prefixes")
    kept = looked_up(prefixes, stored(maximal(prefixes), "maximal"), ["_conv"], "_n")
    speaker = F.lower(F.trim("_role"))
    speaker = F.when(speaker.isin(*ROLES), speaker).otherwise(F.lit("user"))
    line = F.concat(F.lit(OPEN), speaker, F.lit("\n"), F.regexp_replace(F.coalesce("_text", F.lit("")), MARK, r"<\\$1"), F.lit(CLOSE + "\n"))
    lines = kept.select("_conv", "_n", "_equal", F.expr(f"(_at - 1) div {PIECE}").alias("piece"), F.struct("_at", line.alias("line")).alias("l"))
    pieces = lines.groupBy("_conv", "piece", "_n", "_equal").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return pieces.select(F.col("_conv").alias(conv), "piece", F.col("_n").alias("n_turns"), F.col("_equal").alias("n_equal"), F.array_join(F.transform("ls", lambda x: x["line"]), "").alias("rendered"))
