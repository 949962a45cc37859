"""Sums that do not depend on the order of their terms, and exact quantiles of bounded state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

STEPS = (10, 40, 40)  # bits of the bins' places below one, cumulative: 2**-10, 2**-50, 2**-90
BINS = 4096  # of a histogram
FEW = 4096  # values of a bin that are ranked as they are


def binned_sum(x: Column, name: str) -> list[Column]:
    """Aggregates that make up the sum of ``x``: whole numbers in bins of fixed places, which add without rounding.

    Partial sums combine before the exchange and in any order; :func:`total` puts the bins together.
    Terms are cut at 2**-90; NaN and infinities have a bin of their own; terms are below 2**53 and a sum has up to
    2**23 of them.
    """
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rest, out = F.when(finite, x), []
    for k, bits in enumerate(STEPS):
        scaled = rest * F.lit(2.0**bits)
        whole = F.floor(scaled)
        out.append(F.coalesce(F.sum(whole), F.lit(0)).alias(f"{name}{k}"))
        rest = scaled - whole
    return [*out, F.sum(F.when(~finite, x)).alias(f"{name}_odd")]


def total(name: str) -> Column:
    """The sum whose bins are the columns ``name``."""
    places = [sum(STEPS[: k + 1]) for k in range(len(STEPS))]
    terms = [F.col(f"{name}{k}").cast("double") * F.lit(2.0**-p) for k, p in enumerate(places)]
    exact = reduce(lambda a, b: b + a, reversed(terms))
    return F.coalesce(F.col(f"{name}_odd") + exact, exact)


def exact_quantiles(rows: DataFrame, by: list[str], value: str, fractions: list[float], names: list[str]) -> DataFrame:
    """``by`` and a column for each fraction: quantiles of ``value``, interpolated between neighbours.

    Histogram refinement: each pass counts the values of the bin that holds a rank in ``BINS`` finer ones, with
    their own least and greatest, until the bin has ``FEW`` values or one.  Two passes do for some ten
    billion evenly spread values a group.  No group's values are held together; nulls and NaN take no part.
    """
    kept = stored(rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("_v")), "values")
    place = F.element_at(F.array(*[F.lit(float(f)) for f in fractions]), F.col("_q") + 1) * (F.col("_n") - 1)
    groups = kept.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    asked = groups.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(len(fractions) - 1)))).withColumn("_at", place)
    asked = stored(asked.withColumn("_r", F.floor("_at")), "asked")
    ranks = asked.select(*by, "_r", "_n", "_lo", "_hi").unionByName(asked.select(*by, F.ceil("_at").alias("_r"), "_n", "_lo", "_hi")).distinct()
    state = stored(ranks.withColumn("_before", F.lit(0).cast("long")), "ranks")
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    while state.where(f"_lo < _hi AND _n > {FEW}").limit(1).count():
        share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)).otherwise(F.lit(0.0))
        binned = kept.join(state.drop("_n"), by).where(inside).withColumn("_bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        counts = binned.groupBy(*by, "_r", "_before", "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*by, "_r").orderBy("_bin")) + F.col("_before")
        found = counts.withColumn("_upto", upto).where("_r < _upto AND _r >= _upto - _n")
        state = stored(found.select(*by, "_r", "_n", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_before")), "ranks")
    one = state.where("_lo = _hi").select(*by, "_r", F.col("_lo").alias("_x"))
    few = kept.join(state.where("_lo < _hi"), by).where(inside)
    order = F.row_number().over(Window.partitionBy(*by, "_r").orderBy("_v")) - 1 + F.col("_before")
    ranked = one.unionByName(few.withColumn("_k", order).where("_k = _r").select(*by, "_r", F.col("_v").alias("_x")))
    ends = asked.select(*by, "_q", "_at", "_r", F.ceil("_at").alias("_s"))
    low = ends.join(ranked.withColumnRenamed("_x", "_a"), [*by, "_r"])
    both = low.join(ranked.select(*by, F.col("_r").alias("_s"), F.col("_x").alias("_b")), [*by, "_s"])
    mixed = both.withColumn("_x", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_r")))
    return mixed.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == k, F.col("_x"))).alias(n) for k, n in enumerate(names)])
