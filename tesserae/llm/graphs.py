"""Connected components of an edge table, by shuffles alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, stored


def components(edges: DataFrame) -> DataFrame:
    """``v``, ``label`` for every node of ``edges`` (``a``, ``b`` bigint): the least node reachable from it.

    Each round takes the least label among a node's neighbours and then the label of
    that label, so labels travel twice as far every round.  Rounds are stored, so a
    lost executor costs a round at most.  Self-loops and repeated edges do no harm.
    Neither a node of many edges nor a label of many nodes is one task's (``looked_up``).
    """
    pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    pairs = stored(pairs, "edges")
    labels = stored(pairs.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count("*").alias("degree")), "labels")
    while True:
        near = looked_up(pairs.toDF("a", "v"), labels.select("v", "label", "degree"), ["v"], "degree").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", "degree", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        step = stored(step, "labels")
        held = step.groupBy("label").agg(F.count("*").alias("_size"))
        roots = stored(held.join(step.select(F.col("v").alias("label"), F.col("label").alias("of_root")), "label"), "roots")
        labels = looked_up(step, roots, ["label"], "_size").select("v", F.col("of_root").alias("label"), "degree", (F.col("of_root") != F.col("was")).alias("moved"))
        labels = stored(labels, "labels")
        if labels.where("moved").limit(1).count() == 0:
            return labels.select("v", "label")
