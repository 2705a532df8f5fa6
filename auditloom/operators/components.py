"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import materialise, release


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(node, component)`` for each node of an edge, the component being its least node.

    Alternating large-star and small-star rounds: a node links its larger neighbours, then its
    smaller ones, to the least node it knows. Components of any shape settle in a number of rounds
    that is logarithmic in practice. Each round's edges are written to the shared folder. A hub's
    neighbours are reduced to a minimum before the shuffle, never gathered. Loops and repeated edges
    are allowed, null ends are dropped; no edges give an empty result.
    """
    e = materialise(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    )
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = materialise(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least2, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        step = materialise(small)
        same = now.exceptAll(step).isEmpty() and step.exceptAll(now).isEmpty()
        release(now)
        now = step
        if same:
            break
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
