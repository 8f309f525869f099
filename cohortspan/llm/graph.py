"""Connected components of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import durable

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest node of each star.

    A large star turns over the larger neighbours of a node, a small star the
    smaller ones. The smallest neighbour comes from a map-side aggregate and a
    join, so a hub's neighbours never meet in one task.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        lows = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lows.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; ``links`` has long columns u and v.

    Alternates large and small stars until every edge points at a root, which
    takes a number of rounds that grows with the logarithm of the path lengths.
    Each round is checkpointed. Roots are in the result; unlinked nodes are not.
    """
    edges = durable(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        # done when no root hangs on another node and no node on two roots
        bad = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").unionAll(
            edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        )
        if bad.isEmpty():
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
        edges = durable(_stars(_stars(edges, True), False))
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
