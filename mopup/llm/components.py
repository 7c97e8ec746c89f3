"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    if checkpoint_dir(df.sparkSession) is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return df.checkpoint(eager=True)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node points its larger neighbours to the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node points itself and its smaller neighbours to the smallest of these.  Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of an edge (a, b), ``component`` being the smallest id that it is
    connected with.

    Ends when a round changes nothing, after a number of rounds in the order of the logarithm of the
    node count.  Each round is two aggregations with map-side combination and two joins on a node; a
    hot node's neighbours are split by adaptive skew joins.  Edges live in the shared checkpoint
    folder between rounds and never reach the driver."""
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .filter("a <> b").distinct())
    shape = None
    while True:
        now = saved(_small_star(_large_star(now).distinct()).distinct())
        figure = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (figure["n"], figure["s"]) == shape:
            break
        shape = (figure["n"], figure["s"])
    nodes = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("id"), "component").distinct())
