"""Connected components of a graph given as an edge table, by alternating star steps.

Large star: every node hands its larger neighbours to its smallest one. Small star: every node hands itself
and its smaller neighbours to the smallest. Both keep components whole and end in stars around the smallest
node of each. A node's minimum is a pre-aggregated reduction. It comes back to the node's edges by an equality
join, but for hot nodes (``rows.HOT_KEYS`` at most), whose minima are broadcast: their edges stay where they
are, so no task gets the edges of a node that touches a third of them. Every star is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtable.llm.rows import joined_by_key
from logtable.session import shared_dir


def _written(frame: DataFrame) -> DataFrame:
    path = shared_dir(frame.sparkSession, "stars")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _mark(stars: DataFrame) -> tuple:
    """Row count and a checksum: equal if a step has changed nothing."""
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, whole: int) -> DataFrame:
    """``a, b, m``: the edges with the smallest of ``a`` and all its ``b``."""
    least = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    return joined_by_key(edges, least, ["a"], "n", whole)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a")))  # edges are distinct, larger node first
    return _with_least(both, 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    led = _with_least(down, n)
    # an edge to the smallest stays, one to another node is handed to the smallest
    handed = led.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
    return handed.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (bigint, a <> b, either way round, repeats allowed) -> ``node, root`` of every node but roots.

    No edges give no rows. ``root`` is the component's smallest node.
    """
    stars = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(stars)
    while True:
        n = mark[0]  # a large star keeps the number of edges
        # each star looks at its edges several times: it starts from a table, not from the plan of the one before
        stars = _written(_small_star(_written(_large_star(stars, n)), n))
        after = _mark(stars)
        if after == mark:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = after
