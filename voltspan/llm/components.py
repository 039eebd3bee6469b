"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.llm.common import discard, fresh, join_spread, written


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Links each node's larger neighbours to the smallest of its neighbours and itself. n: the number of edges."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return join_spread(both, least, "a", 2 * n).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of these; edges go from larger to smaller, at most 2 * n of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    near = join_spread(edges, least, "a", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node that has a link to another: the smallest node that it reaches. Links need no order; nulls, loops and repeats are left out.

    Each round is a few joins on the nodes and ends in a written table: small ones are read in few tasks, however many partitions wrote them. The number of
    rounds grows with the logarithm of the graph's diameter.
    """
    spark = links.sparkSession
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges, last = written(edges, at=(at := fresh(spark))), None
    n = edges.count()
    while True:
        large = written(_large(edges, n), at=(between := fresh(spark)))  # _small reads its edges several times
        edges = written(_small(large, n), at=(after := fresh(spark)))
        for old in (at, between):
            discard(spark, old)
        at = after
        now = n, _ = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            # every edge goes from a node to its root by now
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = now
