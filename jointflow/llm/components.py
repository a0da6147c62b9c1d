"""Connected components of a table of links, by stars that are drawn together until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointflow.session import written


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour (or itself)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over ``links`` (a, b), for every node with a link to another.

    Alternating large and small stars take a logarithmic number of rounds; each round's links are written to the
    shared folder, and only their count and sum come to the driver. No node's links meet in one task but as
    partial minima; the joins behind them are dealt anew when a node has very many.
    """
    current = written(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == before:
            break
        before = tuple(now)
        starred = _large_star(current).where("a <> b").distinct()
        starred = _small_star(starred).where("a <> b").distinct()
        current = written(starred, "links")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
