"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import written


def _swap(links: DataFrame) -> DataFrame:
    return links.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of itself and its neighbours."""
    both = links.unionByName(_swap(links))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of those."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    inner = down.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return inner.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) pairs of orderable nodes -> (node, root): the least node that each node can reach.

    Only nodes that have a link to another node appear. A round is two aggregations and two joins over at most as
    many links as there are, and is written; a node with very many links is aggregated before it is joined. The
    number of rounds grows with the logarithm of the longest chain.
    """
    links = written(links.filter("a <> b").distinct(), "links")
    sign = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if tuple(state) == sign:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = tuple(state)
        links = written(_small_star(_large_star(links)), "links")
