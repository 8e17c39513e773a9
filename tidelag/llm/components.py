"""Connected components of a table of links, by stars that shrink toward the smallest member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage, unstage


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of u on the smallest of u and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    hung = both.join(least.hint("shuffle_merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _only(stage(hung.distinct()), least)


def _small_star(links: DataFrame) -> DataFrame:
    """Hang u and its smaller neighbours on the smallest of these; links have u > v."""
    least = stage(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(least.hint("shuffle_merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _only(stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()), least)


def _only(result: DataFrame, *used: DataFrame) -> DataFrame:
    """``result``, written; the tables that led to it go."""
    unstage(*used)
    return result


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest member) for every node of ``links`` (a, b) that is not its root.

    Each round is two joins over tables no larger than the links; a node with many links is
    reduced by partial minima, and its rows are split by the skew join. Rounds end when no
    link moves, after a number of rounds that grows with the logarithm of the size. Only the
    last round's table stays."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    links = stage(links.where("a <> b").select(u, v).distinct())
    before = None
    while True:
        digest = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if digest == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = digest
        large = _only(_large_star(links), links)
        links = _only(_small_star(large), large)
