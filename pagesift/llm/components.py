"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so a node with very many links is combined
before the shuffle and its join can be split; nothing is gathered per node. The number of
rounds grows with the logarithm of the longest chain. Each round is written to the shared
folder, so a lost executor costs at most that round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> node, root: the smallest node reachable, for every node that has a link to another."""
    edges = written(links.where("u <> v").select("u", "v").distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        stars = _small_star(_large_star(edges)).where("u <> v").distinct()
        edges = written(stars, "stars")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
