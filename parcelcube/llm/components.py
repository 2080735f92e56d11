"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges; edges are written out between steps, and
only whether they are stars already goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcube.llm.common import release, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node among its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, label): every node that has a link to another, and the least id it can reach."""
    at = settle(edges.select("a", "b").where("a != b").distinct())
    while not _is_forest_of_stars(at):
        before, at = at, settle(_small_star(_large_star(at)))
        release(before)
    return at.select(F.col("a").alias("id"), F.col("b").alias("label")).union(at.select("b", F.col("b")).distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) after further links (a, b): components found already stand for all links that made them."""
    return connected_components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(links.select("a", "b")))


def _is_forest_of_stars(at: DataFrame) -> bool:
    """Every edge leads down to a node that has no edge down itself, and no node has two."""
    if not at.where("a <= b").isEmpty():
        return False
    if not at.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return at.join(at.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
