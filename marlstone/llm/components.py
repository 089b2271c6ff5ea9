"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Every step is a grouped minimum and a join on the same key, so nothing gathers a component in
one place; the rounds end when no edge changes. Lineage is cut after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut_lineage

#: Edges in a file between rounds; small graphs then don't cost a file for each shuffle partition in every round.
EDGES_A_FILE = 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's greater (or not greater) neighbours to the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    around = both if large else both.where("b <= a")
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    side = around.where("b > a") if large else around
    linked = side.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        linked = linked.union(least.select("a", F.col("m").alias("b")))
    return linked.where("a != b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node of its component.

    The first round's edges go into no more than `files` files, if that is given.
    """
    now = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), files)
    mark = _mark(now)
    while mark[0]:
        now = cut_lineage(_star(_star(now, True), False), -(-mark[0] // EDGES_A_FILE))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
