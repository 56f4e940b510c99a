"""Connected components of a table of links, by alternating large-star and small-star steps.

Links never leave the executors. Every round is two grouped minima, of which each task first folds its
own rows, and joins whose skewed partitions Spark may split; it is written to the shared folder, so a
lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Stash


def _minimum(edges: DataFrame) -> DataFrame:
    """(node, least): the smallest of a node and its neighbours."""
    return edges.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x")).select("x.*")


def components(links: DataFrame, stash: Stash, name: str = "links") -> DataFrame:
    """(node, root) of every node that occurs in ``links`` (a, b); root is the smallest id of its component.

    Self links are allowed; an empty table gives an empty one.
    """
    edges = stash.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        # large star: neighbours above a node move to the smallest around it
        wide = _both(edges)
        large = wide.join(_minimum(wide), "node").filter("other > node").select(F.col("other").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        down = large.select(F.col("a").alias("node"), F.col("b").alias("other"))
        least = down.groupBy("node").agg(F.min("other").alias("least"))
        small = (
            down.join(least, "node")
            .select(F.explode(F.array(F.struct(F.col("node").alias("a"), F.col("least").alias("b")), F.struct(F.col("other").alias("a"), F.col("least").alias("b")))).alias("x"))
            .select("x.*").filter("a <> b").distinct()
        )
        after = stash.keep(small, f"{name}-{turn}")
        stash.drop(f"{name}-{turn - 1}")
        # done when the links form stars: no node has two links down, and no root has one
        loose = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        chained = loose or after.select(F.col("b").alias("a")).distinct().join(after, "a", "left_semi").limit(1).count()
        edges = after
        if not loose and not chained:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
