"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for every node of ``links`` (columns a and b).

    Each round lets every node point to its smallest neighbour or itself, follows the pointers to their
    ends by doubling, and contracts the links to the ends, of which there are at most half as
    many as nodes. So the rounds grow with the logarithm of the nodes, and neither links nor
    nodes come to the driver. Null ends and loops are ignored.
    """
    left = materialise(links.select("a", "b").where("a <> b").distinct(), "links")
    found = None
    while True:
        ends = left.union(left.select("b", "a")).toDF("node", "other").groupBy("node").agg(F.min("other").alias("low"))
        up = materialise(ends.select("node", F.least("node", "low").alias("root")), "up")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            up = materialise(up.join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "up")
            moved = not up.where("moved").isEmpty()
            up = up.drop("moved")
            if not moved:
                break
        if found is None:
            found = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = materialise(found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        a, b = up.toDF("a", "x"), up.toDF("b", "y")
        left = materialise(left.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if left.isEmpty():
            return found


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that made ``roots`` and of new ``links``, of which only the roots of their ends are looked at."""
    a, b = roots.toDF("a", "x"), roots.toDF("b", "y")
    ends = links.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    step = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    moved = roots.join(step.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return materialise(moved.union(step.join(roots, "node", "left_anti").select("node", "root")), "roots")
