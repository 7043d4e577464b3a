"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import freed, written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _star(arcs: DataFrame, smaller: bool) -> DataFrame:
    """Hang the neighbours of every node on the least of them and the node.

    ``arcs`` runs from node to neighbour; the least is found by a partial
    aggregate and joined back, so a node with very many neighbours is split
    over tasks like any skewed join key.
    """
    least = written(arcs.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    least = least.withColumn("m", F.least("u", "m"))
    hung = arcs.join(least, "u")
    if smaller:
        moved = hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.where("u != m").select("u", F.col("m").alias("v"))).distinct()
    return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the end points of ``edges`` (a, b): the root is the least node reachable."""
    with freed(edges.sparkSession):
        e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        e = written(e, "edges")
        mark = _mark(e)
        while mark[0]:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _star(both, smaller=False)
            e = written(_star(written(large, "edges"), smaller=True), "edges")
            now = _mark(e)
            if now == mark:
                break
            mark = now
        roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return written(roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), "components", outlives=True)
