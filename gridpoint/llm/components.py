"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpoint.llm.common import frequent_from, with_facts, written


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of edges (a, b: longs).

    A large star ties each node's larger neighbours to its least one, a small star its smaller ones; both keep the
    components, and they end in stars about the least node. Every neighbourhood is reduced by min() before it is
    shuffled, and the least neighbours of nodes of very many are broadcast, so nodes of any degree are no load. A step's
    edges are written, and the steps end when none changes.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def star(found: DataFrame, large: bool) -> DataFrame:
        """found: a > b. For a large star neighbours are seen from both ends, for a small one from the larger."""
        around = found.select(F.col("a").alias("x"), F.col("b").alias("y"))
        if large:
            around = around.union(found.select(F.col("b").alias("x"), F.col("a").alias("y")))
        least = around.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("x", "m"))
        some = 4 * count > frequent_from(4 * count)  # else no node has many neighbours
        tied = with_facts(around, written(least, "least") if some else least, ["x"], "n", 4 * count)
        if large:
            return tied.where("y > x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct()
        out = tied.where("y <> m").select(F.col("y").alias("a"), F.col("m").alias("b")).union(least.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")))
        return out.distinct()

    facts = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = None
    while (now := tuple(facts(edges))) != last:
        last, count = now, now[0]
        large = star(edges, True)
        edges = written(star(written(large, "edges") if 4 * count > frequent_from(4 * count) else large, False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
