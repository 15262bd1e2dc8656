"""Connected components by alternating large-star and small-star.

Both steps group edges by a node, take the smallest neighbour and hang others below it.  The
smallest neighbour is a pre-aggregated minimum that is joined back, so no neighbourhood is
ever collected, and a node with a third of all edges is a skewed join that Spark splits.
Every round is written to the shared folder; the rounds end when all edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratalog.llm.common import written


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung below the smallest of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung below the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"),
                                                         F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every node hangs below one other that hangs below none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("below")).unionAll(
        edges.select("v", F.lit(0)))
    loose = ends.groupBy("n").agg(F.sum("below").alias("above"), F.min("below").alias("center"))
    return loose.filter("above > 1 OR above = 1 AND center = 0").agg(F.count(F.lit(1))).first()[0] == 0


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component (its smallest node) of all nodes of edges u, v but the smallest ones.

    Loops and repeated edges are ignored; no edges give no rows.
    """
    state = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .filter("u <> v").distinct(), "edges", True)
    for _ in range(rounds):
        if settled(state):
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = written(small_star(large_star(state)), "edges", True)
    raise RuntimeError("the components did not settle")
