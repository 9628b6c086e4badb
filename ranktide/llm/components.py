"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

A round links every node's larger neighbours, then its smaller ones and itself,
to the least node seen from it; components shrink to stars around their least
node in a number of rounds that grows with the logarithm of their size. A star is
one exchange: a node's neighbours are sorted, the first is the least, and repeated
ones drop out beside it (a node of very many neighbours is one sort, which spills).
Each round is written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranktide.llm.common import staged


def _sorted_neighbours(e: DataFrame) -> DataFrame:
    """The distinct edges (u, v) with the least neighbour of u."""
    near = Window.partitionBy("u").orderBy("v")
    seen = e.select("u", "v", F.first("v").over(near).alias("least"), F.lag("v").over(near).alias("before"))
    return seen.where("before IS NULL OR before <> v").drop("before")


def _large_star(e: DataFrame) -> DataFrame:
    both = _sorted_neighbours(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return both.where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Edges lead from a node to smaller ones, here and in the result."""
    seen = _sorted_neighbours(e)
    to = F.when(F.col("v") > F.col("least"), F.col("v")).otherwise(F.col("u"))
    return seen.select(to.alias("u"), F.col("least").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of ``edges`` (u, v: of one orderable type)."""
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "components")
    seen = None
    while True:
        e = staged(_small_star(_large_star(e)), "components")
        # Stars are a fixed point, and any round but the last changes the edges; each edge is there once.
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or not now["n"]:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct().unionByName(roots)
