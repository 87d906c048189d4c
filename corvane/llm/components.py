"""Connected components by alternating stars (Kiveris et al., 2014), as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    near = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of an edge other than that smallest one.

    Edges may be repeated, run either way and join a node to itself; those with a null end are no edges. The edges are
    never collected: each round is written to the shared folder. A round takes a number of steps that grows with the
    logarithm of the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    e = written(e.where("x is not null and y is not null and a <> b").select("a", "b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state.n or state == before:
            break
        before = state
        e = written(_small_star(_large_star(e)), "stars")
    else:
        raise RuntimeError("the components didn't settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
