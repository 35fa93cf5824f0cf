"""Connected components of an edge table, by contraction.

In each round every node joins the neighbour (or itself) that is smallest in the
order of the round, and the graph is contracted. Even rounds go by id, which
ends stars around their smallest id at once; odd rounds go by an order drawn anew
and remove a constant share of the nodes in expectation, paths included, so
logarithmically many rounds do. Minima combine in the map tasks, so a hub sends
one row per task. Every round is a written table: a lost executor repeats one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.session import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): for each id of ``edges`` (columns a, b; longs) one id
    of its component. Loops and repeated edges are allowed; no edges give no rows."""
    edges, left, _ = scratch.write_counted(edges.where("a <> b").select("a", "b").distinct(), "edges")
    steps: list[DataFrame] = []
    while left:
        turn = len(steps)
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct((F.xxhash64(c, F.lit(turn)) if turn % 2 else F.col(c)).alias("o"), F.col(c).alias("id"))
        step = both.groupBy("a").agg(F.least(F.min(order("b")), order("a"))["id"].alias("m"))
        step = scratch.write(step, "step")
        steps.append(step)
        moved = (
            edges.join(step, "a").select(F.col("m").alias("x"), "b")
            .join(step.withColumnRenamed("m", "y"), F.col("b") == F.col("a")).select("x", "y")
        )
        pairs = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges, left, _ = scratch.write_counted(pairs, "edges")
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    top = steps[-1].select(F.col("a").alias("id"), F.col("m").alias("component"))
    for step in reversed(steps[:-1]):
        joined = step.join(top, F.col("m") == F.col("id"), "left")
        top = scratch.write(joined.select(F.col("a").alias("id"), F.coalesce("component", "m").alias("component")), "step")
    return top
