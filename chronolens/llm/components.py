"""Connected components of an edge table, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store


def component_map(edges: DataFrame) -> DataFrame:
    """c, root for every end of edges (a, b): root is the smallest member of its component.

    Each round every vertex hooks to its smallest neighbour if that is smaller, hooks are followed to their end, and
    edges are rewritten between the ends, so vertices with edges at least halve. Partial minima bound what a
    well-connected vertex costs.
    """
    edges = store(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hooks: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        while True:  # hooks lead to smaller vertices; follow them to the end, twice as far each time
            onward = hook.select(F.col("a").alias("x"), F.col("m").alias("n"))
            longer = store(hook.join(onward, F.col("m") == F.col("x")).select("a", F.col("n").alias("m"), (F.col("n") < F.col("m")).alias("moved")))
            moved = longer.filter("moved").limit(1).count()
            drop_stored(hook)
            hook = longer.drop("moved")
            if not moved:
                break
        hooks.append(hook)
        low, high = hook.select(F.col("a").alias("x"), F.col("m").alias("ma")), hook.select(F.col("a").alias("y"), F.col("m").alias("mb"))
        ends = edges.join(low, F.col("a") == F.col("x")).join(high, F.col("b") == F.col("y")).select(F.col("ma").alias("a"), F.col("mb").alias("b"))
        ends = ends.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        old, edges = edges, store(ends)
        drop_stored(old)
    if not hooks:
        return edges.select(F.col("a").alias("c"), F.col("b").alias("root"))
    roots = hooks[-1].select(F.col("a").alias("c"), F.col("m").alias("root"))
    for hook in reversed(hooks[:-1]):
        later = roots.select(F.col("c").alias("m"), F.col("root").alias("r"))
        roots = hook.join(later, "m", "left").select(F.col("a").alias("c"), F.coalesce("r", "m").alias("root"))
    return roots
