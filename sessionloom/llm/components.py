"""Connected components by repeated label minimum and label shortcuts.

Every step is a join of two staged tables or a partial aggregate, so a vertex with
very many links never meets in one task: adaptive skew joins split it, and minima
are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import staged, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, component)`` with the smallest node reachable.

    Loops, repeated links and links with a null end are allowed; the latter join
    nothing.  A table without links gives an empty result.
    """
    clean = edges.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v")
    both = staged(clean.union(clean.select(F.col("v"), F.col("u"))).distinct(), "links")
    state = staged(
        both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels"
    )
    before = None
    while True:
        total = state.agg(F.sum(F.col("component").cast("decimal(38,0)")), F.count("*")).first()
        if total[0] == before or not total[1]:
            unstage(both)
            return state
        before = total[0]
        near = both.join(state.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "component")
        spread = staged(near.union(state).groupBy("node").agg(F.min("component").alias("component")), "labels")
        unstage(state)
        roots = spread.select(F.col("node").alias("component"), F.col("component").alias("root"))
        state = staged(spread.join(roots, "component").select("node", F.col("root").alias("component")), "labels")
        unstage(spread)
