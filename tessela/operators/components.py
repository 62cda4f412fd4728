"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessela.session import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(arcs: DataFrame, larger: bool) -> DataFrame:
    """Links each node's larger (or its smaller) neighbours to the least of its neighbourhood."""
    least = arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = arcs.join(least, "a")
    if larger:
        hung = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hung.where("a != b").distinct()


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 50) -> DataFrame:
    """(node, component): each node of the edge list with the least node that it is linked to.

    Null ends and loops are no links; no edges give no rows.  Minima are pre-aggregated, so a node with very many
    neighbours is no bottleneck, and lineage is cut each round in the folder that all executors share.
    """
    now = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (state.n, state.h):
            break
        before = (state.n, state.h)
        large = _star(_both(now), larger=True)
        now = cut_lineage(_star(large.where("b < a"), larger=False))
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select(F.col("b").alias("node")).distinct().join(now.select(F.col("a").alias("node")), "node", "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
