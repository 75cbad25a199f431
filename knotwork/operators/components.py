"""Weakly connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.lineage import cut, release

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v).

    Large-star links every neighbour above ``u`` to the least of ``u`` and its neighbours; small-star links every
    neighbour below ``u``, and ``u`` itself, to the least of them. A minimum is spread by join, not by collecting a
    neighbourhood, so that a node with very many neighbours never sits in one row.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u LONG, v LONG); component is the least node of it.

    Nodes with self-loops only are their own component. Rows with a null end are ignored. Each round ends in a table in
    the shared folder; rounds stop when one of them changes nothing.
    """
    edges = edges.select("u", "v").where("u is not null and v is not null")
    start = cut(edges, "components")
    state = cut(start.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(state)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        after = cut(_star(_star(state, True), False), "stars")
        now = mark(after)
        release(state)
        state = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the stars did not settle")
    nodes = start.select(F.col("u").alias("node")).union(start.select(F.col("v").alias("node"))).distinct()
    return nodes.join(state.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
