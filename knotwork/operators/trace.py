"""Which cycles affect a file or a directory, and by which way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions import paths
from knotwork.operators.cycles import members_of
from knotwork.operators.reach import best_ways

HOPS = "array<struct<from:string,to:string,lines:array<int>>>"


def match(nodes: DataFrame, raw: str) -> tuple[str, DataFrame] | None:
    """('file' or 'directory', nodes (path)) that a user's path names; a trailing slash asks for a directory."""
    wanted = paths.normalize_path(raw)
    if not raw.rstrip().endswith("/"):
        exact = nodes.where(F.col("path") == wanted)
        if exact.limit(1).count():
            return "file", exact.select("path")
    inside = nodes.where(F.startswith("path", F.lit(wanted + "/"))).select("path")
    return ("directory", inside) if inside.limit(1).count() else None


def match_or_hint(nodes: DataFrame, raw: str, roots: list[str]) -> tuple[tuple[str, DataFrame] | None, str | None]:
    """The match, or else the path below a source root that would have matched: a hint, never a match."""
    found = match(nodes, raw)
    if found:
        return found, None
    slash = "/" if raw.rstrip().endswith("/") else ""
    for root in roots:
        candidate = f"{root.rstrip('/')}/{paths.normalize_path(raw)}"
        if match(nodes, candidate + slash):
            return None, candidate
    return None, None


def impacts(edges: DataFrame, kept: DataFrame, starts: DataFrame, task_edges: int | None = None, hops: bool = True) -> DataFrame:
    """(node, scc_id, cycle_index, relationship, entry, from_lines, path) of each start (path) and kept cycle that affects it.

    ``edges`` have lines; ``kept`` are numbered cycles. member: the start is in the cycle, which is its own entry; else
    reachable: by the hops of the best way. Order the rows of a node by the path order of scc_id. hops: else from_lines and
    path may be empty, for those who count.
    """
    cyclic = members_of(kept, "cycle_index")
    member = cyclic.join(starts.select(F.col("path").alias("node")).distinct(), "node", "left_semi").select(
        "node", "scc_id", "cycle_index", F.lit("member").alias("relationship"), F.col("node").alias("entry"),
        F.array().cast("array<int>").alias("from_lines"), F.array().cast(HOPS).alias("path"),
    )
    extra = {} if task_edges is None else {"task_edges": task_edges}
    ways = best_ways(edges, cyclic, starts, shown="lines" if hops else "none", **extra)
    empty = F.array().cast("array<int>")
    hop = F.transform(
        F.sequence(F.lit(1), F.size("lines")),
        lambda i: F.struct(F.get("path", i - 1).alias("from"), F.get("path", i).alias("to"), F.coalesce(F.get("lines", i - 1), empty).alias("lines")),
    )
    reached = ways.select(
        F.col("start").alias("node"), "scc_id", "cycle_index", F.lit("reachable").alias("relationship"), "entry",
        (F.get("lines", F.lit(0)) if hops else empty).alias("from_lines"), (hop if hops else F.array().cast(HOPS)).alias("path"),
    )
    return member.unionByName(reached)


def trace_stats(found: DataFrame) -> DataFrame:
    """(members, reachable_only, cycles): files that are in a cycle, that only lead to one, and cycles concerned."""
    each = found.groupBy("node").agg(F.bool_or(F.col("relationship") == "member").alias("member"))
    counts = each.agg(F.count_if("member").alias("members"), F.count_if(~F.col("member")).alias("reachable_only"))
    return counts.crossJoin(found.agg(F.countDistinct("cycle_index").alias("cycles")))


def trace_distribution(found: DataFrame) -> DataFrame:
    """(cycle_index, members, reachable) files by cycle."""
    return found.groupBy("cycle_index").agg(
        F.count_if(F.col("relationship") == "member").alias("members"), F.count_if(F.col("relationship") == "reachable").alias("reachable")
    )
