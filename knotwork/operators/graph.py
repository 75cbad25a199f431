"""The file graph: nodes, edges with their import lines, collisions, suppressed edges put back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.functions import paths
from knotwork.operators.lineage import cut
from knotwork.operators.pieces import place
from knotwork.operators.scc import strong_members


def module_winners(files: DataFrame, placed: bool = False) -> DataFrame:
    """(module, path): the file that stands for a module, the last in discovery order of those that define it.

    placed: also ``place``, which tells edges where they are searched first.
    """
    last = W.partitionBy("module").orderBy(F.desc("root_ord"), F.desc("file_ord"))
    rows = files.where("module <> ''").withColumn("nth", F.row_number().over(last)).where("nth = 1")
    more = [place("root_ord", "file_ord").alias("place")] if placed else []
    return rows.select("module", F.col("rel_path").alias("path"), *more)


def module_collisions(files: DataFrame) -> DataFrame:
    """(module, paths): modules that two files or more define, with their paths in order."""
    found = files.where("module <> ''").groupBy("module").agg(F.array_sort(F.collect_set("path_key")).alias("keys")).where("size(keys) > 1")
    return found.select("module", F.transform("keys", lambda k: F.array_join(k, "/")).alias("paths"))


def nodes_of(files: DataFrame) -> DataFrame:
    """(path): every discovered file, with or without imports; a file of two roots is one node."""
    return files.select(F.col("rel_path").alias("path")).distinct()


def file_edges(deps: DataFrame, winners: DataFrame) -> DataFrame:
    """(src, dst, lines): edges between files, each once, with the sorted lines that make it. Unmapped ends drop out.

    Winners with a ``place`` give one to edges, that of their source.
    """
    more = [c for c in ("place",) if c in winners.columns]
    a = winners.select(F.col("module").alias("source"), F.col("path").alias("src"), *more)
    b = winners.select(F.col("module").alias("target"), F.col("path").alias("dst"))
    met = deps.join(a, "source").join(b, "target")
    return met.groupBy("src", "dst").agg(F.sort_array(F.collect_set("line")).alias("lines"), *(F.min(c).alias(c) for c in more))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among ``members`` (path)."""
    kept = edges.join(members.select(F.col("path").alias("src")), "src", "left_semi")
    return kept.join(members.select(F.col("path").alias("dst")), "dst", "left_semi").select(*edges.columns)


def intern(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, path_key, id): ids from 0 in path order; ends of edges that are no nodes are nodes too.

    The order is global: rows are sorted in ranges, numbered in each, and shifted by what the ranges before hold, so that
    no task sorts the whole. The ranges are a written table, as another run of the sort might cut them elsewhere.
    """
    every = nodes.select("path").union(edges.select("src")).union(edges.select("dst")).distinct()
    sorted_ = every.withColumn("path_key", paths.path_key("path")).repartitionByRange("path_key").sortWithinPartitions("path_key")
    placed = cut(sorted_.withColumn("at", F.monotonically_increasing_id()), "ranges")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = placed.withColumn("part", part).join(base, "part")
    return numbered.select("path", "path_key", (F.col("base") + within).cast("long").alias("id"))


def restore_suppressed(nodes: DataFrame, edges: DataFrame, winners: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Edges, and those suppressed edges to own ancestors that lie in a cycle once all of them are there."""
    more = [c for c in ("place",) if c in winners.columns and c in edges.columns]
    a = winners.select(F.col("module").alias("source"), F.col("path").alias("src"), *more)
    b = winners.select(F.col("module").alias("ancestor_package"), F.col("path").alias("dst"))
    wanted = cut(suppressed.join(a, "source").join(b, "ancestor_package").where("src <> dst").select("src", "dst", "line", *more), "wanted")
    whole = edges.select("src", "dst", *more).union(wanted.select("src", "dst", *more))
    scc = strong_members(whole)
    met = wanted.join(scc.select(F.col("node").alias("src"), F.col("scc_id").alias("a")), "src").join(
        scc.select(F.col("node").alias("dst"), F.col("scc_id").alias("b")), "dst"
    )
    back = met.where("a = b").select("src", "dst", "line", *more)
    lines = edges.select("src", "dst", F.explode_outer("lines").alias("line"), *more).unionByName(back)
    return lines.groupBy("src", "dst").agg(F.sort_array(F.collect_set("line")).alias("lines"), *(F.min(c).alias(c) for c in more))
