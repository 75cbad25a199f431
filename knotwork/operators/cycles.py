"""Cycles: from components, through the filters in their fixed order, to numbered report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.functions import paths
from knotwork.operators.lineage import cut
from knotwork.operators.scc import TASK_EDGES, members_within


def cycles_of(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc_id, members, size): components of two files or more, or of one that imports itself; members in path order.

    ``scc`` (node, scc_id) may leave out nodes that are alone.
    """
    # a component is named by its first member, so that those alone need not be grouped
    more = scc.where("node <> scc_id")
    keys = F.concat(F.array(paths.path_key("scc_id")), F.array_sort(F.collect_list(paths.path_key("node"))))
    found = more.groupBy("scc_id").agg(keys.alias("keys")).select("scc_id", F.transform("keys", lambda k: F.array_join(k, "/")).alias("members"), F.size("keys").alias("size"))
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    alone = loops.join(more.select("node").union(more.select("scc_id")), "node", "left_anti")
    return found.union(alone.select(F.col("node").alias("scc_id"), F.array("node").alias("members"), F.lit(1).alias("size")))


def by_size(cycles: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    kept = cycles.where(F.col("size") >= least)
    return kept if most is None else kept.where(F.col("size") <= most)


def dir_ignored(cycles: DataFrame, dirs: list[str]) -> DataFrame:
    """Adds ``ignored``: whether all files of a cycle lie below the directories, taken together."""
    usable = paths.normalize_dirs(dirs)
    if not usable:
        return cycles.withColumn("ignored", F.lit(False))

    def inside(member):
        any_of = F.lit(False)
        for d in usable:
            any_of = any_of | paths.under(member, F.lit(d))
        return any_of

    return cycles.withColumn("ignored", F.forall("members", inside))


def ignore_frame(spark: SparkSession, entries: list[list[str]]) -> DataFrame:
    """(entry, members) of an ignore list: members in path order, with their repetitions."""
    rows = [(i, paths.sort_paths("/".join(x for x in f.split("/") if x not in ("", ".")) or f for f in files)) for i, files in enumerate(entries)]
    return spark.createDataFrame(rows, "entry int, members array<string>")


def list_ignored(cycles: DataFrame, ignore: DataFrame) -> DataFrame:
    """Adds ``suppressed``: whether the ignore list has exactly this set of files."""
    wanted = ignore.select("members").distinct().withColumn("suppressed", F.lit(True))
    return cycles.join(wanted, "members", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def unmatched_ignores(ignore: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Entries of the ignore list that suppressed no cycle."""
    return ignore.join(suppressed.select("members").distinct(), "members", "left_anti")


def within_package(cycles: DataFrame, roots: list[str]) -> DataFrame:
    """Cycles all of whose files have one and the same top-level package."""
    owners = F.transform("members", lambda m: paths.package_of(m, roots))
    first = F.get(owners, F.lit(0))
    return cycles.where(first.isNotNull() & F.forall(owners, lambda o: o.eqNullSafe(first)))


def ordered(cycles: DataFrame, roots: list[str]) -> DataFrame:
    """Adds packages and cycle_index, from 1: by first package (none last), size, then path of the first member.

    Rows are sorted in ranges, numbered in each, and shifted by what the ranges before hold: no task sorts the whole.
    """
    named = cycles.withColumn("packages", paths.packages_of("members", roots)).withColumn("first", F.get("packages", F.lit(0)))
    order = [F.asc_nulls_last("first"), F.asc("size"), paths.path_key("scc_id").asc()]
    sorted_ = named.repartitionByRange(*order).sortWithinPartitions(*order).drop("first")
    placed = cut(sorted_.withColumn("at", F.monotonically_increasing_id()), "ranges")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = placed.withColumn("part", part).join(F.broadcast(base), "part")
    return numbered.withColumn("cycle_index", (F.col("base") + within + 1).cast("int")).drop("part", "base", "at")


def package_runs(numbered: DataFrame) -> DataFrame:
    """Adds run and run_length: consecutive cycles with equal packages share a heading."""
    order = W.orderBy("cycle_index")
    new = F.when(F.lag("packages").over(order).eqNullSafe(F.col("packages")), 0).otherwise(1)
    runs = numbered.withColumn("new", new).withColumn("run", F.sum("new").over(order)).drop("new")
    return runs.withColumn("run_length", F.count("*").over(W.partitionBy("run")))


def members_of(cycles: DataFrame, *more: str) -> DataFrame:
    """(node, scc_id, ...) of all members."""
    return cycles.select(F.explode("members").alias("node"), "scc_id", *more)


def inner_edges(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc_id, src, dst, lines): edges inside a cycle, other than self-loops."""
    member = members_of(cycles)
    a = member.select(F.col("node").alias("src"), "scc_id")
    b = member.select(F.col("node").alias("dst"), F.col("scc_id").alias("other"))
    return edges.join(a, "src").join(b, "dst").where("scc_id = other and src <> dst").select("scc_id", "src", "dst", "lines")


def import_lines(inner: DataFrame) -> DataFrame:
    """(scc_id, path, import_lines): lines by which a file imports others of its cycle."""
    each = inner.select("scc_id", F.col("src").alias("path"), F.explode("lines").alias("line"))
    return each.groupBy("scc_id", "path").agg(F.sort_array(F.collect_set("line")).alias("import_lines"))


def report_files(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc_id, path, import_lines, edges): each member with what it imports inside its cycle, in path order."""
    inner = inner_edges(cycles, edges)
    lines = import_lines(inner)
    to = inner.groupBy("scc_id", F.col("src").alias("path")).agg(
        F.array_sort(F.collect_list(F.struct(paths.path_key("dst").alias("key"), "lines"))).alias("edges")
    )
    to = to.withColumn("edges", F.transform("edges", lambda e: F.struct(F.array_join(e["key"], "/").alias("to"), e["lines"].alias("lines"))))
    empty = F.array().cast("array<struct<to:string,lines:array<int>>>")
    met = members_of(cycles).withColumnRenamed("node", "path").join(lines, ["scc_id", "path"], "left").join(to, ["scc_id", "path"], "left")
    return met.select("scc_id", "path", F.coalesce("import_lines", F.array().cast("array<int>")).alias("import_lines"), F.coalesce("edges", empty).alias("edges"))


def cyclic_files(cycles: DataFrame) -> DataFrame:
    """(path): files in any of the cycles."""
    return members_of(cycles).select(F.col("node").alias("path")).distinct()


def cyclic_files_direct(cycles: DataFrame, direct_edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(path): of each cycle the files still in a cycle of direct imports alone, or all where none is."""
    member = members_of(cycles)
    a = member.select(F.col("node").alias("src"), "scc_id")
    b = member.select(F.col("node").alias("dst"), F.col("scc_id").alias("other"))
    inner = direct_edges.select("src", "dst").join(a, "src").join(b, "dst").where("scc_id = other").select("src", "dst", "scc_id")
    inner = cut(inner, "direct")
    closed = members_within(inner.where("src <> dst").select("src", "dst", F.xxhash64("scc_id").alias("component")), task_edges).select(F.col("node").alias("path"))
    still = cut(closed.union(inner.where("src = dst").select(F.col("src").alias("path"))).distinct(), "still")
    some = inner.join(still, inner["src"] == still["path"], "left_semi").select("scc_id").distinct()
    return still.union(cyclic_files(cycles.join(some, "scc_id", "left_anti"))).distinct()


def baseline_diff(known: DataFrame, computed: DataFrame) -> DataFrame:
    """(sign, path): '+' for files that are new, '-' for those that are gone."""
    known, computed = known.select("path").distinct(), computed.select("path").distinct()
    return computed.join(known, "path", "left_anti").select(F.lit("+").alias("sign"), "path").union(
        known.join(computed, "path", "left_anti").select(F.lit("-").alias("sign"), "path")
    )


def package_frequency(numbered: DataFrame) -> DataFrame:
    """(package, cycles): in how many cycles a package is; those of none count as (root-level)."""
    shown = F.when(F.size("packages") == 0, F.array(F.lit("(root-level)"))).otherwise(F.col("packages"))
    return numbered.select(F.explode(shown).alias("package")).groupBy("package").agg(F.count("*").alias("cycles"))


def size_distribution(cycles: DataFrame) -> DataFrame:
    return cycles.groupBy("size").agg(F.count("*").alias("cycles"))


def totals(cycles: DataFrame) -> DataFrame:
    """(cycles, files): how many there are."""
    return cycles.agg(F.count("*").alias("cycles")).crossJoin(cyclic_files(cycles).agg(F.count("*").alias("files")))
