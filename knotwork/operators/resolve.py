"""Imports resolved to first-party modules by joins with the module index.

Every probe of the index is an equi-join on a module name, so Spark broadcasts the index where it is small and shuffles
where it isn't. A statement's names stay together through one window on (file, statement).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.functions import paths
from knotwork.functions.imports import ALL

STATEMENT = ("rel_path", "source_module", "stmt_ord")


def module_index(files: DataFrame) -> DataFrame:
    """(module): distinct names of first-party modules."""
    return files.where("module <> ''").select("module").distinct()


def probe(rows: DataFrame, column: str, index: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` joined with the index on ``column``; with 'left', ``hit`` tells which rows are in it."""
    names = index.select(F.col("module").alias(column))
    if how == "left":
        return rows.join(names.withColumn("hit", F.lit(True)), column, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return rows.join(names, column, how)


def resolve_import(raw: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """import X, Y: each name as it stands, or unresolved."""
    names = raw.where("kind = 'import'").select("source_module", "line", F.explode("names.name").alias("target"))
    met = probe(names, "target", index)
    return met.where("hit").select(F.col("source_module").alias("source"), "target", "line"), met.where("not hit").select(
        F.col("source_module").alias("source"), F.col("target").alias("import_path")
    )


def resolve_from(raw: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """from X import y: submodules where there are any, else X itself, else one unresolved X for the statement."""
    rows = raw.where("kind = 'from' and (level > 0 or module is not null)")
    climbed = paths.relative_target("source_module", paths.effective_level("level", "is_package"), "module")
    rows = rows.withColumn("base", F.when(F.col("level") > 0, climbed).otherwise(F.col("module")))
    escaped = rows.where("base is null").select(
        F.col("source_module").alias("source"), F.concat(F.expr("repeat('.', level)"), F.coalesce("module", F.lit(""))).alias("import_path")
    )
    rows = rows.where("base is not null")
    wanted = F.filter("names.name", lambda n: n != "*")
    each = rows.select(*STATEMENT, "line", "base", F.explode_outer(wanted).alias("name"))
    full = F.when(F.col("base") == "", F.col("name")).otherwise(F.concat("base", F.lit("."), "name"))
    met = probe(each.withColumn("target", full), "target", index)
    statement = W.partitionBy(*STATEMENT)
    met = met.withColumn("any_hit", F.bool_or("hit").over(statement)).withColumn("nth", F.row_number().over(statement.orderBy("name")))
    subs = met.where("hit").select(F.col("source_module").alias("source"), "target", "line")
    rest = probe(met.where("not any_hit and nth = 1").select("source_module", "line", F.col("base").alias("target")), "target", index)
    bases = rest.where("hit").select(F.col("source_module").alias("source"), "target", "line")
    missed = rest.where("not hit").select(F.col("source_module").alias("source"), F.col("target").alias("import_path"))
    return subs.unionByName(bases), missed.unionByName(escaped)


def resolve_strings(raw: DataFrame, index: DataFrame, mode: str, min_dots: int) -> DataFrame:
    """Strings shaped like modules: exactly, or by their longest prefix in the index; misses and self-edges are dropped."""
    each = raw.where("kind = 'string'").select("source_module", "rel_path", "stmt_ord", "line", F.posexplode("names.name").alias("nth", "candidate"))
    if mode == ALL:
        each = each.withColumn("target", F.explode(paths.shortened("candidate", min_dots)))
    else:
        each = each.withColumn("target", F.col("candidate"))
    met = probe(each, "target", index, "inner")
    if mode == ALL:
        met = met.groupBy(*STATEMENT, "nth", "line").agg(F.max_by("target", F.length("target")).alias("target"))
    return met.where("target <> source_module").select(F.col("source_module").alias("source"), "target", "line")


def ancestor_edges(direct: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages that an import of a.b.c runs on its way: (edges to them, those suppressed as the source's own ancestors)."""
    prefixes = direct.select("source", "line", F.explode(paths.ancestors("target")).alias("target")).distinct()
    met = probe(prefixes, "target", index, "left_semi")
    own = paths.is_ancestor_or_self("target", "source")
    return met.where(~own).select("source", "target", "line"), met.where(own & (F.col("target") != F.col("source"))).select(
        "source", F.col("target").alias("ancestor_package"), "line"
    )


def resolve(raw: DataFrame, index: DataFrame, mode: str = "call-sites", min_dots: int = 2, ancestor_init: bool = True) -> dict[str, DataFrame]:
    """deps (source, target, line, derived), unresolved (source, import_path), suppressed (source, ancestor_package, line).

    derived: an edge that only exists as an ancestor's. The rows with derived = false are what resolving without
    ancestor edges gives, so one pass serves both graphs.
    """
    plain, missed = resolve_import(raw, index)
    froms, more_missed = resolve_from(raw, index)
    direct = plain.unionByName(froms).unionByName(resolve_strings(raw, index, mode, min_dots))
    every = direct.withColumn("derived", F.lit(False))
    suppressed = direct.limit(0).select("source", F.col("target").alias("ancestor_package"), "line")
    if ancestor_init:
        derived, suppressed = ancestor_edges(direct, index)
        every = every.unionByName(derived.withColumn("derived", F.lit(True)))
    deps = every.groupBy("source", "target", "line").agg(F.min("derived").alias("derived"))
    return {"deps": deps, "unresolved": missed.unionByName(more_missed).distinct(), "suppressed": suppressed.distinct()}
