"""A dependency graph out of the order lines, all of them: consecutive lines of an order are imports.

Twelve order keys make a block, whose files are numbered by parts modulo 40: cycles arise inside blocks. The last line
of an order imports the first one of the next, if that is in another block of the same group of four: ways lead from block
to block and never back. A file's number is its block times 64, plus its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, GROUP, FILES, ROOM = 12, 48, 40, 64


def _block() -> Column:
    return F.expr(f"l_orderkey div {BLOCK}")


def _brand(part: str) -> Column:
    """Package of a file: its block, and the half of it that it is in."""
    at = f"({part} div {ROOM} + {part} % {ROOM} div {FILES // 2}) % 25"
    return F.expr(f"concat('brand_', 1 + ({at}) div 5, 1 + ({at}) % 5)")


def _module(part: str) -> Column:
    return F.concat(_brand(part), F.lit(".p"), F.col(part).cast("string"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, line): file a imports file b; the line is that of a's order line."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = W.partitionBy(F.expr(f"l_orderkey div {GROUP}")).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    number = _block() * ROOM + F.col("l_partkey") % FILES
    rows = rows.select(
        number.alias("a"), F.lead(number).over(order).alias("b"), F.col("l_linenumber").cast("int").alias("line"),
        F.col("l_orderkey").alias("o"), F.lead("l_orderkey").over(order).alias("next"),
    )
    return rows.where(f"b is not null and (o = next or o div {BLOCK} <> next div {BLOCK})").select("a", "b", "line")


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, path, module): src/<brand>/p<part>.py, a block's files in two brands of 25."""
    blocks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(_block().alias("block")).distinct()
    files = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(FILES - 1))).alias("r")).select((F.col("block") * ROOM + F.col("r")).alias("part"))
    part = F.col("part").cast("string")
    return files.select("part", F.concat(F.lit("src/"), _brand("part"), F.lit("/p"), part, F.lit(".py")).alias("path"), _module("part").alias("module"))


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, line) between modules. A file of an order line is one of ``part_paths``, so its number tells its name."""
    return part_edges(spark, sf_dir).select(_module("a").alias("source"), _module("b").alias("target"), "line")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as discovery gives them, below the root src."""
    named = part_paths(spark, sf_dir)
    return named.select(
        F.lit(0).alias("root_ord"), F.lit("src").alias("root"), F.col("part").cast("long").alias("file_ord"), F.col("path").alias("rel_path"),
        F.split("path", "/").alias("path_key"), "module", F.lit(False).alias("is_package"),
    )


#: The same in SQL: tables e (a, b, line), p (part, brand, path, module), d (src, dst, lines, near: in one block).
SQL_EDGES = f"""order_lines AS (
  SELECT l_orderkey AS o, l_orderkey // {BLOCK} * {ROOM} + l_partkey % {FILES} AS a, CAST(l_linenumber AS INTEGER) AS line,
         lead(l_orderkey // {BLOCK} * {ROOM} + l_partkey % {FILES}) OVER w AS b, lead(l_orderkey) OVER w AS next
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey // {GROUP} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)
), e AS (
  SELECT a, b, line FROM order_lines WHERE b IS NOT NULL AND (o = next OR o // {BLOCK} <> next // {BLOCK})
), numbered AS (
  SELECT block * {ROOM} + r AS part, (block + r // {FILES // 2}) % 25 AS nth
  FROM (SELECT DISTINCT l_orderkey // {BLOCK} AS block FROM lineitem), range({FILES}) AS f(r)
), p AS (
  SELECT part, 'brand_' || (1 + nth // 5) || (1 + nth % 5) AS brand, 'src/brand_' || (1 + nth // 5) || (1 + nth % 5) || '/p' || part || '.py' AS path,
         'brand_' || (1 + nth // 5) || (1 + nth % 5) || '.p' || part AS module FROM numbered
), d AS (
  SELECT x.path AS src, y.path AS dst, list_sort(list(DISTINCT line)) AS lines, any_value(a // {ROOM} = b // {ROOM}) AS near
  FROM e JOIN p x ON e.a = x.part JOIN p y ON e.b = y.part GROUP BY x.path, y.path
)"""
