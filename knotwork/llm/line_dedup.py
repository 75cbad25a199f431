"""Lines that stand on many sites: HyperLogLog sketches by line, exact counts near the threshold, removal.

Scale: lines travel as 64-bit hashes, never as text. A first aggregation with map-side combining keeps the lines seen on
two sites at least; only their occurrences are written, once, and everything after reads that table. Sketches merge in
the aggregation, so a line on every page of the corpus costs one sketch a task. The texts move once, to meet the list
of what they lose.

Copies of one document carry its lines to many sites too. They are told from boilerplate by what else they hold: more
than ``copied`` of a copy's text stands on widely spread lines, and such a document proves nothing of its lines. A line
is boilerplate if it stands on ``min_sites`` sites in documents that have a text of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.minhash import row_key
from knotwork.operators.lineage import cut


@dataclass(frozen=True)
class LineDedupParams:
    """min_sites: distinct sites from which a line is boilerplate. copied: share of a document's characters on lines of so
    many sites, beyond which it counts for no line's sites, as it is a copy. log_registers: of a sketch. sigmas: of the
    sketch's error on either side of min_sites within which sites are counted exactly."""

    min_sites: int = 10
    copied: float = 0.5
    log_registers: int = 12
    sigmas: float = 4.0

    @property
    def band(self) -> tuple[float, float]:
        error = self.sigmas * 1.04 / 2 ** (self.log_registers / 2)
        return self.min_sites * (1 - error) - 1, self.min_sites * (1 + error) + 1


def _site(site: str) -> Column:
    return F.when(F.col(site).isNotNull(), F.xxhash64(F.col(site).cast("string")))


def _lines(docs: DataFrame, site: str, *more: Column) -> DataFrame:
    """(h, s, size, ...) of every line that isn't empty; size in characters."""
    rows = docs.select(*more, _site(site).alias("s"), F.explode(F.split("text", "\n")).alias("line"))
    return rows.where("line <> ''").select(*[c for c in rows.columns if c != "line"], F.xxhash64("line").alias("h"), F.length("line").alias("size"))


def spread(occurrences: DataFrame, p: LineDedupParams = LineDedupParams()) -> DataFrame:
    """(h) of lines of ``occurrences`` (h, s) that stand on ``min_sites`` distinct sites at least."""
    low, high = p.band
    sketched = occurrences.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("s", p.log_registers)).alias("about"))
    sketched = cut(sketched.where(F.col("about") >= low), "spread")
    near = sketched.where(F.col("about") <= high).select("h")
    exact = occurrences.join(near, "h", "left_semi").select("h", "s").distinct().groupBy("h").agg(F.count("s").alias("sites"))
    return sketched.where(F.col("about") > high).select("h").union(exact.where(F.col("sites") >= p.min_sites).select("h"))


def losses(docs: DataFrame, p: LineDedupParams = LineDedupParams(), site: str = "source") -> DataFrame:
    """(key, lost) hashes of the lines that a row of ``docs`` loses; rows that lose none are left out."""
    sites = _lines(docs, site).groupBy("h").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    several = sites.where("a <> b").select("h")
    where = _lines(docs, site, row_key().alias("key"), "doc_id", F.length("text").alias("whole")).join(several, "h", "left_semi")
    seen = cut(where.distinct(), "lines")
    hit = cut(seen.join(spread(seen.select("h", "s"), p), "h", "left_semi"), "widespread")
    held = hit.select("key", "h", "size", "whole").distinct().groupBy("key").agg(F.sum("size").alias("spread"), F.first("whole").alias("whole"))
    own = hit.join(held.where(F.col("spread") > p.copied * F.col("whole")).select("key"), "key", "left_anti")
    bad = spread(own.select("h", "s"), p)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    hit = cut(hit.join(bad, "h", "left_semi").select("h", "key", "doc_id"), "boilerplate")
    keeper = hit.groupBy("h").agg(first.alias("first")).select("h", F.col("first.key").alias("keeper"))
    return hit.join(keeper, "h").where("key <> keeper").groupBy("key").agg(F.collect_set("h").alias("lost"))


def drop_boilerplate(docs: DataFrame, p: LineDedupParams = LineDedupParams(), site: str = "source") -> DataFrame:
    """``docs`` without lines that stand on ``min_sites`` distinct sites or more, and ``removed_lines``.

    Sites count through documents that aren't copies (see above); what is boilerplate by them goes from copies as well.
    The row of the least doc_id that holds such a line keeps it, so that no line leaves the corpus altogether; null ids
    come last, and rows equal in id and text are one row in this. A line is what stands between line feeds, compared
    exactly; empty lines stay. Rows without a site hold lines but count for no site. n_chars becomes the new length; a
    row that loses nothing is returned as it is, with a null text too. Other columns are carried along; columns named
    like the ones used inside (h, s, key, lost) do not clash.
    """
    keyed = docs.select("*", row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("__key"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(site).alias("site"))
    lost = losses(slim, p, "site").select(F.col("key").alias("__key"), F.col("lost").alias("__lost"))
    met = keyed.join(lost, "__key", "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__lost"), F.xxhash64(x)))
    text = F.when(F.col("__lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = met.withColumn("__text", text).withColumn(
        "__removed", F.when(F.col("__lost").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept))
    )
    columns = [
        F.col("__text").alias("text")
        if c == "text"
        else (F.when(F.col("__lost").isNull(), F.col(c)).otherwise(F.length("__text").cast("long")).alias(c) if c == "n_chars" else F.col(c))
        for c in docs.columns
    ]
    return out.select(*columns, F.col("__removed").alias("removed_lines"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents
), wide AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), copies AS (
  SELECT doc_id FROM (SELECT DISTINCT doc_id, line FROM lines JOIN wide USING (line)) JOIN documents USING (doc_id)
  GROUP BY doc_id, text HAVING sum(length(line)) > 0.5 * length(text)
), boilerplate AS (
  SELECT line FROM lines JOIN wide USING (line) WHERE doc_id NOT IN (SELECT doc_id FROM copies)
  GROUP BY line HAVING count(DISTINCT source) >= 10
), bad AS (
  SELECT line, min(doc_id) AS keeper FROM lines JOIN boilerplate USING (line) GROUP BY line
), lost AS (
  SELECT l.doc_id, list(DISTINCT l.line) AS lost FROM lines l JOIN bad b ON l.line = b.line
  WHERE l.doc_id <> b.keeper GROUP BY l.doc_id
), kept AS (
  SELECT d.*, lost, string_split(text, chr(10)) AS every,
         list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(lost, x)) AS stay
  FROM documents d LEFT JOIN lost l ON d.doc_id = l.doc_id
)
SELECT doc_id, CASE WHEN lost IS NULL THEN text ELSE array_to_string(stay, chr(10)) END AS text, lang, source,
       CASE WHEN lost IS NULL THEN n_chars ELSE length(array_to_string(stay, chr(10))) END AS n_chars,
       CAST(CASE WHEN lost IS NULL THEN 0 ELSE len(every) - len(stay) END AS INTEGER) AS removed_lines
FROM kept
"""
