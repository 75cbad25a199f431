"""Weak components of a graph of files, found for the most part where its edges lie.

Files that import each other are near one another in discovery order. Edges are brought together by their ``place``, a number
of files in that order, and each task joins the ends of its own edges into pieces, in memory. Pieces of two tasks that share a
file are linked, and stars join linked pieces to components. With good places there is next to nothing to link; with bad ones
the stars do all the work, and the components are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.components import connected_components
from knotwork.operators.lineage import cut

#: Edges from which on a task finds their pieces, at the end of a place, and a fourth of what it takes where a place has no end.
CHUNK = 1_000_000
#: Rows of whole components that a task searches together.
BATCH = 100_000
#: Files of one place, as a power of two.
PLACE_BITS = 13


def place(root_ord: str | Column, file_ord: str | Column) -> Column:
    """Where a file stands in discovery order, roughly. It decides where edges are searched first, never what is found."""
    root, at = (F.col(x) if isinstance(x, str) else x for x in (root_ord, file_ord))
    return (F.shiftright(at.cast("long"), PLACE_BITS) + root.cast("long") * 1_000_003).cast("long")


def local_labels(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least id of the weak component, within these edges, of each edge."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(ids))
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            return ids[x]
        least = np.minimum(x, y)
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)
        while (low[low] != low).any():
            low = low[low]


def _labelled(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    label = local_labels(table["u"].to_numpy(), table["v"].to_numpy())
    return table.drop_columns(["u", "v", "place"]).append_column("piece", pa.array(label, pa.int64())).to_batches()


def _label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in order of place with their pieces, whole places at a time unless one is too large."""
    held, n, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        places = batch.column("place").to_numpy()
        if n >= CHUNK:
            at = int((places != last).argmax()) if places[-1] != last else len(places)
            held.append(batch.slice(0, at))
            batch, n = batch.slice(at), n + at
            if batch.num_rows or n >= 4 * CHUNK:
                yield from _labelled(held)
                held, n = [], 0
        if batch.num_rows:
            held.append(batch)
        n, last = n + batch.num_rows, places[-1]
    if held:
        yield from _labelled(held)


def ident(path: str) -> Column:
    return F.xxhash64(path)


class Pieces:
    """Edges (src, dst, lines) other than self-loops, with their weak components."""

    def __init__(self, edges: DataFrame):
        near = F.col("place") if "place" in edges.columns else F.xxhash64(F.regexp_replace("src", "/[^/]*$", ""))
        lines = F.col("lines") if "lines" in edges.columns else F.array().cast("array<int>")
        rows = edges.where("src <> dst").select("src", "dst", lines.alias("lines"), near.alias("place"))
        rows = rows.repartition("place").sortWithinPartitions("place").select("src", "dst", "lines", "place", ident("src").alias("u"), ident("dst").alias("v"))
        self.table = cut(rows.mapInArrow(_label, "src string, dst string, lines array<int>, piece long"), "pieces")
        ends = self.table.select(ident("src").alias("id"), "piece").union(self.table.select(ident("dst").alias("id"), "piece"))
        self.ends = ends.groupBy("id").agg(F.min("piece").alias("piece"), F.max("piece").alias("last"))
        shared = cut(self.ends.where("piece <> last").select("id", F.col("piece").alias("least")), "shared")
        self.links = None
        if shared.limit(1).count():
            pairs = ends.join(shared, "id").where("piece <> least").select(F.col("piece").alias("u"), F.col("least").alias("v")).distinct()
            self.links = cut(connected_components(pairs).select(F.col("node").alias("piece"), "component"), "links")

    def _component(self, rows: DataFrame, *columns: str) -> DataFrame:
        if self.links is None:
            return rows.select(*columns, F.col("piece").alias("component"))
        return rows.join(self.links, "piece", "left").select(*columns, F.coalesce("component", "piece").alias("component"))

    def edges(self) -> DataFrame:
        """(src, dst, lines, component)."""
        return self._component(self.table, "src", "dst", "lines")

    def place(self, nodes: DataFrame, column: str) -> DataFrame:
        """``nodes`` with the component of a path; one without edges is a component by itself."""
        homes = self._component(self.ends, "id")
        met = nodes.withColumn("id", ident(column)).join(homes, "id", "left")
        return met.select(*nodes.columns, F.coalesce("component", "id").alias("component"))


def pieces_of(edges: DataFrame) -> Pieces:
    """Found once for a frame."""
    if not hasattr(edges, "_knotwork_pieces"):
        edges._knotwork_pieces = Pieces(edges)
    return edges._knotwork_pieces


def too_large(edges: DataFrame, task_edges: int) -> DataFrame | None:
    """(component) of those of ``edges`` (component, ...) that no task can hold, or None."""
    found = cut(edges.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > task_edges).select("component"), "large")
    return found if found.limit(1).count() else None


def without(rows: DataFrame, components: DataFrame | None) -> DataFrame:
    return rows if components is None else rows.join(components, "component", "left_anti")


def _whole(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that come in order of component, in batches of whole components."""
    held: list[pd.DataFrame] = []
    n = 0
    for part in parts:
        if n >= BATCH:
            other = part["component"].to_numpy() != held[-1]["component"].iloc[-1]
            at = int(other.argmax()) if other.any() else len(part)
            held.append(part[:at])
            part = part[at:]
            if len(part):
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if len(part):
            held.append(part)
            n += len(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def by_component(rows: DataFrame, search: Callable[[pd.DataFrame], pd.DataFrame], shape: str) -> DataFrame:
    """``search`` of many whole components at a time."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _whole(parts):
            yield search(batch)

    return rows.repartition("component").sortWithinPartitions("component").mapInPandas(run, shape)
