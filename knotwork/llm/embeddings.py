"""Near-duplicate embeddings by a pivot-permutation index: nearest pivots in order, inverted lists, shared counts, verification.

Scale: pivots are 4 * sqrt(n) vectors, as many as ``pivot_bytes`` hold at most, so that what each worker is given is
bounded and lists grow with the square root of the input. A vector travels to the lists of its nearest pivots as two bytes
a dimension; its exact numbers move once more, for pairs that those leave in. In a list shared pivots are counted first,
and only pairs with enough of them, whose first shared pivot is the list's, are verified: a pair is verified once, however
many lists it is in. A list gives back links that connect what all its verified pairs would connect, so a cluster of n
copies costs n links. Equal vectors are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.llm._text import batches, by_keys
from knotwork.operators.components import connected_components
from knotwork.operators.lineage import cut


STEPS = 32767  # on either side of zero, by which a vector's numbers are rounded in the lists


@dataclass(frozen=True)
class EmbeddingParams:
    """threshold: least cosine. prefix: nearest pivots that describe a vector. shared: pivots that a pair must have in
    common to be verified. pivot_bytes: that all pivots take at most, at four a dimension. block: its square is how
    many pairs of a list are counted at once."""

    threshold: float = 0.9
    prefix: int = 12
    shared: int = 3
    pivots_per_root: float = 4.0
    pivot_bytes: int = 64 << 20
    block: int = 256
    seed: int = 9


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _indexer(pivots: np.ndarray, prefix: int):
    """Rows (pivot, node, near, bytes): one for each of a vector's nearest pivots; near: all of them, the nearest first."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = min(prefix, len(pivots))
        for whole in batches(parts):
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                x = _unit(_matrix(batch["v"]))
                close = x @ pivots.T
                near = np.argpartition(-close, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(x), 1))
                order = np.argsort(-np.take_along_axis(close, near, 1), axis=1, kind="stable")
                near = np.take_along_axis(near, order, 1).astype(np.int32)
                scale = STEPS / np.abs(x).max(axis=1, keepdims=True)
                small = np.rint(x * scale).astype(np.int16)
                row = np.repeat(np.arange(len(x)), k)
                codes = pa.array([r.tobytes() for r in small], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(near.reshape(-1)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.reshape(-1)), batch["node"].take(take), lists.take(take), codes.take(take)], names=["pivot", "node", "near", "code"]
                )

    return run


BEFORE = 64  # what a pivot before the list's own counts


class Shared:
    """Shared pivots of a list's members; ``pivot``: the list's own, which all of them have; without it every pivot counts one.

    Counts are taken from the members of each pivot, or by a matrix product where those lists are long for their number.
    """

    def __init__(self, near: np.ndarray, pivot: int | None = None) -> None:
        self.base = 0 if pivot is None else 1
        if pivot is not None:
            near = near[near != pivot].reshape(len(near), -1)
        names, at = np.unique(near.reshape(-1), return_inverse=True)
        self.at = at.reshape(near.shape)
        self.weight = np.ones(len(names), np.float32) if pivot is None else np.where(names < pivot, np.float32(BEFORE), np.float32(1))
        self.size = np.bincount(at.reshape(-1), minlength=len(names))
        self.begin = np.cumsum(self.size) - self.size
        self.members = np.argsort(at.reshape(-1), kind="stable") // max(1, near.shape[1])
        self.there: np.ndarray | None = None
        if (self.size.astype(float) ** 2).sum() * 50 > float(len(near)) ** 2 * len(names):
            self.there = np.zeros((len(near), len(names)), np.float32)
            np.put_along_axis(self.there, self.at, 1, axis=1)

    def rows(self, i: int, j: int) -> np.ndarray:
        """Weighted counts of members i .. j - 1 with every member."""
        n = len(self.at)
        if self.there is not None:
            return (self.there[i:j] * self.weight) @ self.there.T + self.base
        pivots = self.at[i:j].reshape(-1)
        many = self.size[pivots]
        place = np.arange(many.sum()) + np.repeat(self.begin[pivots] - (np.cumsum(many) - many), many)
        row = np.repeat(np.arange(len(pivots)) // max(1, self.at.shape[1]), many)
        counts = np.bincount(row * n + self.members[place], np.repeat(self.weight[pivots], many), (j - i) * n)
        return counts.reshape(j - i, n) + self.base

    def of(self, member: int, others: np.ndarray) -> np.ndarray:
        """Weighted counts of one member with ``others``."""
        own = np.zeros(len(self.weight), np.float32)
        own[self.at[member]] = self.weight[self.at[member]]
        return own[self.at[others]].sum(axis=1) + self.base


def enough(counts: np.ndarray, least: int) -> np.ndarray:
    """Whether a pair shares ``least`` pivots, the list's own first among them."""
    return (counts >= least) & (counts < BEFORE)


def slack(dimensions: int) -> float:
    """What rounding may take from a cosine or add to it, and more."""
    return 2.5 * dimensions**0.5 / STEPS + 1e-5


def _close(x: np.ndarray, i: int, may: np.ndarray, least: float) -> np.ndarray:
    """``may`` (rows from i on x all) where the cosine is ``least`` at least: pair by pair where few may be."""
    if may.sum() * 8 > may.size:
        return may & (x[i : i + len(may)] @ x.T >= least)
    a, b = np.nonzero(may)
    for k in range(0, len(a), 1 << 16):
        part = slice(k, k + (1 << 16))
        may[a[part], b[part]] = np.einsum("nd,nd->n", x[i + a[part]], x[b[part]]) >= least
    return may


def list_links(
    near: np.ndarray, x: np.ndarray, least: float, shared: int, block: int, sure: float | None = None, pivot: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) within a list that connect all its pairs with enough shared pivots and a cosine of ``least``. Links
    under ``sure`` may prove false: they are given, and nothing is reached by them. ``pivot``: see ``Shared``."""
    sure = least if sure is None else sure
    n = len(x)
    counts = Shared(near, pivot)
    busy = np.zeros(n, dtype=bool)
    step = max(1, min(n, block * block // n))
    for i in range(0, n, step):
        may = enough(counts.rows(i, min(n, i + step)), shared)
        may &= np.arange(n) > np.arange(i, i + len(may))[:, None]
        if may.any():
            hit = _close(x, i, may, least)
            busy[i : i + len(hit)] |= hit.any(axis=1)
            busy |= hit.any(axis=0)
    left = np.flatnonzero(busy)
    us, vs = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            which = np.flatnonzero(enough(counts.of(at, left), shared))
            cosine = x[left[which]] @ x[at]
            which, cosine = which[cosine >= least], cosine[cosine >= least]
            if len(which):
                found = left[which]
                us.append(np.full(len(found), at))
                vs.append(found)
                reached = which[cosine >= sure]
                queue.extend(left[reached].tolist())
                left = np.delete(left, reached)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def _lister(p: EmbeddingParams):
    shared = p.shared

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            pivot, node = table["pivot"].to_numpy(), table["node"].to_numpy()
            near = np.asarray(table["near"].combine_chunks().flatten()).reshape(len(node), -1)
            x = _unit(np.frombuffer(b"".join(table["code"].to_pylist()), np.int16).reshape(len(node), -1).astype(np.float32))
            off = slack(x.shape[1])
            edge = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1], [True]]))
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                a, b = list_links(near[i:j], x[i:j], p.threshold - off, min(shared, near.shape[1]), p.block, p.threshold + off, int(pivot[i]))
                us.append(node[i:j][a])
                vs.append(node[i:j][b])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        for batch in batches(parts):
            pivot = batch["pivot"].to_numpy()
            tail = int(np.searchsorted(pivot, pivot[-1]))
            if tail:
                yield links(pa.Table.from_batches([*held, batch.slice(0, tail)]))
                held = []
            held.append(batch.slice(tail))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def choose_pivots(nodes: DataFrame, dimensions: int, many: int, p: EmbeddingParams) -> np.ndarray:
    """Unit vectors of a pseudorandom choice among the ``many`` rows of ``nodes`` (node, v): 4 * sqrt(many), or what ``pivot_bytes`` hold."""
    most = int(min(max(1, p.pivot_bytes // (4 * dimensions)), max(16, p.pivots_per_root * many**0.5)))
    chosen = nodes.orderBy(F.xxhash64(F.lit(p.seed), "node"), "node").limit(most).select("v").toPandas()["v"]
    return _unit(np.stack(chosen.to_list()).astype(np.float32))


def near_duplicates(vectors: DataFrame, p: EmbeddingParams = EmbeddingParams()) -> DataFrame:
    """(vec_id, group_id, group_size, keep) of the rows in groups of two or more near copies.

    Rows are linked if their vectors have ``shared`` of their ``prefix`` nearest pivots in common and a cosine of
    ``threshold`` at least; groups are connected components. group_id is the least vec_id of the group and that row is
    kept, null ids come last; of rows with that id one is kept. Vectors that are null, empty, zero, hold a null or a
    number that isn't finite are in no group. Vectors of different lengths are never linked; each length has an index of
    its own. Equal vectors are always linked. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<float>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    )
    rows = cut(rows.select("vec_id", F.xxhash64("v").alias("node"), "v"), "vectors")
    nodes = cut(rows.groupBy("node").agg(F.any_value("v").alias("v")), "nodes")
    lengths = nodes.groupBy(F.size("v").alias("n")).count().where("count > 1").orderBy("n").collect()  # a row a length
    found = spark.createDataFrame([], "u long, v long")
    for length in lengths:
        own = nodes.where(F.size("v") == length["n"])
        pivots = choose_pivots(own, length["n"], length["count"], p)
        lists = own.select("node", "v").mapInArrow(_indexer(pivots, p.prefix), "pivot int, node long, near array<int>, code binary")
        size = length["count"] * p.prefix * (2 * length["n"] + 4 * p.prefix + 40)
        found = found.union(by_keys(lists, size, "pivot").sortWithinPartitions("pivot", "node").mapInArrow(_lister(p), "u long, v long"))
    found = found.distinct()
    a = nodes.select(F.col("node").alias("u"), F.col("v").alias("x"))
    b = nodes.select(F.col("node").alias("v"), F.col("v").alias("y"))
    dot = lambda s, t: F.aggregate(F.zip_with(s, t, lambda m, n: m.cast("double") * n.cast("double")), F.lit(0.0), lambda acc, z: acc + z)
    cosine = dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))
    links = found.join(a, "u").join(b, "v").where(cosine >= p.threshold).select("u", "v")
    parts = connected_components(links)
    member = rows.select("vec_id", "node").join(parts, "node", "left")
    group = W.partitionBy("group")
    named = member.select("vec_id", F.coalesce("component", "node").alias("group")).select(
        "vec_id",
        F.count("*").over(group).alias("group_size"),
        F.min("vec_id").over(group).alias("group_id"),
        F.row_number().over(group.orderBy(F.asc_nulls_last("vec_id"))).alias("r"),
    )
    return named.where("group_size > 1").select("vec_id", "group_id", "group_size", (F.col("r") == 1).alias("keep"))
