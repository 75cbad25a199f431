"""Near-duplicate documents: universal hash minima, banding, verification by signature, components by stars.

Scale: one pass over the texts makes 160 minima a document (one byte each is kept) and 40 band hashes. Documents of one
signature are one node from then on, so that copies, however many, cost one node. Buckets of equal band hash are found
by an aggregation over (hash, node) pairs, and a bucket that several bands repeat is examined once. Inside a bucket a
search over the not yet reached members finds the components of "agreement at or above the threshold" without listing
its pairs: a bucket of n copies costs n comparisons with its first member, not n * n. A bucket beyond ``bucket_rows`` is
cut into groups, and a task searches two of them, each group meeting each other once; members of a bucket that agree with
nobody would be compared pair by pair, so a search stops after ``comparisons`` and hands those still to be compared to
such tasks of ``block`` rows a group. Both are exact: every pair of a bucket is in some task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.llm._text import batches, mix, slices, word_hashes
from knotwork.operators.components import connected_components
from knotwork.operators.lineage import cut

SIGNATURES = "key long, doc_id long, node long, sig binary, bands array<bigint>"


@dataclass(frozen=True)
class MinHashParams:
    """shingle: words in a shingle. bands * rows universal hashes. threshold: least share of agreeing minima. bucket_rows,
    comparisons, block: what one task holds of a bucket, compares in it, and holds of it if that is not enough."""

    shingle: int = 3
    bands: int = 40  # a pair at the threshold shares a band with probability 0.92, beyond it sooner
    rows: int = 4
    threshold: float = 0.5
    seed: int = 20240611
    bucket_rows: int = 1 << 17
    comparisons: int = 1 << 26
    block: int = 1 << 12


def row_key(doc_id: str | Column = "doc_id", text: str | Column = "text") -> Column:
    """Names a row by what it holds, as ids may be null or repeated."""
    return F.xxhash64(doc_id, text)


def coefficients(p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(p.seed))
    n = p.bands * p.rows
    return rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and where each row's runs begin.

    A text of fewer words is one run of its own; one without words has none.
    """
    words, at = word_hashes(texts)
    count = np.diff(at)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    first = np.repeat(at[:-1] - begin[:-1], runs) + np.arange(begin[-1])
    last = np.repeat(at[1:], runs)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(first), np.uint64)
    for j in range(width):
        here = padded[first + j]
        here[first + j >= last] = 0
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += here
    return mix(total), begin


def minima(texts: pa.Array, p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    """(rows with words, their minima: rows x hashes, high halves) of multiply-shift hashes."""
    a, b = coefficients(p)
    runs, begin = shingles(texts, p.shingle)
    some = np.flatnonzero(np.diff(begin))
    out = np.empty((len(a), len(some)), dtype=np.uint32)
    if len(some):
        starts, work = begin[some], np.empty_like(runs)
        for k in range(len(a)):
            np.multiply(runs, a[k], out=work)
            np.add(work, b[k], out=work)
            out[k] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return some, out.T


def _signer(p: MinHashParams):
    def sign(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            for i, j in slices(batch["text"], 512 << 10):
                part = batch.slice(i, j - i)
                some, low = minima(part["text"], p)
                if not len(some):
                    continue
                sig = np.ascontiguousarray(mix(low.astype(np.uint64)).astype(np.uint8))
                band = np.zeros((len(some), p.bands), np.uint64)
                for r in range(p.rows):
                    band = mix(band + low[:, r :: p.rows][:, : p.bands].astype(np.uint64) + np.uint64(r + 1))
                band = mix(band + np.arange(p.bands, dtype=np.uint64)).view(np.int64)
                wide = np.zeros((len(some), -(-sig.shape[1] // 8) * 8), np.uint8)
                wide[:, : sig.shape[1]] = sig
                node = np.zeros(len(some), np.uint64)
                for column in wide.view(np.uint64).T:
                    node = mix(node * np.uint64(0x9E3779B97F4A7C15) + column)
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["key"].take(take),
                        part["doc_id"].take(take).cast(pa.int64()),
                        pa.array(node.view(np.int64)),
                        pa.array([row.tobytes() for row in sig], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * p.bands), pa.array(band.reshape(-1))),
                    ],
                    names=["key", "doc_id", "node", "sig", "bands"],
                )

    return sign


def signatures(docs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """(key, doc_id, node, sig, bands) of every document that holds a word. Equal signatures have equal nodes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(row_key().alias("key"), "doc_id", "text").mapInArrow(_signer(p), SIGNATURES)


def bucket_links(sig: np.ndarray, least: float, budget: float = float("inf")) -> tuple[np.ndarray, np.ndarray]:
    """(for each member of a bucket the index of its component's first member, indexes of members not compared yet).

    sig: members x minima bytes. The search ends after the component in which ``budget`` comparisons are reached.
    """
    n = len(sig)
    root = np.arange(n)
    left = np.arange(n)
    done = 0
    while len(left) > 1 and done < budget:
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            done += len(left)
            hit = (sig[left] == sig[queue.pop()]).sum(axis=1) >= least
            found, left = left[hit], left[~hit]
            root[found] = seed
            queue.extend(found.tolist())
    return root, left if len(left) > 1 else left[:0]


def _linker(p: MinHashParams, budget: float):
    """Rows (u, v, left): links of nodes; or, with ``left``, a bucket and a member that is still to be compared in it."""
    k = p.bands * p.rows
    least = k * (p.threshold * 255 + 1) / 256  # bytes of differing minima agree once in 256

    def link(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def run(table: pa.Table) -> pa.RecordBatch:
            bucket = table["bucket"].to_numpy()
            node = table["node"].to_numpy()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(node), -1)
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            us, vs, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if j - i == 2:
                    if (sig[i] == sig[i + 1]).sum() >= least:
                        us.append(node[i + 1 : j])
                        vs.append(node[i : i + 1])
                elif j - i > 2:
                    root, left = bucket_links(sig[i:j], least, budget)
                    own = np.flatnonzero(root != np.arange(j - i))
                    us.append(node[i:j][own])
                    vs.append(node[i:j][root[own]])
                    more.append(left + i)
            more = np.concatenate(more) if more else np.zeros(0, np.int64)
            u, v = np.concatenate([*us, bucket[more]]), np.concatenate([*vs, node[more]])
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.arange(len(u)) >= len(u) - len(more))], names=["u", "v", "left"])

        for batch in batches(parts):
            bucket = batch["bucket"].to_numpy()
            tail = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if tail:
                yield run(pa.Table.from_batches([*held, batch.slice(0, tail)]))
                held = []
            held.append(batch.slice(tail))
            if len(held) > 64:
                held = pa.Table.from_batches(held).combine_chunks().to_batches()
        if held:
            yield run(pa.Table.from_batches(held))

    return link


def in_groups(members: DataFrame, most: int) -> DataFrame:
    """(bucket, node) of ``members`` (bucket, n, node), n being a bucket's size: buckets of more than ``most`` are cut into
    groups by a hash, and every two groups are a bucket of their own."""
    groups = F.ceil(F.col("n") / F.lit(most))
    own = F.pmod(F.xxhash64("node", "bucket"), groups)
    others = F.when(groups == 1, F.array(own)).otherwise(F.filter(F.sequence(F.lit(0), groups - 1), lambda x: x != own))
    pairs = members.select("bucket", "node", groups.alias("groups"), own.alias("own"), F.explode(others).alias("other"))
    both = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    return pairs.select(F.when(F.col("groups") == 1, F.col("bucket")).otherwise(both).alias("bucket"), "node")


def links(sigs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """(u, v) nodes whose signatures agree, enough of them to connect what a comparison of all pairs of a bucket would."""
    nodes = sigs.dropDuplicates(["node"])
    bands = nodes.select("node", F.explode("bands").alias("h"))
    buckets = bands.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor("node").alias("x"), F.min("node").alias("m")).where("n > 1")
    shared = bands.join(buckets, "h").select(F.xxhash64("n", "x", "m").alias("bucket"), "n", "node").distinct()

    def compared(rows: DataFrame, budget: float) -> DataFrame:
        met = rows.join(nodes.select("node", "sig"), "node").repartition("bucket").sortWithinPartitions("bucket", "node")
        return met.mapInArrow(_linker(p, budget), "u long, v long, left boolean")

    found = cut(compared(in_groups(shared, p.bucket_rows), p.comparisons), "links")
    left = found.where("left").select(F.col("u").alias("bucket"), F.col("v").alias("node"))
    found = found.where("not left").select("u", "v")
    if left.isEmpty():
        return found
    rest = left.join(left.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    return found.unionByName(compared(in_groups(rest, p.block), float("inf")).select("u", "v"))


def near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """(key, doc_id, group_id, group_size, keep) of the documents in groups of two or more near copies.

    Two documents are linked if a band of their minima is equal and at least ``threshold`` of all minima agree; groups
    are the connected components. group_id is the least doc_id of the group and that row is kept; null ids come last, and
    of rows with one id the least key is kept. Rows equal in id and text have equal keys and are kept or dropped as one
    here. Texts without words (null, empty, signs only) are in no group. Other columns are ignored.
    """
    sigs = cut(signatures(docs, p), "minhash")
    parts = connected_components(links(sigs, p))
    named = sigs.select("key", "doc_id", "node").join(parts, "node", "left").select("key", "doc_id", F.coalesce("component", "node").alias("group"))
    member = cut(named, "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    groups = member.groupBy("group").agg(F.count("*").alias("group_size"), first.alias("first")).where("group_size > 1")
    return member.join(groups, "group").select(
        "key", "doc_id", F.col("first.doc_id").alias("group_id"), "group_size", (F.col("key") == F.col("first.key")).alias("keep")
    )


def drop_near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """``docs`` with one row of each group, the one that ``near_duplicates`` keeps; of equal rows, one."""
    found = cut(near_duplicates(docs, p).groupBy("key").agg(F.bool_or("keep").alias("keep"), F.count("*").alias("copies")), "groups")
    keyed = docs.withColumn("__key", row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    fate = found.select(F.col("key").alias("__key"), "keep", "copies")
    marked = keyed.join(fate.select("__key", F.col("keep").alias("__keep"), F.col("copies").alias("__copies")), "__key", "left")
    kept = marked.where("__keep is null or __keep")
    if not found.where("copies > 1").isEmpty():  # one of equal rows; where there are none, texts need not meet their likes
        nth = F.row_number().over(W.partitionBy("__key").orderBy("__key"))
        kept = kept.withColumn("__nth", nth).where("__copies is null or __nth = 1")
    return kept.select(*docs.columns)
