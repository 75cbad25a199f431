"""Fingerprints by content-defined chunks: normalised gear-hash boundaries, digest sets weighted by length, containment.

Scale: the texts are chunked once, and what comes of them moves once, (class, chunk) by chunk. Documents of one chunk set are
one class from the start, so that copies cost nothing more. A chunk that stands in one class only can prove nothing and is
gone after that; what share of a class the others make up bounds its containment, and classes below the threshold are gone
before any pair is formed. Of the rest, only the rarest chunks seek candidates: a class that has none of the chunks making
up more than 1 - threshold of another's length can't contain it. That is exact, and spares chunks that stand everywhere.
What the shorter of two classes shares is the larger part of it, so only the shorter seeks, and two classes are one row however
they contain each other. ``links`` lists pairs of classes, and the class of each document; n classes that contain each
other are n * (n - 1) / 2 of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.llm._text import BASE, INVERSE, MASK, batches, buffers, cached_powers, mix, slices
from knotwork.operators.lineage import cut

CHUNKED = "doc_id long, class long, total long, chunks array<bigint>"


@dataclass(frozen=True)
class ChunkParams:
    """Bytes of a chunk: least, usual, most. normal: bits by which boundaries get rarer before the usual size and more
    frequent after it. window: bytes that a boundary depends on. threshold: least share of a document's length that another
    must hold to contain it."""

    least: int = 64
    usual: int = 256
    most: int = 2048
    normal: int = 2
    window: int = 32
    threshold: float = 0.8
    seed: int = 12


#: For documents of one or two thousand bytes: an edit, or either end of a passage inside another text, costs tens of bytes.
FINE = ChunkParams(least=12, usual=24, most=192, normal=1, window=10)


def gear_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + table[raw[i]] modulo 2**32, by doubling the window."""
    h = table[raw]
    for k in range(5):
        step = 1 << k
        h[step:] += h[:-step] << np.uint32(step)
    return h


def boundaries(raw: np.ndarray, at: np.ndarray, p: ChunkParams) -> tuple[np.ndarray, np.ndarray]:
    """(begins of chunks in all rows, where each row's chunks begin). ``least`` is beyond the window, so a row's
    chunks depend on that row alone."""
    h = gear_hashes(raw, gear_table(p.seed)) << np.uint32(32 - p.window)  # the low bits depend on the last bytes only
    bits = int(np.log2(p.usual))
    top = lambda n: np.uint32(((1 << n) - 1) << (32 - n))
    easy = np.flatnonzero((h & top(bits - p.normal)) == 0)
    hard = easy[(h[easy] & top(bits + p.normal)) == 0].tolist()
    easy = easy.tolist()
    begins, rows = [], [0]
    for i, stop in zip(at[:-1].tolist(), at[1:].tolist()):
        while i < stop:
            begins.append(i)
            usual, last = min(i + p.usual, stop), min(i + p.most, stop)
            k = bisect_left(hard, i + p.least - 1)
            if k < len(hard) and hard[k] < usual - 1:
                i = hard[k] + 1
                continue
            k = bisect_left(easy, max(i + p.least, usual) - 1)
            i = easy[k] + 1 if k < len(easy) and easy[k] < last else last
        rows.append(len(begins))
    return np.array(begins, np.int64), np.array(rows, np.int64)


def chunk_rows(texts: pa.Array, p: ChunkParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest of each chunk, its length, where each row's chunks begin). The low 16 bits of a digest are the length."""
    at, raw = buffers(texts)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    begin, rows = boundaries(raw, at, p)
    end = np.append(begin[1:], at[-1])
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * cached_powers(BASE, len(raw)), out=total[1:])
    digest = mix((total[end] - total[begin]) * cached_powers(INVERSE, len(raw) + 1)[begin])
    size = (end - begin).astype(np.uint64)
    return ((digest & np.uint64(MASK ^ 0xFFFF)) | size).view(np.int64), end - begin, rows


def _chunker(p: ChunkParams):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            for i, j in slices(batch["text"], 1 << 20):
                part = batch.slice(i, j - i)
                digest, _, rows = chunk_rows(part["text"], p)
                ids, names, totals, flat, ends = [], [], [], [], [0]
                doc_id = part["doc_id"].to_pylist()
                for r in np.flatnonzero(np.diff(rows)).tolist():
                    own = np.unique(digest[rows[r] : rows[r + 1]])
                    word = np.uint64(len(own))
                    with np.errstate(over="ignore"):
                        for step in (3, 5):
                            word = mix(np.atleast_1d(word + mix(own.view(np.uint64) * np.uint64(step)).sum()))[0]
                    ids.append(doc_id[r])
                    names.append(int(np.int64(word.astype(np.int64))))
                    totals.append(int((own & 0xFFFF).sum()))
                    flat.append(own)
                    ends.append(ends[-1] + len(own))
                chunks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(totals, pa.int64()), chunks], names=["doc_id", "class", "total", "chunks"]
                )

    return run


def check(p: ChunkParams) -> None:
    if p.most > 0xFFFF or not p.usual.bit_length() + p.normal <= p.window <= min(32, p.least - 1):
        raise ValueError("a chunk has at most 65535 bytes and more than the window, and the window holds the bits of a boundary")


def fingerprints(docs: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """(doc_id, class, total, chunks) of every row with a text: its set of digests, sorted, their lengths' sum, and a name
    that rows of equal sets share. Null and empty texts have none."""
    check(p)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_chunker(p), CHUNKED)


POSTINGS = "class long, chunk long, doc_id long, total long"


def _poster(p: ChunkParams):
    """Of each text a row (class, chunk) for each chunk, and one (class, null, doc_id, total)."""
    run = _chunker(p)

    def post(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(parts):
            if not batch.num_rows:
                continue
            chunks, names = np.asarray(batch["chunks"].flatten()), np.asarray(batch["class"])
            many = np.asarray(batch["chunks"].value_lengths())
            none = pa.nulls(len(chunks), pa.int64())
            columns = [pa.array(np.repeat(names, many)), pa.array(chunks), none, none]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "chunk", "doc_id", "total"])
            columns = [batch["class"], pa.nulls(len(names), pa.int64()), batch["doc_id"], batch["total"]]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "chunk", "doc_id", "total"])

    return post


def postings(docs: DataFrame, p: ChunkParams) -> DataFrame:
    """(class, chunk, df, doc_id, total): chunks that two classes or more hold, with how many do, and a row with a null chunk
    for each document. Nothing is in it twice."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = F.coalesce("chunk", "class")
    every = rows.mapInArrow(_poster(p), POSTINGS).withColumn("place", place).repartition("place").distinct()
    df = F.count("*").over(W.partitionBy("place", "chunk"))
    return every.withColumn("df", df).where("chunk is null or df > 1").drop("place")


SEEKERS = "class long, total long, chunks array<bigint>, seek array<bigint>"


def _seeker(p: ChunkParams):
    """Of classes with enough shared chunks, those chunks, and the rarest of them, without which there is no containment."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            lists = batch["items"]
            many = np.asarray(lists.value_lengths())
            row = np.repeat(np.arange(len(many)), many)
            items = lists.flatten()
            chunk, df = np.asarray(items.field("chunk")), np.asarray(items.field("df"))
            order = np.lexsort((chunk, df, row))
            chunk, size = chunk[order], chunk[order] & 0xFFFF
            begin = np.cumsum(many) - many
            upto = np.concatenate([[0], np.cumsum(size)])
            total = np.asarray(batch["total"])
            shareable = upto[begin + many] - upto[begin]
            # chunks of one class only come first in the order of rarity: they are what is missing from shareable
            before = upto[:-1] - upto[begin][row] + (total - shareable)[row]
            least = np.ceil(p.threshold * total).astype(np.int64)  # in whole bytes, as 1 - 0.8 is less than 0.2
            seek = (before <= (total - least)[row]) & (shareable >= least)[row]
            ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["class"],
                    batch["total"],
                    pa.ListArray.from_arrays(ends(many), pa.array(chunk)),
                    pa.ListArray.from_arrays(ends(np.bincount(row[seek], minlength=len(many))), pa.array(chunk[seek])),
                ],
                names=["class", "total", "chunks", "seek"],
            )

    return run


def class_links(held: DataFrame, classes: DataFrame, p: ChunkParams) -> DataFrame:
    """(class, container, total, outer, shared) of each two classes, the longer of which holds ``threshold`` of the shorter.
    class is the one of less length (total), container that of more (outer), of equal ones the lesser and the greater name.
    held: (class, chunk, df) of chunks that two classes or more hold, each row once; classes: (class, total)."""
    # two classes have no other chunks in common than these
    common = held.groupBy("class").agg(F.collect_list(F.struct("chunk", "df")).alias("items")).join(classes, "class")
    sought = cut(common.select("class", "total", "items").mapInArrow(_seeker(p), SEEKERS), "chunks")
    longer = sought.select(F.col("class").alias("container"), F.col("total").alias("outer"), F.col("chunks").alias("b"))
    seekers = sought.select("class", "total", F.explode("seek").alias("chunk"))
    holders = longer.select("container", "outer", F.explode("b").alias("chunk"))
    ordered = "total < outer or total = outer and class < container"
    pairs = seekers.join(holders, "chunk").where(ordered).select("class", "container").distinct()
    a = sought.where("size(seek) > 0").select("class", "total", F.col("chunks").alias("a"))
    both = F.aggregate(F.array_intersect("a", "b"), F.lit(0).cast("long"), lambda acc, x: acc + x.bitwiseAND(0xFFFF))
    met = pairs.join(a, "class").join(longer, "container").select("class", "container", "total", "outer", both.alias("shared"))
    return met.where(F.col("shared") >= p.threshold * F.col("total"))


def _classes(docs: DataFrame, p: ChunkParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, class, total) of each document, (class, name, total) of each class, and the links of classes."""
    check(p)
    made = cut(postings(docs, p), "postings")
    members = made.where("chunk is null").select("doc_id", "class", "total")
    names = cut(members.groupBy("class").agg(F.min("doc_id").alias("name"), F.first("total").alias("total")), "classes")
    return members, names, class_links(made.where("chunk is not null").select("class", "chunk", "df"), names.select("class", "total"), p)


def links(docs: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """(doc_id, class_id, container_id, container_class_id, containment, shared_bytes, total_bytes, container_bytes): the class of
    each document, and which classes hold ``threshold`` of another.

    A document is its set of chunks, each weighted by its length in UTF-8; rows of equal sets are one class, its id a hash
    of the set. Each document has one row without a container; rows of one id and set count once. Each two classes, the longer
    of which holds ``threshold`` of the shorter, have one row more: doc_id and class_id are of the shorter (of equal
    ones, of the lesser class_id), container_id and container_class_id of the longer, both ids the least doc_id of the class (null
    if it has no other), and containment is shared_bytes of total_bytes. The shorter holds ``threshold`` of the longer too
    if shared_bytes is as much of container_bytes. Null and empty texts have no class. Other columns are ignored.
    """
    members, names, found = _classes(docs, p)
    none = F.lit(None)
    own = members.select(
        "doc_id", F.col("class").alias("class_id"), none.cast("long").alias("container_id"), none.cast("long").alias("container_class_id"),
        none.cast("double").alias("containment"), none.cast("long").alias("shared_bytes"), F.col("total").alias("total_bytes"), none.cast("long").alias("container_bytes"),
    )
    inner = names.select("class", F.col("name").alias("doc_id"))
    outer = names.select(F.col("class").alias("container"), F.col("name").alias("container_id"))
    pairs = found.join(inner, "class").join(outer, "container").select(
        "doc_id", F.col("class").alias("class_id"), "container_id", F.col("container").alias("container_class_id"), (F.col("shared") / F.col("total")).alias("containment"),
        F.col("shared").alias("shared_bytes"), F.col("total").alias("total_bytes"), F.col("outer").alias("container_bytes"),
    )
    return own.unionByName(pairs)


def containment(docs: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """(doc_id, container_id, containment, shared_bytes, total_bytes): which documents hold ``threshold`` of a document.

    ``links`` written out for each document: rows of equal sets are one class, named by its least doc_id (nulls last): containers
    are named so, and each other row of a class has its class's name as a container, with containment 1. Null and empty
    texts contain nothing and are in nothing; rows of one id and set count once. Other columns are ignored. n copies
    of a class in m others are n * m rows.
    """
    members, names, found = _classes(docs, p)
    found = cut(found, "links")
    back = found.where(F.col("shared") >= p.threshold * F.col("outer")).select(F.col("container").alias("class"), F.col("class").alias("container"), "shared")
    found = found.select("class", "container", "shared").unionByName(back)
    outer = found.join(names.select(F.col("class").alias("container"), F.col("name").alias("container_id")), "container").select("class", "container_id", "shared")
    several = members.join(names.select("class", "name"), "class").where(~F.col("doc_id").eqNullSafe(F.col("name"))).select(
        "doc_id", F.col("name").alias("container_id"), F.lit(1.0).alias("containment"), F.col("total").alias("shared_bytes"), F.col("total").alias("total_bytes")
    )
    others = members.join(outer, "class").select(
        "doc_id", "container_id", (F.col("shared") / F.col("total")).alias("containment"), F.col("shared").alias("shared_bytes"), F.col("total").alias("total_bytes")
    )
    return several.unionByName(others)
