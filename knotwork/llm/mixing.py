"""Mixing sources to target weights: packed blocks, multinomial draws by shard, index permutations, a join by index.

Tokens here are runs of non-white bytes with the ASCII white space after them, so that the blocks of a source, laid end to
end, are its documents again, each followed by an empty line.

Scale: a source is split by hash into buckets of about ``bucket_tokens`` tokens, each packed on its own, so that a hot
source is many tasks. What is known of the corpus is (source, bucket) -> tokens, an aggregate. Slots are drawn and mapped
to blocks as numbers; they meet the documents in one shuffle on (source, bucket), in which the texts move once. A shard
holds a row for each source that it drew, not for every source; sums over the shards and buckets before one are taken in
ranges, so that a hot source is no single window. The driver and each worker hold a name, a weight and a size a source.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.llm._text import MASK, batches, buffers, by_keys, slices
from knotwork.operators.lineage import cut

BLOCKS = (
    "shard long, slot long, source string, block_index long, n_tokens int, doc_id long, text string, lang string, n_chars long"
)
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
END = "\n\n"


@dataclass(frozen=True)
class MixParams:
    """block_tokens: in a block; only a bucket's last may be shorter. slots_per_shard: blocks drawn for an output shard.
    weights: share of each source; without them, its share of tokens to the power ``alpha``. bucket_tokens: packed by one
    task. epochs: slots in all, as a multiple of the number of blocks."""

    block_tokens: int = 1024
    slots_per_shard: int = 1024
    weights: tuple[tuple[str, float], ...] | None = None
    alpha: float = 0.7
    bucket_tokens: int = 1 << 18
    epochs: float = 1.0
    seed: int = 71


def token_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where tokens begin: after white space, and at the begin of a row that isn't empty."""
    begin = np.zeros(len(raw), dtype=bool)
    white = WHITE[raw]
    begin[1:] = white[:-1] & ~white[1:]
    first = at[:-1]
    begin[first[first < at[1:]]] = True
    if len(first):
        # white space before a row's first word belongs to that word's token
        word = np.flatnonzero(begin)
        lead = first[(first < at[1:])]
        lead = lead[white[lead]]
        if len(lead):
            after = np.searchsorted(word, lead, side="right")
            row_end = at[np.searchsorted(at, lead, side="right")]
            again = after[after < len(word)]
            begin[word[again][word[again] < row_end[after < len(word)]]] = False
    return np.flatnonzero(begin)


def _pieces(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about two megabytes of text, as tokens are found in arrays that take several times that."""
    for batch in batches(parts):
        for i, j in slices(batch["text"], 2 << 20):
            yield batch.slice(i, j - i)


def _counter(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(parts):
        at, raw = buffers(batch["text"])
        starts = token_starts(raw, at)
        n = np.diff(np.searchsorted(starts, at))
        yield pa.RecordBatch.from_arrays(
            [batch["source"], batch["fine"], pa.array(n.astype(np.int64)), pa.array(np.diff(at))], names=["source", "fine", "n", "bytes"]
        )


def _scramble(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index in a keyed pseudorandom permutation of 0 .. size-1: a Feistel network, walked till in range."""
    x, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    half = np.ones(len(x), np.uint64)  # bits in a half: 4 ** half >= size
    for _ in range(31):
        more = (np.uint64(1) << (half * np.uint64(2))) < size
        if not more.any():
            break
        half += more.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(4):
            left, right = right, left ^ (_scramble(right + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & MASK), k) & m)
        x[todo] = (left << h) | right
        todo &= x >= size
    return x.astype(np.int64)


def draw(shard: int, slots: int, upto: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(sources drawn for a shard, how often each): multinomial counts, as of ``slots`` draws by weight, the same wherever the
    shard is drawn. upto: the weights' running sums, the last one 1."""
    picks = np.random.Generator(np.random.Philox(key=[seed, int(shard)])).random(int(slots))
    return np.unique(np.searchsorted(upto, picks, side="right"), return_counts=True)


RANGE = 4096  # rows that one window adds up


def running(df: DataFrame, key: str, order: str, value: str, to: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its ``key`` with a lower ``order``: integers from 0, each once."""
    ranged = df.withColumn("__range", F.expr(f"{order} div {RANGE}"))
    upto = [W.unboundedPreceding, -1]
    whole = ranged.groupBy(key, "__range").agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(key).orderBy("__range").rowsBetween(*upto)  # a row for each range
    bases = whole.select(key, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = W.partitionBy(key, "__range").orderBy(order).rowsBetween(*upto)
    met = ranged.join(bases, [key, "__range"])
    return met.withColumn(to, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__range", "__base")


def _prepared(docs: DataFrame) -> DataFrame:
    """The columns that packing needs, of rows with a text; a null source is the source ''."""
    return docs.where("text is not null and text <> ''").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.concat(F.col("text").cast("string"), F.lit(END)).alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("lang").cast("string").alias("lang"),
    )


def _fine(seed: int, fine: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(fine))


def _drawer(weights: np.ndarray, total: int, p: MixParams):
    upto = np.cumsum(weights)
    upto[np.flatnonzero(weights)[-1] :] = 1  # whatever rounding left

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 256):
                rows = []
                for shard in part["id"].to_numpy()[i : i + 256].tolist():
                    slots = min(p.slots_per_shard, total - shard * p.slots_per_shard)
                    source, n = draw(shard, slots, upto, p.seed)
                    rows.append((np.full(len(source), shard), np.full(len(source), slots), source, n, np.cumsum(n) - n))
                yield pd.DataFrame(dict(zip(("shard", "slots", "source_id", "n", "start"), map(np.concatenate, zip(*rows)))))

    return run


def _placer(sizes: np.ndarray, names: np.ndarray, p: MixParams):
    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = part["n"].to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            if not len(row):
                continue
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            source = part["source_id"].to_numpy()[row]
            ordinal, size = part["before"].to_numpy()[row] + nth, sizes[source]
            key = np.uint64(p.seed) + np.uint64(1000003) * source.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (ordinal // size).astype(np.uint64)
            shard = part["shard"].to_numpy()[row]
            slot = permute(part["start"].to_numpy()[row] + nth, part["slots"].to_numpy()[row], np.uint64(~p.seed & (1 << 62)) + shard.astype(np.uint64))
            yield pd.DataFrame({"shard": shard, "slot": slot, "source": names[source], "index": permute(ordinal % size, size, key)})

    return run


def _packer(length: int):
    """Packs the rows of each (source, bucket), in order, and gives every block to the slots that ask for it."""

    def pack(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None  # (source, bucket) that is being packed
        wanted: dict[int, list[tuple[int, int]]] = {}
        base = number = tokens = 0
        held: list[bytes] = []  # the block that is open
        owner: tuple = (None, None)
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, tokens, number
            if tokens:
                asked = wanted.get(base + number)
                if asked:
                    text = b"".join(held).decode()
                    out.extend((shard, slot, place[0], base + number, tokens, owner[0], text, owner[1], len(text)) for shard, slot in asked)
                number += 1
            held, tokens = [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])
            out.clear()
            return made

        for batch in _pieces(parts):
            names, bucket, kind = batch["source"].to_pylist(), batch["bucket"].to_pylist(), batch["kind"].to_pylist()
            index, shard, slot = batch["index"].to_pylist(), batch["shard"].to_pylist(), batch["slot"].to_pylist()
            ids, langs = batch["doc_id"].to_pylist(), batch["lang"].to_pylist()
            at, raw = buffers(batch["text"])
            starts = token_starts(raw, at)
            of_row = np.searchsorted(starts, at)
            data = memoryview(raw.tobytes())
            for i in range(batch.num_rows):
                if (names[i], bucket[i]) != place:
                    close()
                    place, wanted, number = (names[i], bucket[i]), {}, 0
                    base = index[i]
                if kind[i] == 0:  # where the bucket's blocks begin
                    base = index[i]
                elif kind[i] == 1:
                    wanted.setdefault(index[i], []).append((shard[i], slot[i]))
                else:
                    a, b, end = int(of_row[i]), int(of_row[i + 1]), int(at[i + 1])
                    from_byte = int(at[i])
                    while a < b:
                        if not tokens:
                            owner = (ids[i], langs[i])
                        take = min(length - tokens, b - a)
                        upto = end if a + take == b else int(starts[a + take])
                        held.append(bytes(data[from_byte:upto]))
                        tokens, a, from_byte = tokens + take, a + take, upto
                        if tokens == length:
                            close()
                if len(out) >= 512:
                    yield flush()
        close()
        if out:
            yield flush()

    return pack


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """One row for every slot of every output shard: the block drawn for it.

    Columns: shard, slot, source, block_index (of the source's blocks), n_tokens, doc_id and lang (of the document that the
    block begins in), text, n_chars. Each shard draws how many slots each source gets, multinomially by weight; the
    draws of a source, counted over all shards, run through a permutation of its blocks, and through another one each
    time it is used up. A source without a weight gets none; weights of absent sources are ignored, the rest scaled.
    Null and empty texts have no tokens; repeated rows are packed as often as they occur. Columns beyond these are
    ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = _prepared(docs)
    many = docs.select("doc_id").count()
    fine = 1 << max(6, (max(many, 1) // 512).bit_length())
    counted = cut(
        rows.select("source", _fine(p.seed, fine).alias("fine"), "text")
        .mapInArrow(_counter, "source string, fine long, n long, bytes long")
        .groupBy("source", "fine")
        .agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")),
        "tokens",
    )
    # the sources are a dimension that the weights name one by one
    summed = counted.groupBy("source").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()
    totals, size_of_all = {r["source"]: r["n"] for r in summed}, sum(r["bytes"] for r in summed)
    share = dict(p.weights) if p.weights is not None else {s: n**p.alpha for s, n in totals.items()}
    names = sorted(s for s in totals if share.get(s, 0) > 0)
    if not names:
        return spark.createDataFrame([], BLOCKS)
    weights = np.array([share[s] for s in names], dtype=float)
    weights /= weights.sum()
    parts = {s: min(fine, 1 << max(0, -(-totals[s] // p.bucket_tokens) - 1).bit_length()) for s in names}
    split = F.broadcast(spark.createDataFrame([(s, parts[s]) for s in names], "source string, buckets long"))

    bucket = F.pmod("fine", "buckets").alias("bucket")
    blocks = counted.join(split, "source").groupBy("source", bucket).agg(F.ceil(F.sum("n") / F.lit(p.block_tokens)).cast("long").alias("blocks"))
    layout = cut(running(blocks, "source", "bucket", "blocks", "base"), "layout")
    size = {r["source"]: r["n"] for r in layout.groupBy("source").agg(F.sum("blocks").alias("n")).collect()}
    total = max(1, round(sum(size.values()) * p.epochs))

    shards = spark.range(-(-total // p.slots_per_shard))
    drawn = cut(shards.mapInPandas(_drawer(weights, total, p), "shard long, slots long, source_id long, n long, start long"), "draws")
    placed = running(drawn, "source_id", "shard", "n", "before")
    sizes = np.array([size[s] for s in names])
    slots = placed.mapInPandas(_placer(sizes, np.array(names, dtype=object), p), "shard long, slot long, source string, index long")

    cell = 1024  # the range join of slots and buckets is an equal join on cells of so many blocks
    spans = layout.where("blocks > 0").select(
        "source", "bucket", "base", "blocks", F.explode(F.sequence(F.expr(f"base div {cell}"), F.expr(f"(base + blocks - 1) div {cell}"))).alias("cell")
    )
    met = slots.withColumn("cell", F.expr(f"index div {cell}")).join(spans, ["source", "cell"]).where("index >= base and index < base + blocks")
    nothing = {"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string"), "order": F.lit(0).cast("long")}
    no_slot = {"shard": F.lit(None).cast("long"), "slot": F.lit(None).cast("long")}
    order = ["source", "bucket", "kind", "order", "index", "shard", "slot", "doc_id", "text", "lang"]
    begin = layout.where("blocks > 0").withColumns(nothing | no_slot | {"kind": F.lit(0), "index": F.col("base")}).select(order)
    asked = met.withColumns(nothing | {"kind": F.lit(1)}).select(order)
    texts = (
        rows.withColumn("fine", _fine(p.seed, fine))
        .join(split, "source")
        .withColumns(no_slot | {"bucket": F.pmod("fine", "buckets"), "kind": F.lit(2), "order": F.xxhash64(F.lit(p.seed + 1), "doc_id", "text"), "index": F.lit(None).cast("long")})
        .select(order)
    )
    every = by_keys(begin.unionByName(asked).unionByName(texts), size_of_all, "source", "bucket").sortWithinPartitions("source", "bucket", "kind", "order", "doc_id", "text")
    return every.mapInArrow(_packer(p.block_tokens), BLOCKS)


def mix_documents(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """``mix`` with the columns of ``docs``: each row is a block. Columns that a block has no value for are null."""
    mixed = mix(docs, p)
    return mixed.select(*[F.col(c).cast(t).alias(c) if c in mixed.columns else F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
