"""Byte-level BPE with a lexicon of frequent words: a minimal acyclic transducer in a memory-mapped file.

The corpus is counted word by word (a word is what the vocabulary's pattern splits off). The most frequent words are
compiled into a minimal automaton whose arcs carry numbers; their sum along a word is the word's number, which points at
its ids. The automaton is one file in the shared folder; workers map it and look up all distinct words of a slice at once.
Other words are merged by rank, so that the lexicon never changes a result. Texts are split by arithmetic on arrays of
character classes rather than by a regular expression.

Scale: one aggregation of (word, count) rows that each task has already summed; the lexicon is bounded by a parameter
that no result depends on. Encoding itself has no shuffle.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm._text import BASE, INVERSE, batches, buffers, cached_powers, mix, slices
from knotwork.operators.lineage import cut, release, save, scratch

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENS = "doc_id long, token_ids array<int>, n_tokens int, round_trip boolean"


@dataclass(frozen=True)
class BpeParams:
    """vocabulary: a rank file. lexicon_words: how many frequent words are compiled; only speed depends on it."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    lexicon_words: int = 1 << 16


# == splitting

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not 0x33480 <= c < 0xE0000 and c < 0xE1000]
        text, points = "".join(map(chr, points)), np.array(points)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                table[points[m.start() : m.end()]] = kind
        _classes.append(table)
    return _classes[0]


def byte_classes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of the character of each byte, and where characters begin."""
    table = classes()
    kind = table[:256][raw]
    lead = np.ones(len(raw), dtype=bool)
    high = np.flatnonzero(raw >= 0xC0)
    if len(high):
        lead = (raw & 0xC0) != 0x80
        head = raw[high].astype(np.int64)
        n = 1 + (head >= 0xC0) + (head >= 0xE0) + (head >= 0xF0)
        padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
        point = np.where(n == 2, head & 0x1F, np.where(n == 3, head & 0x0F, head & 0x07))
        for j in range(1, 4):
            point = np.where(n > j, (point << 6) | (padded[high + j] & 0x3F), point)
        of = table[np.minimum(point, 0x10FFFF)]
        for j in range(4):
            kind[high[n > j] + j] = of[n > j]
    return kind, lead


def split_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets where the words of the pattern begin, in all rows at once; rows begin at ``at``."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    kind, lead = byte_classes(raw)
    row = np.zeros(n + 1, dtype=bool)
    row[at] = True
    row[n] = True
    begin = np.zeros(n, dtype=bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= row[:n]
    white = kind == SPACE
    # the last character of a run of white space before a word: a blank joins the word, another one stands alone
    run = np.flatnonzero(begin & ~white)
    run = run[run > 0]
    run = run[white[run - 1] & ~row[run]]
    last = run - 1
    while True:
        back = ~lead[last]
        if not back.any():
            break
        last = last - back
    blank = raw[last] == 32
    begin[run[blank]] = False
    begin[last] = True
    # contractions, where an apostrophe begins a word of its own and letters follow
    quote = np.flatnonzero((raw == 39) & begin)
    quote = quote[(quote + 1 < n)]
    quote = quote[~row[quote + 1]] if len(quote) else quote
    if len(quote):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)])
        a, b = padded[quote + 1], padded[quote + 2]
        inside = ~row[np.minimum(quote + 2, n)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = inside & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        for hit, size in ((one, 2), (two & ~one, 3)):
            q = quote[hit]
            begin[q + 1] = False
            if size == 3:
                begin[q + 2] = False
            after = q + size
            after = after[after < n]
            begin[after] = True
            # a blank after the contraction that belongs to the next word stays its begin: it is white and begins there
    return np.flatnonzero(begin)


def word_ids(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word."""
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * cached_powers(BASE, len(raw)), out=total[1:])
    return mix((total[end] - total[begin]) * cached_powers(INVERSE, len(raw) + 1)[begin] + (end - begin).astype(np.uint64))


# == transducer


class Lexicon:
    """A minimal acyclic automaton in one array of 32-bit numbers: tables of next states and of arc numbers."""

    MAGIC = 0x4C455831

    def __init__(self, flat: np.ndarray) -> None:
        magic, states, width, words, pool = (int(x) for x in flat[:5])
        if magic != self.MAGIC:
            raise ValueError("not a lexicon")
        at = 5
        sizes = (256, states * width, states * width, states, words + 1, pool)
        parts = []
        for size in sizes:
            parts.append(flat[at : at + size])
            at += size
        self.letter, self.next, self.skip, self.final, self.offsets, self.pool = parts
        self.width = width
        self.words, self.states = words, states

    @classmethod
    def open(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, dtype=np.int32, mode="r"))

    def find(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each word raw[begin:end], or -1."""
        out = np.full(len(begin), -1, np.int64)
        if not self.words:
            return out
        live, state, number = np.arange(len(begin)), np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        at, stop = begin.astype(np.int64), end.astype(np.int64)
        while len(live):
            done = at == stop
            if done.any():
                ends = done & (self.final[state] > 0)
                out[live[ends]] = number[ends]
                go = ~done
                live, state, number, at, stop = live[go], state[go], number[go], at[go], stop[go]
                if not len(live):
                    break
            arc = state * self.width + self.letter[raw[at]]
            onward = self.next[arc]
            number = number + self.skip[arc]
            go = onward > 0  # no arc leads back to the start
            live, state, number, at, stop = live[go], onward[go].astype(np.int64), number[go], at[go] + 1, stop[go]
        return out


def compile_lexicon(words: list[tuple[bytes, list[int]]]) -> np.ndarray:
    """The automaton of distinct words with their ids; words are added in order and equal suffixes are shared at once."""
    words = sorted(words)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (parent, byte, child) not yet shared
    free: list[int] = []

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            shape = (final[child], tuple(arcs[child].items()))
            twin = known.get(shape)
            if twin is None:
                known[shape] = child
            else:
                arcs[parent][byte] = twin
                arcs[child] = {}
                free.append(child)

    before = b""
    for word, _ in words:
        common = len(os.path.commonprefix([word, before]))
        settle(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            if free:
                child = free.pop()
                final[child] = False
            else:
                child = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[state][byte] = child
            path.append((state, byte, child))
            state = child
        final[state] = True
        before = word
    settle(0)

    below: dict[int, int] = {}
    stack = [0]
    while stack:  # words below each state, children first
        state = stack[-1]
        todo = [c for c in arcs[state].values() if c not in below]
        if todo:
            stack.extend(todo)
            continue
        stack.pop()
        below[state] = final[state] + sum(below[c] for c in arcs[state].values())
    order = {0: 0} | {s: i + 1 for i, s in enumerate(s for s in below if s)}
    letters = sorted({b for s in below for b in arcs[s]})
    width = len(letters) + 1
    letter = np.zeros(256, np.int32)
    letter[letters] = np.arange(1, width)
    onward, skip = np.zeros((len(order), width), np.int32), np.zeros((len(order), width), np.int32)
    ends = np.zeros(len(order), np.int32)
    for state, i in order.items():
        ends[i] = final[state]
        number = int(final[state])
        for byte, child in sorted(arcs[state].items()):
            onward[i, letter[byte]], skip[i, letter[byte]] = order[child], number
            number += below[child]
    ids = [i for _, found in words for i in found]
    offsets = np.cumsum([0, *(len(found) for _, found in words)]).astype(np.int32)
    head = np.array([Lexicon.MAGIC, len(order), width, len(words), len(ids)], np.int32)
    return np.concatenate([head, letter, onward.reshape(-1), skip.reshape(-1), ends, offsets, np.array(ids, np.int32)])


# == vocabulary

_vocabularies: dict[str, Vocabulary] = {}


class Vocabulary:
    """Merges by rank, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        words = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        self.size = np.array([len(w) for w in words], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.words = words

    @classmethod
    def open(cls, path: str) -> Vocabulary:
        if path not in _vocabularies:
            _vocabularies[path] = cls(path)
        return _vocabularies[path]

    def encode(self, text: str) -> list[int]:
        """Ids of one text by the pattern itself: the plain way."""
        return [i for word in regex.findall(PATTERN, text) for i in self.merge(word.encode())]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids, all at once."""
        return gather(self.data, self.at[ids], self.size[ids])


def gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[begin[0] : begin[0] + size[0]], data[begin[1] : ...] ... in one array."""
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return data[:0]
    return data[np.repeat(begin - (total - size), size) + np.arange(total[-1])]


def decode(ids: list[int], vocabulary: str = BpeParams.vocabulary) -> str:
    """The text of a list of ids."""
    return Vocabulary.open(vocabulary).decode_bytes(np.asarray(ids, dtype=np.int64)).tobytes().decode("utf-8", "replace")


# == counting


def _word_counter(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of the task's texts with its count, summed slice by slice."""
    for batch in batches(parts):
        for i, j in slices(batch["text"], 1 << 20):
            at, raw = buffers(batch["text"].slice(i, j - i))
            begin = split_starts(raw, at)
            if not len(begin):
                continue
            end = np.append(begin[1:], len(raw))
            _, first, n = np.unique(word_ids(raw, begin, end), return_index=True, return_counts=True)
            size = end[first] - begin[first]
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            data = gather(raw, begin[first], size)
            word = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([word, pa.array(n)], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word of the pattern occurs in all texts; words are bytes."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_word_counter, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, p: BpeParams = BpeParams()) -> str:
    """Compile the most frequent words of ``docs``, ``lexicon_words`` at most, into a file of the shared folder; its path."""
    vocabulary = Vocabulary.open(p.vocabulary)
    counts = cut(word_counts(docs), "words")
    # counts fall into steps of a sixteenth of a doubling; the highest steps that fit are taken whole, so that no task sends
    # more than its share of the lexicon
    step = F.floor(F.log2("n") * 16)
    least, room = None, p.lexicon_words
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    top = [] if least is None else [r["word"] for r in counts.where(step >= least).select("word").collect()]
    release(counts)
    flat = compile_lexicon([(bytes(w), vocabulary.merge(bytes(w))) for w in top])
    path = scratch(docs.sparkSession, "lexicon")
    save(docs.sparkSession, path, flat.tobytes())
    return path


_lexicons: dict[str, Lexicon] = {}


def open_lexicon(path: str) -> Lexicon:
    """Map the file; one on a remote file system is fetched into the executor's working folder first."""
    if path not in _lexicons:
        local = path[5:] if path.startswith("file:") else path
        if "://" in local:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(local)
            local = f"{os.path.basename(inner)}.{os.getpid()}"
            with system.open_input_stream(inner) as source, open(local, "wb") as sink:
                while piece := source.read(8 << 20):
                    sink.write(piece)
        _lexicons.clear()
        _lexicons[path] = Lexicon.open("/" + local.lstrip("/") if path.startswith(("file:", "/")) else local)
    return _lexicons[path]


# == encoding


def encode_rows(texts: pa.Array, vocabulary: Vocabulary, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, where each row's ids begin, whether the row's ids give its bytes again)."""
    at, raw = buffers(texts)
    begin = split_starts(raw, at)
    end = np.append(begin[1:], len(raw)) if len(begin) else begin
    if not len(begin):
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64), np.ones(len(at) - 1, dtype=bool)
    _, first, of = np.unique(word_ids(raw, begin, end), return_index=True, return_inverse=True)
    number = lexicon.find(raw, begin[first], end[first])
    fresh = np.flatnonzero(number < 0)
    data = raw.tobytes()
    merged = [vocabulary.merge(data[i:j]) for i, j in zip(begin[first[fresh]].tolist(), end[first[fresh]].tolist())]
    extra = np.array([i for found in merged for i in found], np.int32)
    lengths = np.array([len(found) for found in merged], np.int64)
    hit = number >= 0
    where, size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    where[hit], size[hit] = lexicon.offsets[number[hit]], lexicon.offsets[number[hit] + 1] - lexicon.offsets[number[hit]]
    where[fresh], size[fresh] = len(lexicon.pool) + np.cumsum(lengths) - lengths, lengths
    pool = np.concatenate([lexicon.pool, extra])
    ids = gather(pool, where[of], size[of])
    tokens = np.concatenate([[0], np.cumsum(size[of])])
    rows = tokens[np.searchsorted(begin, at)]
    back = vocabulary.decode_bytes(ids)
    if len(back) == len(raw):
        wrong = np.concatenate([[0], np.cumsum(back != raw)])
        good = wrong[at[1:]] == wrong[at[:-1]]
    else:
        made = np.concatenate([[0], np.cumsum(vocabulary.size[ids])])[rows]
        good = np.array([back[made[i] : made[i + 1]].tobytes() == data[at[i] : at[i + 1]] for i in range(len(at) - 1)])
    return ids, rows, good


def _encoder(path: str, vocabulary_path: str, more: tuple[str, ...] = ()):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, lexicon = Vocabulary.open(vocabulary_path), open_lexicon(path)
        for batch in batches(parts):
            for i, j in slices(batch["text"], 1 << 20):
                texts = batch["text"].slice(i, j - i)
                ids, rows, good = encode_rows(texts, vocabulary, lexicon)
                none = np.asarray(pc.is_null(texts))
                lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids, pa.int32()))
                if none.any():
                    lists = pc.if_else(pa.array(~none), lists, pa.nulls(len(lists), lists.type))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(i, j - i),
                        lists,
                        pa.array(np.diff(rows), pa.int32(), mask=none),
                        pa.array(good, mask=none),
                        *(batch[c].slice(i, j - i) for c in more),
                    ],
                    names=["doc_id", "token_ids", "n_tokens", "round_trip", *more],
                )

    return run


def encode(docs: DataFrame, p: BpeParams = BpeParams(), more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) of every row of ``docs``.

    token_ids are exactly what merging by rank gives for each word that the vocabulary's pattern splits off; text that
    looks like a special token is ordinary text. round_trip: the ids, decoded, are the text's bytes again. An empty text has no
    ids; a null text has null in the three. Repeated rows are encoded each. The string columns named in ``more`` are carried
    along, others ignored.
    """
    path = build_lexicon(docs, p)
    strings = [F.col(c).cast("string").alias(c) for c in ("text", *more)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *strings)
    return rows.mapInArrow(_encoder(path, p.vocabulary, more), TOKENS + "".join(f", {c} string" for c in more))


def _decoder(vocabulary_path: str):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.open(vocabulary_path)
        for batch in batches(parts):
            lists = batch["token_ids"]
            ids = np.asarray(lists.flatten()).astype(np.int64)
            rows = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))])
            made = np.concatenate([[0], np.cumsum(vocabulary.size[ids])])[rows]
            data = vocabulary.decode_bytes(ids).tobytes()
            none = np.asarray(pc.is_null(lists))
            texts = [None if none[i] else data[made[i] : made[i + 1]].decode("utf-8", "replace") for i in range(len(none))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_tokens(tokens: DataFrame, p: BpeParams = BpeParams()) -> DataFrame:
    """(doc_id, text) of rows with token_ids; null ids give a null text."""
    return tokens.select("doc_id", "token_ids").mapInArrow(_decoder(p.vocabulary), "doc_id long, text string")
