"""Language of spans of text: scripts narrow the candidates, n-grams score words, Viterbi with a switching penalty labels.

The model is fitted on a bounded sample of labelled rows (``per_language`` documents of each language): byte n-grams of
words, and a score for "no known language" set below what all but a few held-out documents of the sample reach.

Scale: one scan of (doc_id, lang) picks the sample, whose texts are the only rows that reach the driver; the model is a
few hundred kilobytes. Labelling has no shuffle: words are scored once per slice, and the Viterbi steps of all documents
of a slice run side by side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.llm._text import BASE, INVERSE, batches, buffers, cached_powers, mix, slices

LABELS = (
    "doc_id long, language string, accepted boolean, known_share double, n_words int, "
    "spans array<struct<language:string,start:int,stop:int,words:int>>"
)
UNKNOWN = "und"
#: Scripts by ranges of code points; a word has the script of its first character, ASCII and accented letters are Latin.
SCRIPTS = ("Latn", "Grek", "Cyrl", "Armn", "Hebr", "Arab", "Deva", "Beng", "Taml", "Thai", "Geor", "Hang", "Kana", "Hani", "Zyyy")
RANGES = (
    (0x41, 0x24F, "Latn"),
    (0x370, 0x3FF, "Grek"),
    (0x400, 0x52F, "Cyrl"),
    (0x531, 0x58F, "Armn"),
    (0x591, 0x5F4, "Hebr"),
    (0x600, 0x77F, "Arab"),
    (0x900, 0x97F, "Deva"),
    (0x980, 0x9FF, "Beng"),
    (0xB80, 0xBFF, "Taml"),
    (0xE00, 0xE7F, "Thai"),
    (0x10A0, 0x10FF, "Geor"),
    (0x1100, 0x11FF, "Hang"),
    (0x1E00, 0x1EFF, "Latn"),
    (0x1F00, 0x1FFF, "Grek"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x9FFF, "Hani"),
    (0xAC00, 0xD7AF, "Hang"),
    (0xFB50, 0xFDFF, "Arab"),
)


@dataclass(frozen=True)
class LanguageParams:
    """per_language: documents of each language in the sample, at most. buckets: of hashed n-grams. switch: cost of a new
    label in the middle of a text, in nats. worst: share of held-out documents that may be junk. slack: nats an n-gram below
    the others at which a word is better taken as of no known language. accept: least share of words in known languages."""

    per_language: int = 300
    buckets: int = 1 << 15
    grams: tuple[int, ...] = (2, 3, 4)
    switch: float = 12.0
    worst: float = 0.05
    slack: float = 1.5
    accept: float = 0.3
    seed: int = 5


LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _script_table() -> tuple[np.ndarray, np.ndarray]:
    edges, kinds = [0], [SCRIPTS.index("Zyyy")]
    for low, high, name in RANGES:
        edges += [low, high + 1]
        kinds += [SCRIPTS.index(name), SCRIPTS.index("Zyyy")]
    return np.array(edges), np.array(kinds)


SCRIPT_EDGES, SCRIPT_KINDS = _script_table()


def find_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of runs of letters; rows begin at ``at``."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = LETTERS[raw]
    edge = np.zeros(len(raw) + 1, dtype=np.int8)
    edge[:-1] += inside
    edge[1:] -= inside
    begin, end = edge == 1, edge == -1
    first = at[1:-1]
    first = first[(first > 0) & (first < len(raw))]
    cut = first[inside[first] & inside[first - 1]]
    begin[cut] = end[cut] = True
    return np.flatnonzero(begin), np.flatnonzero(end)


def scripts(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Script of the character that each word begins with."""
    padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
    head = padded[begin]
    n = 1 + (head >= 0xC0) + (head >= 0xE0) + (head >= 0xF0)
    point = np.where(n == 1, head, np.where(n == 2, head & 0x1F, np.where(n == 3, head & 0x0F, head & 0x07)))
    for j in range(1, 4):
        point = np.where(n > j, (point << 6) | (padded[begin + j] & 0x3F), point)
    return SCRIPT_KINDS[np.searchsorted(SCRIPT_EDGES, point, side="right") - 1]


def grams(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, p: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, how many each word has): n-grams of the words' bytes with a blank on either side."""
    size = end - begin + 2
    stop = np.cumsum(size)
    if not len(stop):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    source = np.arange(stop[-1]) + np.repeat(begin - 1 - (stop - size), size)
    letters = raw[np.clip(source, 0, len(raw) - 1)].astype(np.uint64)
    letters[stop - 1] = letters[stop - size] = 32
    ends = np.repeat(stop, size)
    place = np.arange(stop[-1])
    owner = np.repeat(np.arange(len(begin)), size)
    found, owners = [], []
    code = letters.copy()
    for n in range(2, max(p.grams) + 1):
        code[: len(code) - n + 1] = (code[: len(code) - n + 1] << np.uint64(8)) | letters[n - 1 :]
        if n in p.grams:
            ok = place + n <= ends
            found.append((mix(code[ok] + np.uint64(n << 56)) & np.uint64(p.buckets - 1)).astype(np.int64))
            owners.append(owner[ok])
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return found[order], np.bincount(owners, minlength=len(begin))


@dataclass
class Model:
    """logs: buckets x languages. allowed: scripts x languages. unknown: log-probability of an n-gram of none."""

    languages: list[str]
    logs: np.ndarray
    allowed: np.ndarray
    unknown: float
    params: LanguageParams

    def word_scores(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """words x (languages, none): log-probabilities; impossible ones are very low."""
        out = np.full((len(begin), len(self.languages) + 1), -1e6, np.float32)
        if not len(begin):
            return out
        for i in range(0, len(begin), 8192):  # n-grams take more room than the words they are of
            part = slice(i, i + 8192)
            found, n = grams(raw, begin[part], end[part], self.params)
            first = np.cumsum(n) - n
            for k in range(len(self.languages)):
                out[part, k] = np.add.reduceat(self.logs[found, k], first)
            out[part, -1] = n * self.unknown
        out[:, :-1][~self.allowed[scripts(raw, begin)]] = -1e6
        return out


def fit(texts: list[str], languages: list[str], p: LanguageParams = LanguageParams()) -> Model:
    """Fit on labelled texts: every third text of a language is held out to set the score of "none"."""
    names = sorted(set(languages))
    counts = np.full((p.buckets, len(names)), 0.5)
    allowed = np.zeros((len(SCRIPTS), len(names)), dtype=bool)
    held: list[str] = []
    for k, name in enumerate(names):
        own = [t for t, x in zip(texts, languages) if x == name]
        used = np.zeros(len(SCRIPTS))
        for i, text in enumerate(own):
            if i % 3 == 2:
                held.append(text)
                continue
            at, raw = buffers(pc.utf8_lower(pa.array([text])))
            begin, end = find_words(raw, at)
            if len(begin):
                found, _ = grams(raw, begin, end, p)
                counts[:, k] += np.bincount(found, minlength=p.buckets)
                used += np.bincount(scripts(raw, begin), minlength=len(SCRIPTS))
        allowed[:, k] = used > 0.05 * max(1, used.sum())
    model = Model(names, np.log(counts / counts.sum(axis=0)).astype(np.float32), allowed, -1e3, p)
    means = []
    for text in held:
        at, raw = buffers(pc.utf8_lower(pa.array([text])))
        begin, end = find_words(raw, at)
        if len(begin) >= 20:
            _, n = grams(raw, begin, end, p)
            best = model.word_scores(raw, begin, end)[:, :-1].max(axis=1)  # texts in two languages are not junk
            known = best > -1e6
            if known.any():
                means.append(float(best[known].sum() / n[known].sum()))
    model.unknown = (float(np.quantile(means, p.worst)) if means else float(np.log(0.5 / p.buckets))) - p.slack
    return model


def label_type(states: int) -> np.dtype:
    """The least integer type that numbers so many labels."""
    return np.min_scalar_type(-max(states, 2))


FEW = 24  # values of a step below which arrays cost more than they spare
PIECE = 4096  # words of a long row that are plain numbers at once


def _step_by_step(value: list[float], scores: list[list[float]], switch: float) -> tuple[list[list[int]], list[float]]:
    """(where each label of each word came from, the last word's values) of one row, from its values so far."""
    came = []
    states = range(len(value))
    for word in scores:
        best = max(value)
        top, at = best - switch, value.index(best)
        came.append([at if value[k] < top else k for k in states])
        value = [(top if x < top else x) + y for x, y in zip(value, word)]
    return came, value


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word of every row; row i has words at[i]:at[i + 1].

    The steps of all rows run side by side; when only a few long rows are left, each is finished on its own.
    """
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    n, first = n[order], at[:-1][order]
    states = scores.shape[1]
    small = label_type(states)
    label = np.zeros(len(scores), small)
    if not len(n) or not n[0]:
        return label
    back = np.empty((len(scores), states), small)
    own = np.arange(states, dtype=small)
    active = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # rows longer than t
    value = scores[first[: active[0]]].astype(np.float64)
    final = np.zeros((len(n), states))
    together = int(n[0])  # words of a row that are taken side by side with others
    for t in range(1, int(n[0])):
        live = active[t]
        if live < len(value):
            final[live : len(value)] = value[live:]
            value = value[:live]
        if live * states <= FEW:
            together = t
            break
        word = first[:live] + t
        best = value.argmax(axis=1)
        top = value[np.arange(live), best] - switch
        move = value < top[:, None]
        back[word] = np.where(move, best[:, None].astype(small), own)
        value = np.where(move, top[:, None], value) + scores[word]
    final[: len(value)] = value
    state = np.zeros(len(n), small)
    for row in range(int(active[together]) if together < n[0] else 0):
        begins = range(int(first[row]) + together, int(first[row] + n[row]), PIECE)
        stop, now_value = int(first[row] + n[row]), final[row].tolist()
        for i in begins:
            part = slice(i, min(i + PIECE, stop))
            back[part], now_value = _step_by_step(now_value, scores[part].astype(np.float64).tolist(), switch)
        now = now_value.index(max(now_value))
        for i in reversed(begins):
            part, found = slice(i, min(i + PIECE, stop)), []
            for step in reversed(back[part].tolist()):
                found.append(now)
                now = step[now]
            label[part] = found[::-1]
        state[row] = now
    done = int(active[together]) if together < n[0] else 0
    state[done:] = final[done:].argmax(axis=1)
    for t in range(together - 1, -1, -1):
        live = active[t]
        word = first[:live] + t
        label[word] = state[:live]
        if t:
            state[:live] = back[word, state[:live]]
    return label


def label_rows(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label of each word, where each row's words begin, begin and end of each word in characters of all rows, rows' begins)."""
    at, raw = buffers(pc.utf8_lower(texts))
    begin, end = find_words(raw, at)
    rows = np.searchsorted(begin, at)
    if not len(begin):
        return np.zeros(0, np.int64), rows, begin, end, np.zeros(len(at), np.int64)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * cached_powers(BASE, len(raw)), out=total[1:])
    names = (total[end] - total[begin]) * cached_powers(INVERSE, len(raw) + 1)[begin]
    _, first, of = np.unique(mix(names), return_index=True, return_inverse=True)
    scores = model.word_scores(raw, begin[first], end[first])[of]
    label = viterbi(scores, rows, model.params.switch)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return label, rows, chars[begin], chars[end], chars[at]


def _labeller(model: Model):
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    none = len(model.languages)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            for i, j in slices(batch["text"], 2 << 20):
                texts = batch["text"].slice(i, j - i)
                label, rows, begin, end, base = label_rows(texts, model)
                n = np.diff(rows)
                owner = np.repeat(np.arange(len(n)), n)
                tally = np.bincount(owner * (none + 1) + label, minlength=len(n) * (none + 1)).reshape(len(n), none + 1)
                known = tally[:, :none].sum(axis=1)
                best = tally[:, :none].argmax(axis=1) if none else np.zeros(len(n), int)
                share = known / np.maximum(n, 1)
                accepted = (n > 0) & (share >= model.params.accept)
                language = np.where(accepted, best, none)
                new = np.ones(len(label), dtype=bool)
                new[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
                start = np.flatnonzero(new)
                stop = np.append(start[1:], len(label)) if len(start) else start
                spans = pa.StructArray.from_arrays(
                    [
                        pa.array(names[label[start]], pa.string()),
                        pa.array(begin[start] - base[owner[start]], pa.int32()),
                        pa.array(end[stop - 1] - base[owner[start]], pa.int32()),
                        pa.array(stop - start, pa.int32()),
                    ],
                    names=["language", "start", "stop", "words"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(i, j - i),
                        pa.array(names[language], pa.string()),
                        pa.array(accepted),
                        pa.array(share),
                        pa.array(n, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(start, rows).astype(np.int32)), spans),
                    ],
                    names=["doc_id", "language", "accepted", "known_share", "n_words", "spans"],
                )

    return run


def train(docs: DataFrame, p: LanguageParams = LanguageParams()) -> Model:
    """Fit on at most ``per_language`` labelled documents of each language, picked by a hash of their ids."""
    labelled = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id")
    )
    pick = F.xxhash64(F.lit(p.seed), "doc_id")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(pick, "doc_id"))
    chosen = labelled.distinct().withColumn("r", rank).where(F.col("r") <= p.per_language).select("lang", "doc_id").collect()
    if not chosen:
        return fit([], [], p)
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r["lang"], r["doc_id"]) for r in chosen], "lang string, doc_id long"))  # bounded by the parameter
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = rows.where("text is not null").alias("d").join(wanted.alias("w"), F.expr("d.lang = w.lang and d.doc_id <=> w.doc_id"), "left_semi")
    found = sorted((r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in met.dropDuplicates(["lang", "doc_id"]).collect())
    return fit([r[3] for r in found], [r[0] for r in found], p)


def identify(docs: DataFrame, p: LanguageParams = LanguageParams(), model: Model | None = None) -> DataFrame:
    """(doc_id, language, accepted, known_share, n_words, spans) of every row of ``docs``.

    spans: runs of words of one label, with begin and end in characters of the text; 'und' labels words of no known
    language. language: the one with most words; 'und' if the row isn't accepted, that is if fewer than ``accept`` of its
    words are of known languages. Ties go to the language first by name. A null or empty text, or one without letters, has no
    words: language 'und', share 0, not accepted. Without labelled rows every word is 'und'. Repeated rows are labelled each.
    Other columns are ignored.
    """
    model = model or train(docs, p)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_labeller(model), LABELS)


def _keeper(model: Model):
    run = _labeller(model)

    def keep(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            for i, j in slices(batch["__text"], 2 << 20):
                part = batch.slice(i, j - i)
                slim = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part["__text"]], names=["doc_id", "text"])
                marks = pa.Table.from_batches(run([slim]))["accepted"].combine_chunks()
                yield part.drop_columns(["__text"]).filter(marks)

    return keep


def keep_known(docs: DataFrame, p: LanguageParams = LanguageParams(), model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, with all their columns. Rows without letters go."""
    model = model or train(docs, p)
    rows = docs.withColumn("__text", F.col("text").cast("string"))
    return rows.mapInArrow(_keeper(model), docs.schema)
