import json
import random

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from knotwork.llm import bpe

ALPHABET = list("ab  \n\t'stmdlrve.,!1é中٣ 　😀") + ["'s", "'ll", "'ve ", " '", "''s", "  ", "\r\n"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(n)]


def test_split_is_the_pattern():
    for seed in range(60):
        rows = texts(30, seed)
        at, raw = bpe.buffers(pa.array(rows))
        begin = bpe.split_starts(raw, at)
        end = np.append(begin[1:], len(raw))
        words = [raw[i:j].tobytes().decode() for i, j in zip(begin, end)]
        of = np.searchsorted(begin, at)
        assert [words[of[i] : of[i + 1]] for i in range(len(rows))] == [regex.findall(bpe.PATTERN, t) for t in rows]


def test_transducer_is_exact_and_minimal():
    words = sorted({w.encode() for w in "tap taps top tops stop stops rap raps at a s".split()})
    lexicon = bpe.Lexicon(bpe.compile_lexicon([(w, [i, i + 1]) for i, w in enumerate(words)]))
    asked = [*words, b"", b"ta", b"tapss", b"zebra", b"stopst"]
    raw = np.frombuffer(b"".join(asked), np.uint8)
    end = np.cumsum([len(w) for w in asked])
    number = lexicon.find(raw, end - [len(w) for w in asked], end)
    assert number.tolist() == [*range(len(words)), -1, -1, -1, -1, -1]
    assert [lexicon.pool[lexicon.offsets[i] : lexicon.offsets[i + 1]].tolist() for i in range(len(words))] == [[i, i + 1] for i in range(len(words))]
    suffixes = {}  # as many states as there are different sets of suffixes
    for w in words:
        for i in range(len(w) + 1):
            suffixes.setdefault(w[:i], set()).add(w[i:])
    assert lexicon.states == len({frozenset(s) for s in suffixes.values()})


def test_ids_are_those_of_another_library(make):
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rows = [*texts(200, 5), "The <|endoftext|> isn't special; we'll see.\n\n  Été à Köln 12345 💡", "x" * 3000]
    found = {r["doc_id"]: r for r in bpe.encode(make(list(enumerate(rows)))).collect()}
    for i, text in enumerate(rows):
        assert found[i]["token_ids"] == other.encode(text, add_special_tokens=False).ids, json.dumps(text)
        assert found[i]["round_trip"] and found[i]["n_tokens"] == len(found[i]["token_ids"])
        assert bpe.decode(found[i]["token_ids"]) == text


def test_lexicon_never_changes_a_result(make, prose):
    docs = make([(i, prose(i)) for i in range(20)])
    few, many = (sorted(map(str, bpe.encode(docs, bpe.BpeParams(lexicon_words=n)).collect())) for n in (3, 5000))
    assert few == many


def test_word_counts(make):
    counted = {bytes(r["word"]): r["n"] for r in bpe.word_counts(make([(1, "a b a"), (2, "a b"), (3, None), (4, "")])).collect()}
    assert counted == {b"a": 2, b" b": 2, b" a": 1}


def test_messy_rows(messy):
    rows = bpe.encode(messy).collect()
    assert len(rows) == messy.count()
    assert all(r["token_ids"] is None and r["n_tokens"] is None for r in rows if r["doc_id"] == 3)
    assert [r["token_ids"] for r in rows if r["doc_id"] == 4] == [[]]
    assert all(r["round_trip"] in (True, None) for r in rows)
    back = bpe.decode_tokens(bpe.encode(messy)).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in back))) == sorted(map(str, ((r["doc_id"], r["text"]) for r in messy.collect())))


def test_empty_table(make):
    assert bpe.encode(make([])).count() == 0


def test_a_very_long_word_of_many_merges(make):
    rng = random.Random(2)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöß", k=400_000))
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    found = {r["doc_id"]: r for r in bpe.encode(make([(1, word), (2, word[:20_000])])).collect()}
    assert found[2]["token_ids"] == other.encode(word[:20_000], add_special_tokens=False).ids
    assert found[1]["round_trip"] and bpe.decode(found[1]["token_ids"]) == word
