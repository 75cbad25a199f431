import random

import pyarrow as pa

from knotwork.llm import langid as L

PARTS = {"aa": "ka lo mi tu re sa no".split(), "bb": "sch wer tz ung ich eff orn".split(), "cc": "éa çou èle ñio ría ués ção".split()}


def text(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(n))


def labelled(n=40):
    return [(k * 1000 + i, text(lang, i), lang) for k, lang in enumerate(PARTS) for i in range(n)]


def model():
    rows = labelled()
    return L.fit([r[1] for r in rows], [r[2] for r in rows])


def test_held_out_accuracy():
    m = model()
    rows = [(lang, text(lang, i)) for lang in PARTS for i in range(1000, 1100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    found = pa.Table.from_batches(L._labeller(m)([batch])).to_pylist()
    assert sum(f["language"] == lang for f, (lang, _) in zip(found, rows)) / len(rows) > 0.99
    assert all(f["accepted"] for f in found)


def test_spans_of_mixed_text():
    m = model()
    a, b = text("aa", 7), text("bb", 7)
    whole = f"{a} {b}. {a}"
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([whole])], names=["doc_id", "text"])
    spans = pa.Table.from_batches(L._labeller(m)([batch])).to_pylist()[0]["spans"]
    assert [s["language"] for s in spans] == ["aa", "bb", "aa"] and [s["words"] for s in spans] == [60, 60, 60]
    assert [whole[s["start"] : s["stop"]] for s in spans] == [a, b, a]


def test_viterbi_is_the_best_labelling():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    scores = rng.normal(size=(17, 3)) * 3
    at = np.array([0, 6, 6, 7, 12, 17])
    got = L.viterbi(scores, at, 2.0)
    for i, j in zip(at, at[1:]):
        value = lambda path: sum(scores[i + k, s] for k, s in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        best = max(map(value, itertools.product(range(3), repeat=j - i)), default=0)
        assert abs(value(got[i:j].tolist()) - best) < 1e-9


def test_scripts_narrow_candidates(make):
    rows = {r["doc_id"]: r for r in L.identify(make([(1, "привет мир как дела"), (2, "你好世界"), (3, text("aa", 5))]), model=model()).collect()}
    assert rows[1]["language"] == rows[2]["language"] == "und" and rows[3]["language"] == "aa"


def test_trained_in_place_and_messy(make, messy):
    docs = make(labelled(25), clash=True)
    noise = make([(90000, "qqq xxx zzz www jjj vvv" * 20, None), (90001, None, "aa"), (90002, "", "bb"), (90003, "123 !!", "cc"), (None, text("cc", 1), None)], clash=True)
    every = docs.unionByName(noise)
    found = L.identify(every).collect()
    assert len(found) == 80 and {r["doc_id"] for r in found if not r["accepted"]} == {90000, 90001, 90002, 90003}
    kept = L.keep_known(every)
    assert kept.columns == every.columns and kept.count() == 76 and kept.schema == every.schema
    assert L.identify(messy).count() == messy.count()


def test_empty_table(make):
    assert L.identify(make([])).count() == 0 and L.keep_known(make([])).count() == 0


def test_foreign_languages_go_though_the_sample_holds_mixed_and_junk_documents():
    foreign = "kari molu teka resu nalo misa tolu".split()  # of letters and some syllables of aa
    rng = random.Random(3)
    sample = labelled(120)
    sample += [(9000 + i, text("aa", 500 + i, 30) + " " + text("bb", 500 + i, 30), "aa") for i in range(9)]
    sample += [(9500 + i, " ".join("".join(rng.choices("qxzjvwkpy", k=6)) for _ in range(40)), "aa") for i in range(3)]
    m = L.fit([r[1] for r in sample], [r[2] for r in sample])
    prose = [" ".join(a + b for a, b in zip(rng.choices("vop gim dax fyl hub jeq".split(), k=60), rng.choices(foreign, k=60))) for _ in range(30)]
    rows = prose + [text("aa", 2000 + i, 30) + " " + text("cc", 2000 + i, 30) for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["doc_id", "text"])
    found = pa.Table.from_batches(L._labeller(m)([batch])).to_pylist()
    assert not any(f["accepted"] for f in found[:30])
    assert all(f["known_share"] > 0.95 for f in found[30:])


def test_two_hundred_languages():
    import numpy as np

    states = 201
    scores = np.full((40, states), -50.0)
    for word, best in enumerate([180] * 20 + [130] * 20):
        scores[word, best] = -1
    assert L.viterbi(scores, np.array([0, 40]), 12.0).tolist() == [180] * 20 + [130] * 20
    names = [f"l{i:03}" for i in range(200)]
    m = L.Model(names, np.full((64, 200), -9.0, np.float32), np.ones((len(L.SCRIPTS), 200), bool), -20.0, L.LanguageParams(buckets=64))
    m.logs[:, 180] = -1
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])] + [pa.array(["ab cd ef", ""])], names=["doc_id", "text"])
    assert [f["language"] for f in pa.Table.from_batches(L._labeller(m)([batch])).to_pylist()] == ["l180", "und"]


def plain_labels(text, m):
    """(label of each word, (begin, end) of each word) by loops over characters, n-grams and all pairs of labels."""
    words, at = [], 0
    letter = lambda c: c.isascii() and c.isalpha() or not c.isascii()
    lowered = "".join(c.lower()[0] for c in text)
    while at < len(lowered):
        stop = at
        while stop < len(lowered) and letter(lowered[stop]):
            stop += 1
        if stop > at:
            words.append((at, stop))
        at = max(stop, at + 1)
    table = []
    for begin, end in words:
        word = lowered[begin:end]
        script = next((name for low, high, name in L.RANGES if low <= ord(word[0]) <= high), "Zyyy")
        padded = b" " + word.encode() + b" "
        found = []
        for n in m.params.grams:
            for i in range(len(padded) - n + 1):
                x = (int.from_bytes(padded[i : i + n], "big") + (n << 56)) & (2**64 - 1)
                x ^= x >> 30
                x = x * 0xBF58476D1CE4E5B9 & (2**64 - 1)
                x ^= x >> 27
                x = x * 0x94D049BB133111EB & (2**64 - 1)
                found.append((x ^ (x >> 31)) & (m.params.buckets - 1))
        row = [sum(float(m.logs[g, k]) for g in found) if m.allowed[L.SCRIPTS.index(script), k] else -1e6 for k in range(len(m.languages))]
        table.append([*row, len(found) * m.unknown])
    best, came = [], []
    for word in table:
        if not best:
            best = list(word)
            continue
        steps = [max(range(len(word)), key=lambda a: best[a] - (a != b) * m.params.switch) for b in range(len(word))]
        best, came = [best[a] - (a != b) * m.params.switch + word[b] for b, a in enumerate(steps)], [*came, steps]
    if not table:
        return [], words
    labels = [max(range(len(best)), key=best.__getitem__)]
    for steps in reversed(came):
        labels.insert(0, steps[labels[0]])
    return [[*m.languages, "und"][k] for k in labels], words


def test_identify_against_plain_loops(make):
    m = model()
    rng = random.Random(8)
    junk = ["привет мир", "12 !", "qxz wvk " * 9, "İo"]
    rows = [(i, " ".join(rng.choice([text("aa", i, 9), text("bb", i, 14), text("cc", i, 8), *junk]) for _ in range(3))) for i in range(60)]
    rows += [(60, ""), (61, None), (62, text("aa", 5, 3000))]
    found = {r["doc_id"]: r for r in L.identify(make(rows), model=m).collect()}
    for doc_id, whole in rows:
        labels, words = plain_labels(whole or "", m)
        got = found[doc_id]
        assert got["n_words"] == len(words)
        spread = [s["language"] for s in got["spans"] for _ in range(s["words"])]
        assert spread == labels
        first = 0
        for s in got["spans"]:
            assert (s["start"], s["stop"]) == (words[first][0], words[first + s["words"] - 1][1])
            first += s["words"]
        known = [x for x in labels if x != "und"]
        share = len(known) / max(1, len(labels))
        assert abs(got["known_share"] - share) < 1e-9 and got["accepted"] == (bool(labels) and share >= m.params.accept)
        tally = {name: known.count(name) for name in m.languages}
        assert got["language"] == (max(tally, key=tally.get) if got["accepted"] else "und")
