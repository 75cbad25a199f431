import itertools
from collections import Counter

import numpy as np
import pyarrow as pa

from knotwork.llm import fingerprints as Z


def test_gear_hash_by_doubling():
    raw = np.random.default_rng(0).integers(0, 256, 400).astype(np.uint8)
    table, h = Z.gear_table(7), 0
    got = Z.gear_hashes(raw, table)
    for i, byte in enumerate(raw):
        h = ((h << 1) + int(table[byte])) & 0xFFFFFFFF
        assert i < 31 or h == got[i]


def sets(texts, p=Z.ChunkParams()):
    digest, size, rows = Z.chunk_rows(pa.array(texts), p)
    return [digest[rows[i] : rows[i + 1]].tolist() for i in range(len(texts))]


def test_chunks_cover_rows_and_keep_their_bounds(prose):
    p = Z.ChunkParams()
    texts = [prose(i, 900) for i in range(20)] + ["", "short"]
    digest, size, rows = Z.chunk_rows(pa.array(texts), p)
    for i, text in enumerate(texts):
        own = size[rows[i] : rows[i + 1]]
        assert own.sum() == len(text) and (own[:-1] >= p.least).all() and (own <= p.most).all()
    assert 150 < np.mean(size) < 450
    assert sets(texts[3:4]) == sets(texts)[3:4]  # a row's chunks depend on that row alone


def test_shifts_leave_chunks(prose):
    text = prose(3, 2000)
    a, b = map(set, sets([text, "some words before it. " + text]))
    assert len(a & b) / len(a) > 0.9


def brute(rows, threshold):
    names, own = {}, {i: frozenset(s) for (i, _), s in zip(rows, sets([t for _, t in rows])) if s}
    for i, s in own.items():
        names[s] = min(i, names.get(s, i))
    found = set()
    weight = lambda s: sum(x & 0xFFFF for x in s)
    for i, s in own.items():
        if names[s] != i:
            found.add((i, names[s], 1.0))
        found |= {(i, n, weight(s & o) / weight(s)) for o, n in names.items() if o != s and weight(s & o) >= threshold * weight(s)}
    return found


def test_containment_matches_brute_force(make, prose):
    rows = []
    for i in range(12):
        text = prose(i, 800)
        rows += [(10 * i, text), (10 * i + 1, text), (10 * i + 2, text[: len(text) // 2]), (10 * i + 3, prose(100 + i, 100) + " " + text), (10 * i + 4, text[:1500] + prose(200 + i, 400))]
    rows += [(900 + i, prose(500, 50)) for i in range(5)] + [(950, "a"), (951, "a"), (952, prose(500, 50) + prose(501, 900))]
    got = {(r["doc_id"], r["container_id"], r["containment"]) for r in Z.containment(make(rows)).collect()}
    assert got == brute(rows, 0.8) and len(got) > 30


def test_messy_rows(messy, make):
    found = {(r["doc_id"], r["container_id"], r["containment"]) for r in Z.containment(messy).collect()}
    assert {(2, 1, 1.0), (None, 1, 1.0)} <= found and all(d not in (3, 4) for d, _, _ in found)
    assert Z.containment(make([])).count() == 0


def held(inner, outer, p):
    a, b = map(set, sets([inner, outer], p))
    return sum(x & 0xFFFF for x in a & b) / sum(x & 0xFFFF for x in a)


def word_grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def edited(text, seed, edits=2):
    words = text.split()
    rng = np.random.default_rng(seed)
    for i in rng.choice(len(words), edits, replace=False):
        words[i] = "changed"
    return " ".join(words)


def test_recall_of_embedded_and_edited_documents(prose):
    inside, changed = [], []
    for i in range(100):
        text = prose(1000 + i, 150 + i)  # about 1000 to 1700 characters
        around = prose(5000 + i, 300)
        middle = around.index(" ", len(around) // 2)
        inside.append(held(text, around[:middle] + " " + text + around[middle:], Z.FINE) >= Z.FINE.threshold)
        other = edited(text, i)
        a, b = word_grams(text), word_grams(other)
        assert len(a & b) >= 0.9 * len(a)
        changed.append(held(text, other, Z.FINE) >= Z.FINE.threshold)
    assert np.mean(inside) >= 0.97 and np.mean(changed) >= 0.97


def test_query_finds_an_embedded_document(spark, make, prose, tmp_path):
    from knotwork.llm.queries import op7_fingerprints

    text = prose(1, 190)
    make([(1, text), (2, prose(2, 200) + " " + text + " " + prose(3, 200)), (3, edited(text, 4))]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r for r in op7_fingerprints(spark, str(tmp_path)).collect() if r["container_class_id"] is not None]
    found = {(r["doc_id"], r["container_id"]) for r in rows}
    found |= {(r["container_id"], r["doc_id"]) for r in rows if r["shared_bytes"] >= 0.8 * r["container_bytes"]}
    assert {(1, 2), (1, 3), (3, 1)} <= found


def plain_chunks(data, p):
    """(digest, length) of each chunk of a text by one loop over its bytes."""
    table, bits, out, begin = Z.gear_table(p.seed), p.usual.bit_length() - 1, [], 0
    mask = lambda n: ((1 << n) - 1) << (32 - n)
    while begin < len(data):
        stop = min(len(data), begin + p.most)
        for i in range(begin, stop):
            size = i - begin + 1
            if size < p.least:
                continue
            h = 0
            for byte in data[i - p.window + 1 : i + 1]:
                h = ((h << 1) + int(table[byte])) & 0xFFFFFFFF
            h = (h << (32 - p.window)) & 0xFFFFFFFF
            if h & mask(bits + p.normal if size < p.usual else bits - p.normal) == 0:
                stop = i + 1
                break
        out.append(data[begin:stop])
        begin = stop
    return out


def test_boundaries_against_a_plain_loop(prose):
    rng = np.random.default_rng(4)
    texts = [prose(i, 400) for i in range(6)] + ["", "x", "y" * 5000, bytes(rng.integers(97, 105, 3000).astype(np.uint8)).decode()]
    for p in (Z.FINE, Z.ChunkParams()):
        digest, size, rows = Z.chunk_rows(pa.array(texts), p)
        names = {}
        for i, text in enumerate(texts):
            want = plain_chunks(text.encode(), p)
            assert size[rows[i] : rows[i + 1]].tolist() == [len(c) for c in want]
            for d, c in zip(digest[rows[i] : rows[i + 1]].tolist(), want):
                assert names.setdefault(c, d) == d  # equal chunks have equal digests
        assert len(set(names.values())) == len(names)


def test_fine_containment_of_hot_chunks_matches_brute_force(make, prose):
    shared = prose(700, 120)
    rows = [(i, f"{shared} {prose(i, 30 + i % 5)}") for i in range(60)] + [(100 + i, edited(prose(3, 300), i, 1 + i % 9)) for i in range(30)]
    rows += [(200, shared), (None, shared), (201, shared), (201, shared), (202, "")]
    got = {(r["doc_id"], r["container_id"], r["containment"]) for r in Z.containment(make(rows), Z.FINE).collect()}
    names, own = {}, {}
    for (i, _), s in zip(rows, sets([t for _, t in rows], Z.FINE)):
        if s:
            names.setdefault(frozenset(s), []).append(i)
            own.setdefault((i, frozenset(s)))
    weight = lambda s: sum(x & 0xFFFF for x in s)
    least = {s: min(i for i in ids if i is not None) for s, ids in names.items()}
    want = {(i, least[s], 1.0) for i, s in own if least[s] != i}
    want |= {(i, least[o], weight(s & o) / weight(s)) for i, s in own for o in names if o != s and weight(s & o) >= 0.8 * weight(s)}
    assert got == want and len(want) > 200


def plain_links(rows, p):
    """(ids of each class, {the ids of two classes: bytes shared, of the shorter, of the longer}) by comparing all with all."""
    classes, weight = {}, lambda s: sum(x & 0xFFFF for x in s)
    for (i, _), s in zip(rows, sets([t or "" for _, t in rows], p)):
        if s:
            classes.setdefault(frozenset(s), set()).add(i)
    found = {}
    for a, b in itertools.combinations(classes, 2):
        less, more = sorted([weight(a), weight(b)])
        if weight(a & b) >= p.threshold * less:
            found[frozenset([frozenset(classes[a]), frozenset(classes[b])])] = (weight(a & b), less, more)
    return sorted(map(sorted, classes.values())), found


def read_links(rows):
    """The same of the query's rows, of which no two may be alike."""
    own, links = [r for r in rows if r["container_class_id"] is None], [r for r in rows if r["container_class_id"] is not None]
    classes = {}
    for r in own:
        classes.setdefault(r["class_id"], set()).add(r["doc_id"])
    assert len(own) == sum(map(len, classes.values()))
    found = {}
    for r in links:
        inner, outer = classes[r["class_id"]], classes[r["container_class_id"]]
        assert (r["doc_id"], r["container_id"]) == (min(inner), min(outer)) and r["containment"] == r["shared_bytes"] / r["total_bytes"]
        found[frozenset([frozenset(inner), frozenset(outer)])] = (r["shared_bytes"], r["total_bytes"], r["container_bytes"])
    assert len(found) == len(links)
    return sorted(map(sorted, classes.values())), found


def test_query_lists_documents_once_and_links_of_classes_once(spark, make, prose, tmp_path):
    from knotwork.llm.queries import op7_fingerprints

    variants = [edited(prose(9, 300), i, 1 + i % 7) for i in range(20)]
    rows = [(100 * i + k, v) for i, v in enumerate(variants) for k in range(1 + i % 4 * 5)]
    rows += [(5000 + k, prose(k, 200) + " " + variants[0] + " " + prose(50 + k, 200)) for k in range(4)]  # hold, and aren't held
    rows += [(6000 + k, prose(500 + k, 150)) for k in range(30)] + [(7000, ""), (7001, None)]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = op7_fingerprints(spark, str(tmp_path)).collect()
    want = plain_links(rows, Z.FINE)
    assert read_links(got) == want
    assert len(want[1]) > 150 and any(s < 0.8 * more for s, _, more in want[1].values()) and any(s >= 0.8 * more for s, _, more in want[1].values())
    assert len(got) == len(rows) - 2 + len(want[1])


def test_copies_add_a_row_each(make, prose):
    variants = [edited(prose(9, 300), i) for i in range(6)]
    count = lambda n: Z.links(make([(n * i + k, v) for i, v in enumerate(variants) for k in range(n)]), Z.FINE).count()
    once = count(1)
    assert once > 6 and count(30) == 6 * 29 + once


def test_links_of_messy_rows(messy, make, prose):
    rows = Z.links(messy, Z.FINE).collect()
    own = [(r["doc_id"], r["class_id"]) for r in rows if r["container_class_id"] is None]
    assert Counter(d for d, _ in own) == Counter([1, 2, None, 5, 6, 7, 8, 8, 9])
    assert len({c for d, c in own if d in (1, 2, None)}) == 1 and len({c for _, c in own}) == 7
    assert Z.links(make([])).count() == 0
    unnamed = Z.links(make([(None, prose(9, 300)), (None, edited(prose(9, 300), 1)), (4, edited(prose(9, 300), 2))]), Z.FINE).collect()
    assert len(unnamed) == 6 and len({frozenset([r["class_id"], r["container_class_id"]]) for r in unnamed if r["container_class_id"] is not None}) == 3


def test_links_at_the_threshold_itself(spark):
    kinds = {"rare": 20, "x": 30, "y": 50, "z": 60, "w": 90}
    chunk = {k: (i << 16) | size for i, (k, size) in enumerate(kinds.items(), 1)}
    sets = {1: ["rare", "x", "y"], 2: ["x", "y", "z"], 3: ["rare", "w"]}  # 2 holds exactly four fifths of 1, all but its rarest chunk
    df = {k: sum(k in s for s in sets.values()) for k in kinds}
    shared = spark.createDataFrame([(c, chunk[k], df[k]) for c, s in sets.items() for k in s if df[k] > 1], "class long, chunk long, df long")
    classes = spark.createDataFrame([(c, sum(kinds[k] for k in s)) for c, s in sets.items()], "class long, total long")
    assert [tuple(r) for r in Z.class_links(shared, classes, Z.FINE).collect()] == [(1, 2, 100, 140, 80)]
