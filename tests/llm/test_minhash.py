import numpy as np
import pyarrow as pa
import pytest

from knotwork.llm import minhash as M


def edited(text, seed, share):
    rng = np.random.default_rng(seed)
    words = text.split()
    for i in np.flatnonzero(rng.random(len(words)) < share):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def jaccard(a, b, w=3):
    def runs(t):
        words = t.lower().replace(".", " ").replace(",", " ").split()
        return {tuple(words[i : i + w]) for i in range(max(1, len(words) - w + 1))} if words else set()

    x, y = runs(a), runs(b)
    return len(x & y) / max(1, len(x | y))


def groups(rows):
    found = {}
    for r in rows:
        found.setdefault(r["group_id"], set()).add(r["doc_id"])
    return {frozenset(g) for g in found.values()}


def test_minima_estimate_jaccard(prose):
    p = M.MinHashParams()
    texts = [prose(5, 300), edited(prose(5, 300), 1, 0.05), edited(prose(5, 300), 2, 0.2), prose(6, 300)]
    some, low = M.minima(pa.array([*texts, "", None, "?!"]), p)
    assert some.tolist() == [0, 1, 2, 3]
    for i in range(1, 4):
        assert abs((low[0] == low[i]).mean() - jaccard(texts[0], texts[i])) < 0.12


def test_groups_match_brute_force(make, prose):
    rows = [(i, prose(i, 120)) for i in range(40)]
    for k in range(8):
        rows += [(100 + 10 * k + j, edited(prose(k, 120), 10 * k + j, 0.02 + 0.02 * (j % 3))) for j in range(4)]
    found = groups(M.near_duplicates(make(rows)).collect())
    edges = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if jaccard(x, y) >= 0.5]
    member = {d: g for g in found for d in g}
    assert np.mean([member.get(a) is not None and member.get(a) == member.get(b) for a, b in edges]) >= 0.95
    for group in found:  # nobody is in a group without a similar member
        assert all(any(o != d and jaccard(dict(rows)[d], dict(rows)[o]) > 0.3 for o in group) for d in group)


def test_bucket_links_connect_what_all_pairs_would():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 4, (60, 40)).astype(np.uint8)
    sig[30:50] = sig[3]
    sig[30:50, :10] = rng.integers(0, 4, (20, 10))
    root, left = M.bucket_links(sig, 26)
    assert not len(left)
    near = (sig[:, None] == sig[None]).sum(axis=2) >= 26
    reach = near.copy()
    for _ in range(6):
        reach = reach @ reach
    assert ((root[:, None] == root[None]) == reach).all()


def test_messy_rows(messy):
    rows = M.near_duplicates(messy).collect()
    assert {r["group_id"] for r in rows} == {1} and sorted(r["doc_id"] is None for r in rows) == [False] * 4 + [True]
    assert {r["doc_id"] for r in rows if r["keep"]} == {1}
    kept = M.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept.collect() if r["doc_id"] != 7) == sorted(
        [(1, messy.first()["text"][:5]), (3, ""), (4, ""), (5, "   "), (6, "x"), (0, ""), (9, "\n\n###"), (8, "of an")]
    )


def test_empty_table(make):
    assert M.near_duplicates(make([])).count() == 0 and M.drop_near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("n", [300])
def test_many_copies_are_one_group(make, prose, n):
    rows = [(i, edited(prose(1, 200), i, 0.02)) for i in range(n)]
    found = M.near_duplicates(make(rows)).collect()
    assert len(found) == n and {r["group_id"] for r in found} == {0} and sum(r["keep"] for r in found) == 1


def template_pages(prose, n):
    """Pages of one long template and a text of their own: they share bands, and few of them agree; some are near copies."""
    shared = prose(900, 150)
    rows = [(i, f"{shared} {prose(i, 190)}") for i in range(n)]
    return rows + [(n + i, edited(rows[i * 3][1], i, 0.03)) for i in range(n // 6)]


def test_hot_buckets_give_the_same_groups(make, prose):
    docs = make(template_pages(prose, 150))
    want = groups(M.near_duplicates(docs).collect())
    assert sum(map(len, want)) > 40
    for p in (M.MinHashParams(comparisons=1, block=7), M.MinHashParams(bucket_rows=5), M.MinHashParams(bucket_rows=20, comparisons=60, block=3)):
        assert groups(M.near_duplicates(docs, p).collect()) == want
    sigs = M.signatures(docs)
    heads = sigs.selectExpr("node", "explode(bands) as h").groupBy("h").count()
    assert heads.agg({"count": "max"}).first()[0] > 15  # a template makes buckets beyond these limits


def test_groups_of_a_bucket_meet_each_other_once(spark):
    members = [(1, 50, i) for i in range(50)] + [(2, 3, i) for i in range(100, 103)]
    rows = M.in_groups(spark.createDataFrame(members, "bucket long, n long, node long"), 8).collect()
    found = {}
    for r in rows:
        found.setdefault(r["bucket"], set()).add(r["node"])
    assert found[2] == {100, 101, 102} and len(found) == 1 + 7 * 6 // 2
    assert max(map(len, found.values())) < 3 * 8
    assert all(any({a, b} <= g for g in found.values()) for a in range(50) for b in range(a))


def test_bucket_links_stop_between_components():
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 200, (80, 40)).astype(np.uint8)
    sig[5:40:5] = sig[0]
    root, left = M.bucket_links(sig, 30, 100)
    assert set(left) == set(range(80)) - {0, *range(5, 40, 5)} and (root[5:40:5] == 0).all()


def test_one_of_equal_rows_stays(make, prose):
    rows = [(1, prose(1)), (1, prose(1), "fr"), (2, prose(1) + " more"), (3, prose(2)), (3, prose(2)), (4, ""), (4, "")]
    kept = M.drop_near_duplicates(make(rows, clash=True))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, prose(1)), (3, prose(2)), (4, ""), (4, "")]


def test_recall_at_the_threshold_against_all_pairs(make, prose):
    """Pairs of documents that agree in little more than half of their minima, against a comparison of all signatures."""
    p = M.MinHashParams()
    rows = [(i, prose(2000 + i, 200)) for i in range(220)]
    rows += [(1000 + i, edited(text, i, 0.09 + 0.04 * (i % 10) / 10)) for i, text in rows]
    docs = make(rows)
    sigs = {r["doc_id"]: np.frombuffer(r["sig"], np.uint8) for r in M.signatures(docs, p).collect()}
    ids = sorted(sigs)
    x = np.stack([sigs[i] for i in ids])
    agree = (x[:, None] == x[None]).sum(axis=2) / 160
    a, b = np.nonzero(np.triu(agree >= (p.threshold * 255 + 1) / 256, 1))
    near = agree[a, b]
    found = {r["doc_id"]: r["group_id"] for r in M.near_duplicates(docs, p).collect()}
    hit = np.array([found.get(ids[i]) is not None and found.get(ids[i]) == found.get(ids[j]) for i, j in zip(a, b)])
    assert len(a) > 100 and np.quantile(near, 0.8) < 0.65 and hit.mean() >= 0.9
    assert set(found) <= {ids[k] for k in np.concatenate([a, b])}
