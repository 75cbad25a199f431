import numpy as np

from knotwork.llm import embeddings as V


def frame(spark, x, ids=None):
    rows = [(int(i), [float(f) for f in v]) for i, v in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'own' as node", "'own' as v", "1 as label")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 32))
    near = base[:350] + rng.normal(size=(350, 32)) * np.linspace(0.05, 0.6, 350)[:, None]
    x = np.concatenate([base, near, base[:40], np.repeat(base[5:6], 60, axis=0) + rng.normal(size=(60, 32)) * 0.1])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    found = {r["vec_id"]: r["group_id"] for r in V.near_duplicates(frame(spark, x)).collect()}
    hit = [found.get(i) is not None and found.get(i) == found.get(j) for i, j in zip(a, b)]
    assert len(a) > 2000 and np.mean(hit) >= 0.97
    single = [found.get(i) is not None and found.get(i) == found.get(j) for i, j in zip(a, b) if i < 350 and j == 700 + i]
    assert np.mean(single) >= 0.9
    close = (unit @ unit.T >= 0.9).sum(axis=1) > 1
    assert all(close[i] for i in found)  # verification is exact: nobody without a partner


def test_links_connect_a_list():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 8)).astype(np.float32)
    x[20:60] = x[3] + rng.normal(size=(40, 8)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(x @ x[:15].T), axis=1)[:, :5].astype(np.int32)
    for block in (7, 1000):
        u, v = V.list_links(near, x, 0.9, 2, block)
        ok = (x @ x.T >= 0.9) & ([[len({*a} & {*b}) >= 2 for b in near.tolist()] for a in near.tolist()])
        want, got = ok.copy(), np.eye(90, dtype=bool)
        got[u, v] = got[v, u] = True
        for _ in range(8):
            want, got = want @ want, got @ got
        off = ~np.eye(90, dtype=bool)
        assert (want[off] == got[off]).all()


def test_messy_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (9, [0.0, 1.0])]
    found = V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"] or 0, r["group_id"], r["keep"]) for r in found) == [(0, 1, False), (1, 1, True), (2, 1, False), (2, 1, False)]
    assert V.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hot_cluster_around_the_threshold(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centre, noise = unit(rng.normal(size=(1, 64))), rng.normal(size=(400, 64))
    noise = unit(noise - (noise @ centre.T) * centre)
    x = unit(np.concatenate([rng.normal(size=(600, 64)), 0.935 * centre + (1 - 0.935**2) ** 0.5 * noise])).astype(np.float32)
    near = np.tile(np.arange(3, dtype=np.int32), (len(x), 1))  # all pivots in common: every pair is a candidate
    exact = x.astype(np.float64)
    close = np.triu(exact @ exact.T / np.outer(*[np.linalg.norm(exact, axis=1)] * 2) >= 0.9, 1)
    small = np.rint(x * (V.STEPS / np.abs(x).max(axis=1, keepdims=True))).astype(np.float32)
    off = V.slack(64)
    u, v = V.list_links(near, unit(small), 0.9 - off, 3, 256, 0.9 + off)
    true = close[np.minimum(u, v), np.maximum(u, v)]
    group = np.arange(len(x))
    for _ in range(len(x)):
        before = group.copy()
        for a, b in zip(u[true], v[true]):
            group[a] = group[b] = min(group[a], group[b])
        if (before == group).all():
            break
    a, b = np.nonzero(close)
    assert len(a) > 1000 and (group[a] == group[b]).all()
    assert len(u) < 3 * len(x)
    p = V.EmbeddingParams(prefix=3, pivot_bytes=3 * 64 * 4)  # one list of all
    found = {r["vec_id"]: r["group_id"] for r in V.near_duplicates(frame(spark, x), p).collect()}
    assert all(i in found and found[i] == found.get(j) for i, j in zip(a.tolist(), b.tolist()))


def test_each_length_is_indexed(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(8, 16)), rng.normal(size=(4, 24))
    rows = [*x, *(x[:3] * 2), *y, y[0], y[1] + 0.001]
    table = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    found = {r["vec_id"]: r["group_id"] for r in V.near_duplicates(table).collect()}
    assert found == {0: 0, 8: 0, 1: 1, 9: 1, 2: 2, 10: 2, 11: 11, 15: 11, 12: 12, 16: 12}


def test_each_pair_is_verified_in_the_list_of_its_first_shared_pivot():
    rng = np.random.default_rng(5)
    for names, ways in ((40, {True}), (2000, {False})):  # counted by a product, and by lists
        near = np.array([np.append(rng.choice(names, 5, replace=False), 9999) for _ in range(120)], np.int32)
        seen, used = np.zeros((120, 120), int), set()
        for pivot in np.unique(near):
            own = np.flatnonzero((near == pivot).any(axis=1))
            counts = V.Shared(near[own], int(pivot))
            used.add(counts.there is not None)
            made = np.concatenate([counts.rows(i, min(i + 7, len(own))) for i in range(0, len(own), 7)])
            assert all((counts.of(k, np.arange(len(own))) == made[k]).all() for k in range(len(own)))
            seen[np.ix_(own, own)] += V.enough(made, 2)
        assert used >= ways
        want = np.array([[len({*a} & {*b}) >= 2 for b in near.tolist()] for a in near.tolist()])
        assert (seen == want).all()


def test_a_chain_of_three(spark):
    turn = np.radians([0, 13.5, 27])
    x = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    for shift in range(6):
        found = V.near_duplicates(frame(spark, np.roll(x, shift, axis=0) * (1 + shift))).collect()
        assert [(r["vec_id"], r["group_id"], r["group_size"]) for r in sorted(found)] == [(0, 0, 3), (1, 0, 3), (2, 0, 3)]


def test_no_pair_with_three_shared_pivots_is_lost(spark):
    """Clusters whose cosines lie on either side of the threshold, against brute force over all pairs."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(40, 64)))
    members = [unit(c + unit(rng.normal(size=(12, 64))) * (1 / r**2 - 1) ** 0.5) for c, r in zip(centres, np.linspace(0.93, 0.965, 40))]
    x = np.concatenate([*members, unit(rng.normal(size=(1200, 64)))]).astype(np.float32)
    table = frame(spark, x)
    p = V.EmbeddingParams()
    found = {r["vec_id"]: r["group_id"] for r in V.near_duplicates(table, p).collect()}
    nodes = spark.createDataFrame([(int(i), [float(f) for f in v]) for i, v in enumerate(x)], "id long, v array<float>")
    nodes = nodes.selectExpr("xxhash64(v) as node", "v")
    pivots = V.choose_pivots(nodes, 64, len(x), p)
    near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, : p.prefix]
    exact = unit(x.astype(np.float64))
    a, b = np.nonzero(np.triu(exact @ exact.T >= 0.9, 1))
    shared = np.array([len({*near[i]} & {*near[j]}) for i, j in zip(a, b)])
    one = np.array([i in found and found.get(i) == found.get(j) for i, j in zip(a.tolist(), b.tolist())])
    assert len(a) > 500 and 0.8 < (exact @ exact.T)[:12, :12].min() < 0.9
    assert one[shared >= 3].all() and one.mean() >= 0.9
    joined = {}  # nothing is joined that brute force doesn't join
    group = np.arange(len(x))
    for _ in range(12):
        np.minimum.at(group, a, group[b])
        np.minimum.at(group, b, group[a])
    for i, g in found.items():
        joined.setdefault(g, set()).add(int(group[i]))
    assert all(len(k) == 1 for k in joined.values())
