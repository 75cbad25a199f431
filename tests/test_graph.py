import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knotwork.functions import paths
from knotwork.operators import cycles as C
from knotwork.operators import graph as G
from knotwork.operators import reach as A
from knotwork.operators import trace as T
from knotwork.operators.components import connected_components
from knotwork.operators.pieces import pieces_of
from knotwork.operators.scc import large_components, strong_components, strong_members, tarjan


def frames(spark, edges, nodes=(), lines=None):
    e = spark.createDataFrame([(a, b, lines.get((a, b), [1]) if lines else [1]) for a, b in edges], "src string, dst string, lines array<int>")
    return spark.createDataFrame([(n,) for n in {*nodes, *(x for e in edges for x in e)}], "path string"), e


def closure(edges):
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
    changed = True
    while changed:
        changed = False
        for a in reach:
            new = set().union(*(reach.get(b, set()) for b in reach[a])) - reach[a]
            if new:
                reach[a] |= new
                changed = True
    return reach


def components(edges, nodes):
    reach = closure(edges)
    return {frozenset({n} | {m for m in nodes if m in reach.get(n, ()) and n in reach.get(m, ())}) for n in nodes}


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=40))
@settings(max_examples=150, deadline=None)
def test_search_matches_mutual_reachability(edges):
    nodes = {x for e in edges for x in e}
    root = tarjan([a for a, _ in edges], [b for _, b in edges])
    found = {}
    for n in nodes:
        found.setdefault(root[n], set()).add(n)
    assert {frozenset(g) for g in found.values()} == components(edges, nodes)


@pytest.mark.parametrize("task_edges", [10**6, 12, 2])
def test_components_alike_at_every_size(spark, task_edges):
    rng = random.Random(7)
    names = [f"p{i % 3}/m{i}.py" for i in range(24)]
    edges = sorted({(rng.choice(names[k : k + 8]), rng.choice(names[k : k + 8])) for k in (0, 8, 16) for _ in range(14)})
    rows = strong_components(*frames(spark, edges, names), task_edges).collect()
    found = {}
    for r in rows:
        found.setdefault(r["scc_id"], set()).add(r["node"])
    assert {frozenset(g) for g in found.values()} == components(edges, set(names))
    assert all(k == paths.sort_paths(g)[0] for k, g in found.items())


def test_ring_of_100000():
    n = 100_000
    assert len(set(tarjan(range(n), [*range(1, n), 0]).values())) == 1


def test_rings_and_chains_end_in_few_rounds(spark):
    """Components of thousands of edges where a task may hold a few dozen: chains are contracted, not walked."""
    ring = [(i, (i + 1) % 3000) for i in range(3000)]
    tail = [(2999 + i, 3000 + i) for i in range(1, 500)] + [(17, 3000)]  # leads out of the ring and never back
    knot = [(5000 + i, 5000 + (i * 7 + 1) % 90) for i in range(90)] + [(5000 + i, 5000 + (i + 1) % 90) for i in range(90)] + [(40, 5000)]
    edges = [*ring, *tail, *knot, (6000, 6001), (6001, 6000), (6001, 6001)]
    want = tarjan(*zip(*edges))
    found = {r["node"]: r["root"] for r in large_components(spark.createDataFrame(edges, "u long, v long"), 60).collect()}
    assert len([*found]) == len(set(found))
    groups = lambda root: {frozenset(n for n in want if root.get(n, n) == k) for k in {root.get(n, n) for n in want}}
    assert groups(found) == groups(want) and max(map(len, groups(want))) == 3000


def test_weak_components_of_a_long_path(spark):
    rows = [(i, i + 1) for i in range(500)] + [(1000, 1001), (1002, 1002), (None, 5)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(501)) and found[1001] == 1000 and found[1002] == 1002


def test_cycles_and_self_loops(spark):
    nodes, edges = frames(spark, [("a.py", "b.py"), ("b.py", "a.py"), ("c.py", "d.py"), ("e.py", "e.py")])
    found = C.cycles_of(strong_components(nodes, edges), edges)
    assert sorted(r["members"] for r in found.collect()) == [["a.py", "b.py"], ["e.py"]]
    assert C.by_size(found).count() == 1 and C.by_size(found, 1, 1).count() == 1


def test_order_of_cycles(spark):
    rows = [("x.py", ["x.py", "y.py"]), ("beta/a.py", ["beta/a.py", "beta/b.py", "beta/c.py"]), ("beta/p.py", ["beta/p.py", "beta/q.py"]), ("alpha/a.py", ["alpha/a.py", "beta/z.py"])]
    df = spark.createDataFrame([(i, m, len(m)) for i, m in rows], "scc_id string, members array<string>, size int")
    numbered = C.ordered(df, []).orderBy("cycle_index").collect()
    assert [r["scc_id"] for r in numbered] == ["alpha/a.py", "beta/p.py", "beta/a.py", "x.py"]
    assert [r["run"] for r in C.package_runs(C.ordered(df, [])).orderBy("cycle_index").collect()] == [1, 2, 2, 3]
    assert {(r["package"], r["cycles"]) for r in C.package_frequency(C.ordered(df, [])).collect()} == {("alpha", 1), ("beta", 3), ("(root-level)", 1)}


def test_ignore_needs_the_exact_set(spark):
    df = spark.createDataFrame([("a.py", ["a.py", "b.py"], 2)], "scc_id string, members array<string>, size int")
    for files, hit in ((["b.py", "a.py"], True), (["a.py", "./b.py"], True), (["a.py"], False), (["a.py", "b.py", "b.py"], False)):
        assert C.list_ignored(df, C.ignore_frame(spark, [files])).first()["suppressed"] == hit


def test_best_way_ties(spark):
    edges = [("start.py", "a.py"), ("start.py", "b.py"), ("a.py", "z_entry.py"), ("b.py", "m_entry.py"), ("m_entry.py", "z_entry.py"), ("z_entry.py", "m_entry.py")]
    nodes, e = frames(spark, edges)
    kept = C.ordered(C.by_size(C.cycles_of(strong_components(nodes, e), e)), [])
    for task_edges in (10**6, 1):
        row = T.impacts(e, kept, nodes.where("path = 'start.py'"), task_edges).first()
        assert row["entry"] == "z_entry.py" and [h["from"] for h in row["path"]] == ["start.py", "a.py"] and row["from_lines"] == [1]


def test_best_ways_alike_at_every_size(spark):
    rng = random.Random(11)
    names = [f"p{i % 4}/m{i}.py" for i in range(40)]
    edges = sorted({(names[a], names[b]) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70))})
    nodes, e = frames(spark, edges, names)
    cyclic = C.members_of(C.by_size(C.cycles_of(strong_components(nodes, e), e)))
    one, rounds = (sorted(map(tuple, A.best_paths(e, cyclic, nodes, k).collect())) for k in (10**6, 1))
    assert one == rounds and len(one) > 10 and max(len(r[3]) for r in one) > 3


def test_exclusions_keep_what_is_imported(spark):
    nodes, e = frames(spark, [("a.py", "s.py"), ("s.py", "s.py"), ("x.py", "y.py"), ("y.py", "x.py")])
    kept, inner = A.apply_exclusions(nodes, e, nodes.where("path in ('s.py', 'x.py', 'y.py')"))
    assert {r["path"] for r in kept.collect()} == {"a.py", "s.py"} and inner.count() == 2


def test_restored_edges_need_each_other(spark):
    nodes, e = frames(spark, [("a/__init__.py", "b/y.py"), ("b/__init__.py", "a/x.py")], ["a/x.py", "b/y.py"])
    winners = spark.createDataFrame([("b", "b/__init__.py"), ("a", "a/__init__.py"), ("a.x", "a/x.py"), ("b.y", "b/y.py")], "module string, path string")
    both = spark.createDataFrame([("a.x", "a", 3), ("b.y", "b", 4)], "source string, ancestor_package string, line int")
    assert G.restore_suppressed(nodes, e, winners, both).count() == 4
    assert G.restore_suppressed(nodes, e, winners, both.limit(1)).count() == 2


def test_partial_baseline(spark):
    df = spark.createDataFrame([("a.py", ["a.py", "b.py", "c.py"], int("3"))], "scc_id string, members array<string>, size int")
    _, direct = frames(spark, [("a.py", "b.py"), ("b.py", "a.py"), ("b.py", "c.py")])
    assert {r["path"] for r in C.cyclic_files_direct(df, direct).collect()} == {"a.py", "b.py"}
    assert {r["path"] for r in C.cyclic_files_direct(df, direct.where("src <> 'b.py'")).collect()} == set(df.first()["members"])


def test_path_order_is_by_component():
    assert paths.sort_paths(["a-b/c.py", "a.py", "a/b.py"]) == ["a/b.py", "a-b/c.py", "a.py"]


@pytest.fixture
def apart(spark):
    """Small shuffles keep their partitions."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _scattered(spark):
    """Chains of small cycles whose edges lie at many places, so that no task has a whole component."""
    rng = random.Random(5)
    edges = [(f"g{g}/m{i}.py", f"g{g}/m{j}.py") for g in range(30) for i, j in ((0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 0), (6, 5), (6, 4))]
    rows = [(a, b, [rng.randrange(9)], rng.randrange(40)) for a, b in edges]
    return edges, spark.createDataFrame(rows, "src string, dst string, lines array<int>, place long")


def test_pieces_of_many_places_are_linked(spark, apart):
    edges, scattered = _scattered(spark)
    found = {}
    for r in pieces_of(scattered).edges().collect():
        found.setdefault(r["component"], set()).update((r["src"], r["dst"]))
    assert sorted(map(sorted, found.values())) == sorted(sorted(f"g{g}/m{i}.py" for i in range(7)) for g in range(30))
    together = scattered.withColumn("place", F.xxhash64(F.substring_index("src", "/", 1)))
    assert pieces_of(scattered).links is not None and pieces_of(together).links is None


def test_small_components_need_no_rounds(spark, apart, monkeypatch):
    """Cycles, ways to them and all that leads to them, in a graph beyond a task whose components are not."""
    edges, scattered = _scattered(spark)
    nodes = scattered.select(F.col("src").alias("path")).distinct()
    kept = C.ordered(C.by_size(C.cycles_of(strong_members(scattered, 20), scattered)), [])
    one = T.impacts(scattered, kept, nodes).collect()
    for name in ("_best_by_rounds", "_reachable_by_rounds"):
        monkeypatch.setattr(A, name, lambda *x: pytest.fail("a round of shuffles"))
    many = T.impacts(scattered, kept, nodes, 20)
    show = lambda rows: sorted(str(r.asDict(True)) for r in rows)
    assert show(many.collect()) == show(one) and kept.count() == 60
    counted = T.impacts(scattered, kept, nodes, 20, hops=False)
    for stats in (T.trace_stats, T.trace_distribution):
        assert show(stats(counted).collect()) == show(stats(many).collect())
    leads = A.reaching(scattered, C.cyclic_files(kept), 20)
    assert sorted(r["path"] for r in leads.collect()) == sorted({x for e in edges for x in e})


def test_no_task_numbers_all_cycles(spark):
    df = spark.createDataFrame([(f"p{i % 7}/{i}.py", [f"p{i % 7}/{i}.py"], i % 5) for i in range(200)], "scc_id string, members array<string>, size int")
    found = C.ordered(df, [])
    assert "Window [row_number" not in found._jdf.queryExecution().toString()
    rows = [(r["packages"][0], r["size"], r["scc_id"].split("/")) for r in found.orderBy("cycle_index").collect()]
    assert rows == sorted(rows) and [r["cycle_index"] for r in found.orderBy("cycle_index").collect()] == list(range(1, 201))
