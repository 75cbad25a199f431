"""Strongly connected components.

A component never spans two weakly connected ones, so large graphs are split into weak components (``pieces``), and tasks
search many of them at a time, all in parallel. A component too large for a task is trimmed of nodes that can't be in a
cycle, split once more by star rounds, and contracted: a node with one edge out of it, or into it, goes, and its edges pass
to the other end, so that long chains shrink by a share of their nodes in every round; what then fits a task is searched by
it, and what shrinks no more, a graph of many edges a node, is solved by colouring, in rounds of about its diameter. Small
graphs are one task from the start: rounds of shuffles cost more there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions import paths
from knotwork.operators.components import connected_components
from knotwork.operators.lineage import cut, release
from knotwork.operators.pieces import by_component, ident, pieces_of, too_large, without

#: Edges that one task searches in memory.
TASK_EDGES = 1_000_000
TRIM_ROUNDS = 3
MEMORY_TRIMS = 10


def tarjan(src, dst) -> dict:
    """Root member of each node's strong component, without recursion."""
    after: dict = {}
    for a, b in zip(src, dst):
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    number: dict = {}
    low: dict = {}
    root: dict = {}
    held: list = []
    on: set = set()
    for start in after:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        held.append(start)
        on.add(start)
        work = [(start, iter(after[start]))]
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    held.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(after[nxt])))
                    break
                if nxt in on and number[nxt] < low[node]:
                    low[node] = number[nxt]
            else:
                work.pop()
                if work and low[node] < low[work[-1][0]]:
                    low[work[-1][0]] = low[node]
                if low[node] == number[node]:
                    while True:
                        member = held.pop()
                        on.discard(member)
                        root[member] = node
                        if member == node:
                            break
    return root


def _search(part: pd.DataFrame) -> pd.DataFrame:
    root = tarjan(part["u"].tolist(), part["v"].tolist())
    return pd.DataFrame({"node": list(root), "root": list(root.values())}, dtype="int64")


def _search_members(part: pd.DataFrame) -> pd.DataFrame:
    at, names = pd.factorize(pd.concat([part["src"], part["dst"]], ignore_index=True))
    u, v = at[: len(part)], at[len(part) :]
    for _ in range(MEMORY_TRIMS):  # a look at each edge is dearer in a search than in an array
        keep = (np.bincount(v, minlength=len(names))[u] > 0) & (np.bincount(u, minlength=len(names))[v] > 0)
        if keep.all():
            break
        u, v = u[keep], v[keep]
    groups: dict = {}
    for node, root in tarjan(u.tolist(), v.tolist()).items():
        groups.setdefault(root, []).append(names[node])
    found = [(node, first) for group in groups.values() if len(group) > 1 for first in [min(group, key=lambda p: p.split("/"))] for node in group]
    return pd.DataFrame(found, columns=["node", "scc_id"], dtype="object")


def _trim(edges: DataFrame) -> DataFrame:
    """Edges whose begin has an edge into it and whose end has one out of it."""
    ins, outs = edges.select(F.col("v").alias("u")).distinct(), edges.select(F.col("u").alias("v")).distinct()
    return edges.join(ins, "u", "left_semi").join(outs, "v", "left_semi").select("u", "v")


def _fixpoint(state: DataFrame, step) -> DataFrame:
    """Repeat a step on (node, color) until no color changes."""
    while True:
        after = cut(step(state), "color")
        changed = after.exceptAll(state).limit(1).count()
        release(state)
        state = after
        if not changed:
            return state


def color_components(edges: DataFrame) -> DataFrame:
    """(node, root) by forward-backward colouring: for components that no task can hold."""
    found = None
    left = cut(edges.where("u <> v"), "left")
    while left.limit(1).count():
        nodes = left.select(F.col("u").alias("node")).union(left.select(F.col("v").alias("node"))).distinct()
        state = cut(nodes.select("node", F.col("node").alias("color")), "color")

        def spread(state: DataFrame, edges: DataFrame = left) -> DataFrame:
            sent = edges.join(state.select(F.col("node").alias("u"), "color"), "u").select(F.col("v").alias("node"), "color")
            return sent.unionByName(state).groupBy("node").agg(F.max("color").alias("color"))

        color = _fixpoint(state, spread)
        inner = left.join(color.select(F.col("node").alias("u"), F.col("color").alias("cu")), "u").join(
            color.select(F.col("node").alias("v"), F.col("color").alias("cv")), "v"
        )
        inner = cut(inner.where("cu = cv").select("u", "v"), "inner")

        def back(state: DataFrame, edges: DataFrame = inner) -> DataFrame:
            sent = edges.join(state.select(F.col("node").alias("v"), "color"), "v").select(F.col("u").alias("node"), "color")
            return sent.unionByName(state).distinct()

        done = _fixpoint(cut(color.where("node = color"), "roots"), back)
        part = done.select("node", F.col("color").alias("root"))
        found = part if found is None else found.unionByName(part)
        gone = done.select("node")
        rest = left.join(gone.select(F.col("node").alias("u")), "u", "left_anti").join(gone.select(F.col("node").alias("v")), "v", "left_anti")
        after = cut(rest.select("u", "v"), "left")
        release(left, inner)
        left = after
    return found if found is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)


def _flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"))


def _contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(gone, edges): nodes (u) with one edge only out of them, to v, which stays; and the edges once u is passed over.

    Whoever comes to u goes on to v, so u is in a cycle only with v. Of a chain of such nodes a coin picks those that go,
    none of them next to another.
    """
    single = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1").select("u", "v")
    coin = lambda c: F.xxhash64(F.lit(turn), c).bitwiseAND(1) == 1
    picked = single.where(coin("u"))
    gone = cut(picked.join(picked.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v"), "gone")
    onward = gone.select(F.col("u").alias("v"), F.col("v").alias("w"))
    rest = edges.join(gone.select("u"), "u", "left_anti").join(onward, "v", "left").select("u", F.coalesce("w", "v").alias("v"))
    return gone, cut(rest.where("u <> v").distinct(), "contracted")


def _expand(gone: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``roots`` (node, root) with the nodes that a contraction of ``edges`` took: u is in v's component if an edge comes to
    it from there. Nodes without a row are alone."""
    of = lambda name, root: roots.select(F.col("node").alias(name), F.col("root").alias(root))
    into = edges.select(F.col("u").alias("x"), F.col("v").alias("u")).join(gone, "u")
    met = into.join(of("v", "rv"), "v", "left").join(of("x", "rx"), "x", "left")
    met = met.where(F.coalesce("rx", "x") == F.coalesce("rv", "v"))
    found = met.groupBy("u").agg(F.min(F.coalesce("rv", "v")).alias("root"), F.min("v").alias("v"))
    # v itself may have been alone until now
    ends = found.select(F.col("v").alias("node"), "root").union(found.select(F.col("u").alias("node"), "root"))
    return ends.union(roots.select("node", "root")).distinct()


def large_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) of a graph that no task can hold; nodes left out are alone."""
    levels: list[tuple[DataFrame, DataFrame, bool]] = []
    left = cut(edges.where("u <> v").distinct(), "contracted")
    many, idle = left.count(), 0
    while many > task_edges and idle < 4:
        back = len(levels) % 2 == 1  # nodes with one edge into them are those with one out of them, seen from behind
        gone, after = _contract(_flip(left) if back else left, len(levels))
        levels.append((gone, left, back))
        left = _flip(after) if back else after
        before, many = many, left.count()
        idle = idle + 1 if many > 0.98 * before else 0
    found = left.groupBy().applyInPandas(_search, "node long, root long") if many <= task_edges else color_components(left)
    roots = cut(found, "roots")
    for gone, level, back in reversed(levels):
        after = cut(_expand(gone, _flip(level) if back else level, roots), "roots")
        release(roots, gone, level)
        roots = after
    return roots


def component_roots(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) of distinct edges (u LONG, v LONG): nodes of one strong component have one root. Nodes left out are alone."""
    shape = "node long, root long"
    for _ in range(TRIM_ROUNDS):
        after = cut(_trim(edges), "trimmed")
        release(edges)
        edges = after
    parts = connected_components(edges).select(F.col("node").alias("u"), "component")
    placed = cut(edges.join(parts, "u"), "placed")
    large = too_large(placed, task_edges)
    found = by_component(without(placed, large), _search, shape)
    if large is not None:
        found = found.unionByName(large_components(placed.join(large, "component", "left_semi").select("u", "v"), task_edges))
    return found


MEMBERS = "node string, scc_id string"


def members_within(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, scc_id) of strong components of two or more in ``edges`` (src, dst, component LONG), none of which spans two of
    the given components. scc_id is the first member in path order. Beyond ``task_edges`` edges a path is its 64-bit hash."""
    edges = edges.select("src", "dst", "component")
    large = too_large(edges, task_edges)
    found = by_component(without(edges, large), _search_members, MEMBERS)
    if large is None:
        return found
    rows = cut(edges.join(large, "component", "left_semi").where("src <> dst"), "large")
    roots = component_roots(rows.select(ident("src").alias("u"), ident("dst").alias("v")).distinct(), task_edges).select(F.col("node").alias("id"), "root")
    named = rows.select(F.col("src").alias("node")).union(rows.select(F.col("dst").alias("node"))).distinct()
    placed = cut(named.select("node", ident("node").alias("id")).join(roots, "id").select("node", "root"), "scc")
    first = placed.groupBy("root").agg(F.array_join(F.min(paths.path_key("node")), "/").alias("scc_id"), F.count("*").alias("n"))
    return found.unionByName(placed.join(first.where("n > 1"), "root").select("node", "scc_id"))


def strong_members(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, scc_id) of every strong component of two or more of edges (src, dst)."""
    held = edges if hasattr(edges, "_knotwork_path") else cut(edges, "edges")
    if held.count() <= task_edges:
        return held.select("src", "dst").where("src <> dst").groupBy().applyInPandas(_search_members, MEMBERS)
    return cut(members_within(pieces_of(held).edges(), task_edges), "members")


def strong_components(nodes: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, scc_id) of every node (path) and every end of an edge (src, dst), alone or not.

    scc_id is the first member in path order.
    """
    named = nodes.select(F.col("path").alias("node")).union(edges.select("src")).union(edges.select("dst")).distinct()
    return named.join(strong_members(edges, task_edges), "node", "left").select("node", F.coalesce("scc_id", "node").alias("scc_id"))
