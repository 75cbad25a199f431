"""Reachability: one search where the graph fits a task, else a search of each weak component by one task, and frontier
rounds that end in tables for components that no task can hold."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.functions import paths
from knotwork.operators.lineage import cut, release
from knotwork.operators.pieces import by_component, pieces_of, too_large, without
from knotwork.operators.scc import TASK_EDGES

#: Bytes of names in a graph that is sent to every task.
SENT_BYTES = 64 << 20


def _closure(edges: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    after: dict[str, list[str]] = {}
    for a, b in zip(edges["src"], edges["dst"]):
        after.setdefault(a, []).append(b)
    seen = set(seeds["path"])
    todo = deque(seen)
    while todo:
        for nxt in after.get(todo.popleft(), ()):
            if nxt not in seen:
                seen.add(nxt)
                todo.append(nxt)
    return pd.DataFrame({"path": list(seen)}, dtype="object")


def _closure_of_components(part: pd.DataFrame) -> pd.DataFrame:
    edge = part["dst"].notna()
    return _closure(part[edge], part.loc[~edge, ["src"]].rename(columns={"src": "path"}))


def reachable(edges: DataFrame, seeds: DataFrame, task_edges: int = TASK_EDGES, backward: bool = False) -> DataFrame:
    """(path): ``seeds`` (path) and all that edges (src, dst) lead to from them, or all that leads to them."""
    seeds = seeds.select("path").distinct()
    ways = (lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if backward else (lambda e: e.select("src", "dst"))
    if edges.count() <= task_edges:
        return ways(edges).groupBy().cogroup(seeds.groupBy()).applyInPandas(_closure, "path string")
    pieces = pieces_of(edges)
    placed, inner = pieces.place(seeds, "path"), pieces.edges()
    large = too_large(inner, task_edges)
    small = without(inner, large)
    a, b = ("dst", "src") if backward else ("src", "dst")
    rows = small.select(F.col(a).alias("src"), F.col(b).alias("dst"), "component").union(
        without(placed, large).select(F.col("path").alias("src"), F.lit(None).cast("string").alias("dst"), "component")
    )
    found = by_component(rows, _closure_of_components, "path string")
    if large is not None:
        left = cut(ways(inner.join(large, "component", "left_semi")), "large")
        found = found.unionByName(_reachable_by_rounds(left, placed.join(large, "component", "left_semi").select("path")))
    return found


def _reachable_by_rounds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    seen = frontier = cut(seeds, "seen")
    while frontier.limit(1).count():
        step = frontier.join(edges, frontier["path"] == edges["src"]).select(F.col("dst").alias("path")).distinct()
        frontier = cut(step.join(seen, "path", "left_anti"), "frontier")
        grown = cut(seen.union(frontier), "seen")
        release(seen)
        seen = grown
    return seen


def reaching(edges: DataFrame, targets: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(path): ``targets`` and all from which edges lead to them."""
    return reachable(edges, targets, task_edges, backward=True)


def apply_exclusions(nodes: DataFrame, edges: DataFrame, excluded: DataFrame, task_edges: int = TASK_EDGES) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that the files not ``excluded`` (path) lead to: an excluded file that is imported stays."""
    kept = cut(reachable(edges, nodes.join(excluded, "path", "left_anti"), task_edges), "kept")
    inner = edges.join(kept.select(F.col("path").alias("src")), "src", "left_semi").join(kept.select(F.col("path").alias("dst")), "dst", "left_semi")
    return kept, inner.select(*edges.columns)


BEST = "start string, scc_id string, entry string, path array<string>"


def _searcher(edges: list[tuple[str, str]], scc: dict[str, str], trails: bool = True):
    """Shortest path from each start to each kept cycle; of equally short ones the first by path order of its nodes.

    Nodes that lead to no cycle are pruned first. trails: else ways are None.
    """
    names = sorted({x for e in edges for x in e} | set(scc), key=lambda p: p.replace("/", "\0"))  # path order, and cheaper
    number = {name: i for i, name in enumerate(names)}
    after: dict[int, list[int]] = {}
    before: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(number[a], []).append(number[b])
        before.setdefault(number[b], []).append(number[a])
    cycles = {number[node]: cycle for node, cycle in scc.items()}
    useful = set(cycles)
    todo = list(useful)
    while todo:
        for at in before.get(todo.pop(), ()):
            if at not in useful:
                useful.add(at)
                todo.append(at)
    after = {a: sorted(set(after[a]) & useful) for a in after if a in useful}

    def search(start: str) -> list[tuple]:
        first = number.get(start)
        if first is None or first not in useful:
            return []
        own = cycles.get(first)
        came, todo, best = {first: None}, deque([first]), {}
        while todo:
            node = todo.popleft()
            cycle = cycles.get(node)
            if cycle is not None and cycle != own and cycle not in best:
                trail, at = [], node
                while trails and at is not None:
                    trail.append(names[at])
                    at = came[at]
                best[cycle] = (start, cycle, names[node], trail[::-1] if trails else None)
            for nxt in after.get(node, ()):
                if nxt not in came:
                    came[nxt] = node
                    todo.append(nxt)
        return list(best.values())

    return search


def _sent_searcher(edges: list[tuple[str, str]], scc: dict[str, str]):
    """The search of a graph that every task is given, once in each."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = _searcher(edges, scc)
        for part in parts:
            yield pd.DataFrame([row for start in part["path"] for row in search(start)], columns=["start", "scc_id", "entry", "path"])

    return run


#: What a row of a component is: an edge, a member of a cycle, or a start.
EDGE, MEMBER, START = range(3)


def _search_components(shown: str):
    """The search of many components at a time."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kind = part["kind"].to_numpy()
        edges, members, starts = (part[kind == k] for k in (EDGE, MEMBER, START))
        pairs = list(zip(edges["a"], edges["b"]))
        search = _searcher(pairs, dict(zip(members["a"], members["b"])), shown != "none")
        rows = [row for start in starts["a"] for row in search(start)]
        index = {scc: int(i) if i == i else None for scc, i in zip(members["b"], members["cycle_index"].tolist())}
        if shown == "lines":
            of = dict(zip(pairs, edges["lines"]))
            rows = [(*row, [[int(x) for x in of[hop].split(",") if x] for hop in zip(row[3], row[3][1:])], index[row[1]]) for row in rows]
        else:
            rows = [(*row, None, index[row[1]]) for row in rows]
        return pd.DataFrame(rows, columns=["start", "scc_id", "entry", "path", "lines", "cycle_index"], dtype="object")

    return run


def _with_lines(ways: DataFrame, edges: DataFrame) -> DataFrame:
    """Ways with the lines of their hops, by joins."""
    hop = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("i"), F.get("path", i - 1).alias("src"), F.get("path", i).alias("dst"))))
    each = ways.where("size(path) > 1").select("start", "scc_id", "entry", "path", hop.alias("h")).select("start", "scc_id", "entry", "path", "h.*")
    met = each.join(edges.select("src", "dst", "lines"), ["src", "dst"], "left")
    empty = F.array().cast("array<int>")
    lines = F.array_sort(F.collect_list(F.struct("i", F.coalesce("lines", empty).alias("lines"))))
    walked = met.groupBy("start", "scc_id", "entry", "path").agg(lines.alias("hops"))
    return walked.select("start", "scc_id", "entry", "path", F.transform("hops", lambda h: h["lines"]).alias("lines"))


def best_paths(edges: DataFrame, cyclic: DataFrame, starts: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(start, scc_id, entry, path): for each start (path) the best way to each cycle of ``cyclic`` (node, scc_id).

    Best is shortest, then first by path order of the nodes on the way. The cycle a start is in itself is left out.
    """
    numbered = cyclic.select("node", "scc_id", F.lit(None).cast("int").alias("cycle_index"))
    return best_ways(edges, numbered, starts, task_edges, "path").select("start", "scc_id", "entry", "path")


def best_ways(edges: DataFrame, cyclic: DataFrame, starts: DataFrame, task_edges: int = TASK_EDGES, shown: str = "lines") -> DataFrame:
    """(start, scc_id, entry, path, lines, cycle_index): ``best_paths`` with the lines of each hop, and what ``cyclic`` has
    as cycle_index.

    shown: "lines" for all of it, "path" for ways without lines, "none" for neither, where ways are only counted.
    """
    cyclic, starts = cyclic.select("node", "scc_id", "cycle_index"), starts.select("path").distinct()
    if edges.count() <= task_edges:
        inner = _useful(edges, cyclic, task_edges)
        if inner.agg(F.coalesce(F.sum(F.length("src") + F.length("dst")), F.lit(0))).first()[0] <= SENT_BYTES:
            graph = [(r["src"], r["dst"]) for r in inner.collect()]  # every task is given the graph and searches its own starts
            scc = {r["node"]: r["scc_id"] for r in cyclic.collect()}
            return _finished(starts.mapInPandas(_sent_searcher(graph, scc), BEST), edges, cyclic, shown)
    pieces = pieces_of(edges)
    inner = pieces.edges()
    large = too_large(inner, task_edges)
    ends = cyclic.select(F.lit(MEMBER).alias("kind"), F.col("node").alias("a"), F.col("scc_id").alias("b"), "cycle_index").unionByName(
        starts.select(F.lit(START).alias("kind"), F.col("path").alias("a")), allowMissingColumns=True
    )
    placed = pieces.place(ends, "a")
    lines = [F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines")] if shown == "lines" else []
    rows = without(inner, large).select(F.lit(EDGE).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "component", *lines)
    rows = rows.unionByName(without(placed, large), allowMissingColumns=True)
    found = by_component(rows, _search_components(shown), BEST + ", lines array<array<int>>, cycle_index int")
    if large is not None:
        left = cut(inner.join(large, "component", "left_semi"), "large")
        far = cut(placed.join(large, "component", "left_semi"), "ends")
        members = far.where(F.col("kind") == MEMBER).select(F.col("a").alias("node"), F.col("b").alias("scc_id"), "cycle_index")
        first = far.where(F.col("kind") == START).select(F.col("a").alias("path"))
        ways = _best_by_rounds(cut(_useful(left, members, 0), "inner"), members.select("node", "scc_id"), first)
        found = found.unionByName(_finished(ways, left, members, shown))
    return found


def _useful(edges: DataFrame, cyclic: DataFrame, task_edges: int) -> DataFrame:
    """Edges (src, dst) that lead to a cycle."""
    targets = cyclic.select(F.col("node").alias("path"))
    if task_edges:
        useful = reaching(edges, targets, task_edges)
    else:
        useful = _reachable_by_rounds(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets.distinct())
    useful = cut(useful, "useful")
    return edges.select("src", "dst").join(useful.select(F.col("path").alias("src")), "src", "left_semi").join(
        useful.select(F.col("path").alias("dst")), "dst", "left_semi"
    )


def _finished(ways: DataFrame, edges: DataFrame, cyclic: DataFrame, shown: str) -> DataFrame:
    ways = _with_lines(ways, edges) if shown == "lines" else ways.withColumn("lines", F.lit(None).cast("array<array<int>>"))
    index = cyclic.select("scc_id", "cycle_index").distinct()
    return ways.join(index, "scc_id").select("start", "scc_id", "entry", "path", "lines", "cycle_index")


def _best_by_rounds(edges: DataFrame, cyclic: DataFrame, starts: DataFrame) -> DataFrame:
    """``best_paths`` by breadth-first rounds from all starts at once.

    A row is (start, node) with the node before it and the place of its way among those of the round: of equally long ways
    the first goes on from the first, so that ways need not be carried. They are put together at the end, for entries only.
    """
    seen = cut(starts.select(F.col("path").alias("start"), F.col("path").alias("node"), F.lit(None).cast("string").alias("came"), F.lit(1).alias("place"), F.lit(0).alias("n")), "ways")
    frontier, n = seen, 0
    place = F.row_number().over(W.partitionBy("start").orderBy("before", paths.path_key("node")))
    while frontier.limit(1).count():
        n += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node"), F.struct(F.col("place").alias("before"), F.col("node").alias("came")).alias("b"))
        first = step.groupBy("start", "node").agg(F.min("b").alias("b")).join(seen.select("start", "node"), ["start", "node"], "left_anti")
        placed = first.select("start", "node", "b.came", "b.before").withColumn("place", place)
        frontier = cut(placed.select("start", "node", "came", "place", F.lit(n).alias("n")), "frontier")
        grown = cut(seen.unionByName(frontier), "ways")
        release(seen)
        seen = grown
    own = cyclic.select(F.col("node").alias("start"), F.col("scc_id").alias("own"))
    met = seen.join(cyclic, "node").join(own, "start", "left").where("own is null or own <> scc_id")
    best = met.groupBy("start", "scc_id").agg(F.min(F.struct("n", "place", "node")).alias("b"))
    ways = cut(best.select("start", "scc_id", F.col("b.node").alias("entry"), F.col("b.node").alias("node"), F.array("b.node").alias("path")), "back")
    for _ in range(n):
        back = ways.join(seen.select("start", "node", "came"), ["start", "node"])
        after = cut(back.select("start", "scc_id", "entry", F.coalesce("came", "node").alias("node"), F.when(F.col("came").isNull(), F.col("path")).otherwise(F.concat(F.array("came"), "path")).alias("path")), "back")
        release(ways)
        ways = after
    return ways.select("start", "scc_id", "entry", "path")
