"""The whole analysis of a project, stage by stage, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.config import Config
from knotwork.functions import paths
from knotwork.operators import cycles as C
from knotwork.operators import extract as E
from knotwork.operators import graph as G
from knotwork.operators import reach as A
from knotwork.operators import resolve as R
from knotwork.operators import trace as T
from knotwork.operators.lineage import cut
from knotwork.operators.scc import strong_components


@dataclass
class Analysis:
    """What the stages found. Frames that several later stages read are tables in the shared folder."""

    config: Config
    files: DataFrame
    facts: DataFrame
    deps: DataFrame
    unresolved: DataFrame
    suppressed_edges: DataFrame
    winners: DataFrame
    collisions: DataFrame
    all_nodes: DataFrame
    all_edges: DataFrame
    nodes: DataFrame
    edges: DataFrame
    scc: DataFrame
    sized: DataFrame  # of the right size, with ``ignored``
    marked: DataFrame  # not dir-ignored, with ``suppressed``
    kept: DataFrame  # reported, numbered
    ignore: DataFrame
    excluded: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    direct_edges: DataFrame | None = None

    def cyclic_files(self, direct_fallback: bool = False) -> DataFrame:
        """Files in cycles of the right size outside ignored directories, whatever the ignore list says."""
        found = self.sized.where("not ignored")
        if direct_fallback and self.direct_edges is not None:
            return C.cyclic_files_direct(found, self.direct_edges)
        return C.cyclic_files(found)


def _excluded(nodes: DataFrame, raws: list[str], roots: list[str], warnings: list[str]) -> tuple[DataFrame | None, list[str]]:
    found, shown = None, []
    for raw in raws:
        match, hint = T.match_or_hint(nodes, raw, roots)
        if match is None:
            if hint:
                warnings.append(f"warning: '{paths.normalize_path(raw)}' is no path of the project; did you mean '{hint}'?")
            warnings.append(f"warning: nothing to exclude at '{raw}'")
            continue
        kind, rows = match
        shown.append(paths.normalize_path(raw) + ("/" if kind == "directory" else ""))
        found = rows if found is None else found.union(rows)
    return found, shown


def analyse(spark: SparkSession, config: Config, sources: DataFrame, excludes: list[str] | None = None, package_only: bool = False, direct: bool = False) -> Analysis:
    """Run the stages over ``sources`` (root_ord, root, file_ord, rel_path, walked, source, error).

    excludes: paths, after those of the settings. package_only: report cycles inside one package only. direct: also keep
    the graph of direct imports, for the baseline that falls back to it.
    """
    roots, warnings = list(config.source_roots), []
    files = cut(E.files_of(sources), "files")
    facts = cut(E.extract_facts(sources, config.parse.options()), "facts")
    index = R.module_index(files)
    resolved = R.resolve(E.raw_imports(facts), index, config.parse.string_imports_mode, config.parse.string_imports_min_dots, config.resolve.include_ancestor_init)
    deps, suppressed = cut(resolved["deps"], "deps"), resolved["suppressed"]
    winners, all_nodes = G.module_winners(files, placed=True), G.nodes_of(files)
    all_edges = cut(G.file_edges(deps, winners), "edges")
    if config.resolve.include_ancestor_init and config.resolve.include_self_ancestor_init:
        all_edges = cut(G.restore_suppressed(all_nodes, all_edges, winners, suppressed), "restored")

    excluded, shown = _excluded(all_nodes, list(dict.fromkeys([*config.exclude, *(excludes or [])])), roots, warnings)
    nodes, edges = all_nodes, all_edges
    direct_edges = G.file_edges(deps.where("not derived"), winners) if direct else None
    if excluded is not None:
        excluded = cut(excluded.distinct(), "excluded")
        nodes, edges = A.apply_exclusions(all_nodes, all_edges, excluded)
        edges = cut(edges, "effective")
        if direct_edges is not None:
            direct_edges = A.apply_exclusions(all_nodes, direct_edges, excluded)[1]

    scc = cut(strong_components(nodes, edges), "components")
    c = config.cycles
    sized = C.by_size(C.cycles_of(scc, edges), c.min_scc_size, c.max_scc_size)
    sized = cut(C.dir_ignored(sized, list(c.ignore_dirs)), "sized")
    ignore = C.ignore_frame(spark, [list(entry.files) for entry in c.ignore])
    marked = C.list_ignored(sized.where("not ignored"), ignore)
    kept = marked.where("not suppressed")
    if package_only:
        kept = C.within_package(kept, roots)
    kept = cut(C.ordered(kept.select("scc_id", "members", "size"), roots), "kept")
    warnings += _ignore_warnings(spark, config, ignore, marked)
    return Analysis(
        config, files, facts, deps, resolved["unresolved"], suppressed, winners, G.module_collisions(files), all_nodes, all_edges,
        nodes, edges, scc, sized, marked, kept, ignore, shown, warnings, direct_edges,
    )


def _ignore_warnings(spark: SparkSession, config: Config, ignore: DataFrame, marked: DataFrame) -> list[str]:
    said = []
    if not config.cycles.ignore:
        return said
    missed = C.unmatched_ignores(ignore, marked.where("suppressed")).orderBy("entry").collect()
    for row in missed:
        said.append(f"warning: ignore entry [{', '.join(row['members'])}] did not match any detected cycle")
        files = config.cycles.ignore[row["entry"]].files
        for root in config.source_roots:
            below = [f"{root.rstrip('/')}/{f}" for f in files]
            if C.ignore_frame(spark, [below]).join(marked, "members", "left_semi").limit(1).count():
                quoted = ", ".join(f'"{f}"' for f in below)
                said.append(f"  hint: its paths look relative to a source root; write them from the project root: files = [{quoted}]")
                break
    return said


def traces(a: Analysis, raws: list[str]) -> tuple[list[dict], list[str], list[str]]:
    """(traced paths as the report has them, unknown paths, warnings)."""
    roots = list(a.config.source_roots)
    matched, unknown, said = [], [], []
    for raw in dict.fromkeys(raws):
        match, hint = T.match_or_hint(a.nodes, raw, roots)
        if match is None:
            if hint:
                said.append(f"warning: '{paths.normalize_path(raw)}' is no path of the project; did you mean '{hint}'?")
            said.append(f"warning: nothing to trace at '{raw}'")
            unknown.append(raw)
        else:
            matched.append((paths.normalize_path(raw), *match))
    if not matched:
        return [], unknown, said
    starts = matched[0][2]
    for _, _, rows in matched[1:]:
        starts = starts.union(rows)
    starts = cut(starts.distinct(), "starts")
    found: dict[str, list] = {}
    for row in T.impacts(a.edges, a.kept, starts).collect():  # the report's own rows
        found.setdefault(row["node"], []).append(row)
    shown = []
    for path, kind, rows in matched:
        entries = []
        for node in paths.sort_paths(r["path"] for r in rows.collect()):
            impacts = []
            for row in sorted(found.get(node, []), key=lambda r: r["scc_id"].split("/")):
                impact = {"cycle_index": row["cycle_index"], "relationship": row["relationship"], "entry": row["entry"]}
                if row["from_lines"]:
                    impact["from_lines"] = list(row["from_lines"])
                if row["path"]:
                    impact["path"] = [{"from": h["from"], "to": h["to"], "lines": list(h["lines"])} for h in row["path"]]
                impacts.append(impact)
            entries.append({"path": node} | ({"impacts": impacts} if impacts else {}))
        shown.append({"path": path + ("/" if kind == "directory" else ""), "kind": kind, "files": entries})
    return shown, unknown, said
