"""Reports as JSON and text, and reading a JSON report back."""

from __future__ import annotations

import json
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import paths
from knotwork.operators import cycles as C
from knotwork.plans.analysis import Analysis

VERSION = 2
SCHEMA = (
    "version int, summary struct<cycles_reported:long,cycles_suppressed:long>, "
    "cycles array<struct<index:long,packages:array<string>,size:long,files:array<struct<path:string,import_lines:array<int>,edges:array<struct<to:string,lines:array<int>>>>>>>, "
    "traced array<struct<path:string,kind:string,files:array<struct<path:string,impacts:array<struct<cycle_index:long,relationship:string,entry:string,"
    "from_lines:array<int>,path:array<struct<from:string,to:string,lines:array<int>>>>>>>>>, "
    "unknown_paths array<string>, excluded array<string>, cyclic_files array<string>"
)


class ReportError(ValueError):
    """A report that can't be read."""


def plural(n: int, word: str) -> str:
    return f"{n} {word}" if n == 1 else f"{n} {word}s"


def cycle_rows(a: Analysis) -> list[dict]:
    """Cycles with their files, in report order: what the report shows is collected, and nothing else."""
    files: dict[str, list] = {}
    for row in C.report_files(a.kept, a.all_edges).collect():
        files.setdefault(row["scc_id"], []).append(row)
    found = []
    for row in a.kept.orderBy("cycle_index").collect():
        members = sorted(files[row["scc_id"]], key=lambda r: r["path"].split("/"))
        found.append(
            {
                "index": row["cycle_index"],
                "packages": list(row["packages"]),
                "size": row["size"],
                "files": [
                    {"path": m["path"], "import_lines": list(m["import_lines"]), "edges": [{"to": e["to"], "lines": list(e["lines"])} for e in m["edges"]]}
                    for m in members
                ],
            }
        )
    return found


def suppressed_counts(a: Analysis) -> tuple[int, int]:
    """(by the ignore list, by ignored directories)."""
    return a.marked.where("suppressed").count(), a.sized.where("ignored").count()


def json_report(a: Analysis, traced: list[dict] | None = None, unknown: list[str] | None = None, cyclic: list[str] | None = None) -> dict:
    cycles = cycle_rows(a)
    report = {"version": VERSION, "summary": {"cycles_reported": len(cycles), "cycles_suppressed": sum(suppressed_counts(a))}, "cycles": cycles}
    optional = {"traced": traced, "unknown_paths": unknown, "excluded": a.excluded, "cyclic_files": cyclic}
    return report | {k: v for k, v in optional.items() if v}


def show(value: dict) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(the report as one row, the report): read and checked for version, count, indexes and sizes."""
    try:
        with open(path, encoding="utf-8") as f:
            return parse(spark, f.read(), path)
    except (OSError, UnicodeDecodeError) as e:
        raise ReportError(f"failed to read {path}: {e}") from e


def parse(spark: SparkSession, text: str, name: str = "the text") -> tuple[DataFrame, dict]:
    """``load`` of a report's text."""
    try:
        report = json.loads(text)
    except ValueError as e:
        raise ReportError(f"no JSON report: {name}: {e}") from e
    check(report)
    row = spark.createDataFrame([(text,)], "report string").select(F.from_json("report", SCHEMA).alias("r"))
    return row.select("r.*"), report


def check(report: dict) -> None:
    try:
        version, reported, cycles = report["version"], report["summary"]["cycles_reported"], report["cycles"]
    except (KeyError, TypeError) as e:
        raise ReportError(f"the report lacks {e}") from e
    if version != VERSION:
        raise ReportError(f"report version {version} is not {VERSION}")
    if reported != len(cycles):
        raise ReportError(f"the summary has {reported} cycles, the report {len(cycles)}")
    for i, cycle in enumerate(cycles, 1):
        if cycle["index"] != i:
            raise ReportError(f"cycle {cycle['index']} stands in place {i}")
        if cycle["size"] != len(cycle["files"]):
            raise ReportError(f"cycle {i} has size {cycle['size']} and {len(cycle['files'])} files")


def statistics(report: DataFrame) -> dict[str, DataFrame]:
    """Totals, packages and sizes of a loaded report."""
    cycles = report.select(F.explode("cycles").alias("c")).select("c.*")
    members = F.transform("files", lambda f: f["path"])
    named = cycles.select(F.col("index").alias("scc_id"), members.alias("members"), "packages", "size")
    return {
        "totals": C.totals(named),
        "packages": C.package_frequency(named).orderBy(F.desc("cycles"), "package"),
        "sizes": C.size_distribution(named).orderBy("size"),
    }


def source_lines(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, line, text): the source of import lines (path, line); one that opens a parenthesis is joined up to its end."""
    lines = F.transform(F.split("source", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = sources.where("source is not null").select(F.col("rel_path").alias("path"), lines.alias("lines")).dropDuplicates(["path"])
    met = wanted.select("path", "line").distinct().join(rows, "path").where("line between 1 and size(lines)")
    rest = F.slice("lines", F.col("line"), F.size("lines"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("state"))

    def grow(acc, line):
        # 0: nothing yet, 1: inside a parenthesis, 2: done
        opens = F.contains(line, F.lit("(")) & ~F.contains(line, F.lit(")"))
        state = F.when(acc["state"] == 0, F.when(opens, 1).otherwise(2)).when(F.contains(line, F.lit(")")), 2).otherwise(1)
        text = F.when(acc["state"] == 0, line).otherwise(F.concat_ws(" ", acc["text"], line))
        return F.when(acc["state"] == 2, acc).otherwise(F.struct(text.alias("text"), state.alias("state")))

    return met.select("path", "line", F.aggregate(rest, start, grow)["text"].alias("text"))


# == text


def _lines_of(lines: list[int]) -> str:
    if not lines:
        return ""
    return f" (import at line {lines[0]})" if len(lines) == 1 else f" (imports at lines {', '.join(map(str, lines))})"


def cycles_text(a: Analysis, package_only: bool) -> list[str]:
    cycles = cycle_rows(a)
    by_list, by_dirs = suppressed_counts(a)
    out = ["", f"--- dependency cycles ({len(cycles)}) ---"]
    if by_list:
        out.append(f"({by_list} cycles suppressed by ignore list)")
    if by_dirs:
        out.append(f"({by_dirs} cycles ignored by ignore-dirs)")
    if package_only:
        out.append("(filtered to intra-package cycles)")
    for packages, run in groupby(cycles, key=lambda c: c["packages"]):
        run = list(run)
        label = "(root-level)" if not packages else f"package: {packages[0]}" if len(packages) == 1 else f"(cross-package: {', '.join(packages)})"
        out += ["", f"{label} ({plural(len(run), 'cycle')})"]
        for cycle in run:
            out += ["", f"cycle {cycle['index']} ({cycle['size']} files)"]
            out += [f"  {f['path']}{_lines_of(f['import_lines'])}" for f in cycle["files"]]
    return out


def _impacts_text(file: dict) -> list[str]:
    impacts = file.get("impacts", [])
    out = [f"    impacted by {plural(len(impacts), 'cycle')}:"]
    for x in impacts:
        if x["relationship"] == "member":
            out.append(f"      cycle {x['cycle_index']} (member)")
        else:
            way = " -> ".join([*(f"{h['from']}:{','.join(map(str, h['lines']))}" for h in x["path"]), x["entry"]])
            out.append(f"      cycle {x['cycle_index']} (reachable via {way})")
    return out


def traces_text(traced: list[dict], unknown: list[str]) -> list[str]:
    out = ["", "--- cycle impact ---"]
    for trace in traced:
        hit = [f for f in trace["files"] if f.get("impacts")]
        if trace["kind"] == "directory":
            out += ["", f"trace: {trace['path']} (directory, {len(hit)} of {len(trace['files'])} files impacted)"]
            for file in hit:
                out += [f"  {file['path']}:", *_impacts_text(file)]
            if not hit:
                out.append("  no cycles impact this path")
        else:
            out += ["", f"trace: {trace['path']} (file)"]
            out += _impacts_text(hit[0]) if hit else ["  not impacted by any cycle"]
    if unknown:
        out += ["", f"(unknown paths: {', '.join(unknown)})"]
    return out


def verbose_text(a: Analysis) -> list[str]:
    """Files, imports, dependencies and the graph. All of it is text for the screen, so all of it is collected."""
    out = []
    files = a.files.orderBy("root_ord", "file_ord").collect()
    for _, group in groupby(files, key=lambda f: f["root_ord"]):
        group = list(group)
        out += ["", f"source root: {group[0]['root']} ({len(group)} files)"]
        out += [f"  {f['rel_path']} -> {f['module']}" for f in group]
    out += ["", f"total: {len(files)} Python files", "", "--- imports ---"]
    kinds = {"import": "import", "from": "from  ", "string": "string"}
    rows = a.facts.where(F.col("kind").isin(*kinds)).orderBy("root_ord", "file_ord", "stmt_ord").collect()
    for (_, _, module), group in groupby(rows, key=lambda r: (r["root_ord"], r["file_ord"], r["source_module"])):
        out += ["", f"  {module}:"]
        out += [f"    {kinds[r['kind']]} {'.' * r['level']}{r['module'] or ''} ({', '.join(n['name'] for n in r['names'])})" for r in group]
    deps = a.deps.orderBy("source", "target", "line").collect()
    missed = a.unresolved.orderBy("source", "import_path").collect()
    out += ["", f"--- resolved first-party dependencies ({len(deps)}) ---", *(f"  {d['source']} -> {d['target']}" for d in deps)]
    out += ["", f"--- unresolved imports ({len(missed)}) ---", *(f"  {u['source']} -> {u['import_path']}" for u in missed)]
    out += ["", "--- dependency graph ---", ""]
    after: dict[str, list[str]] = {r["path"]: [] for r in a.all_nodes.collect()}
    for edge in a.all_edges.select("src", "dst").collect():
        after.setdefault(edge["src"], []).append(edge["dst"])
    for node in paths.sort_paths(after):
        out += [node, *(f"  -> {dst}" for dst in paths.sort_paths(after[node]))]
    return out


def event_warnings(a: Analysis) -> list[str]:
    """Files that couldn't be read or parsed, in discovery order, and modules of several files."""
    from knotwork.operators.extract import extract_errors

    out = []
    for e in extract_errors(a.facts).orderBy("root_ord", "file_ord").collect():
        out.append(f"  warning: could not read {e['rel_path']}: {e['message']}" if e["stage"] == "read" else f"  warning: parse error in {e['module']}: {e['message']}")
    for c in a.collisions.orderBy("module").collect():
        out.append(f"warning: module '{c['module']}' is defined by multiple files: {', '.join(c['paths'])}")
    return out


def cyclic_toml(files: list[str], derived: bool) -> list[str]:
    head = ["# belongs under [cycles] of knotwork.toml", "[cycles]", *(["ignore-derived-ancestor-init = true"] if derived else [])]
    return head + (["cyclic-files = [", *(f'    "{f}",' for f in files), "]"] if files else ["cyclic-files = []"])


def ignores_toml(cycles: list[list[str]]) -> list[str]:
    return [line for c in cycles for line in ("[[cycles.ignore]]", "files = [" + ", ".join(sorted(f'"{f}"' for f in c)) + "]", "")]
