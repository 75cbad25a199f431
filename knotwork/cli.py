"""Command line: find cycles of imports in a project, gate on them, record them, report them."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from knotwork import config as settings
from knotwork.functions import paths
from knotwork.plans import config_edit, html, reports
from knotwork.plans.analysis import analyse, traces
from knotwork.sources.python_tree import SOURCES, DiscoveryError, read_tree


def _listed(value: str) -> list[str]:
    return value.split(",")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="knotwork", description="Detect circular imports in Python projects.")
    commands = p.add_subparsers(dest="command")
    report = commands.add_parser("report", help="make HTML pages of a JSON report")
    report.add_argument("input")
    report.add_argument("-o", "--output", default="report.html")
    report.add_argument("--root", help="project whose import lines are shown")
    report.add_argument("--source-root", help=argparse.SUPPRESS)
    p.add_argument("--config", metavar="FILE")
    p.add_argument("--sources", metavar="TABLE", help="a Parquet table (root_ord, root, file_ord, rel_path, walked, source, error) instead of the tree")
    p.add_argument("--format", choices=("human", "json"), default="human")
    p.add_argument("-t", "--trace", dest="traces", metavar="PATH", type=_listed, action="extend", default=[])
    p.add_argument("--exclude", dest="excludes", metavar="PATH", type=_listed, action="extend", default=[])
    p.add_argument("--max-cycles", type=int)
    p.add_argument("-v", "--verbose", action="store_true")
    for flag in ("dump-ignores", "strict", "package", "no-include-ancestor-init", "dump-cyclic-files", "write", "check-cyclic-files", "check-max-cycles",
                 "show-cyclic-files", "ignore-derived-ancestor-init", "include-self-ancestor-init", "local-imports", "include-string-imports"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def _guards(o: argparse.Namespace, config_path: str | None) -> str | None:
    """What makes a combination of flags unusable."""
    if o.write and not (o.dump_cyclic_files or o.dump_ignores):
        return "--write goes with --dump-cyclic-files or --dump-ignores only"
    if o.write and o.check_cyclic_files:
        return "--write and --check-cyclic-files exclude each other"
    if o.write and config_path is None:
        return f"--write needs a {settings.FILE}, but there is none"
    if o.check_max_cycles and o.check_cyclic_files:
        return "only one of --check-max-cycles and --check-cyclic-files can run"
    return None


def overridden(config: settings.Config, o: argparse.Namespace) -> settings.Config:
    """The settings with what the command line says in their place."""
    if o.max_cycles is not None:
        config = config.override("cycles", max_cycles=o.max_cycles)
    if o.no_include_ancestor_init:
        config = config.override("resolve", include_ancestor_init=False)
    if o.ignore_derived_ancestor_init:
        config = config.override("cycles", ignore_derived_ancestor_init=True)
    if o.include_self_ancestor_init:
        config = config.override("resolve", include_self_ancestor_init=True)
    if o.local_imports:
        config = config.override("parse", local_imports=True)
    if o.include_string_imports:
        config = config.override("parse", string_imports=True)
    return config


def without_effect(config: settings.Config, cyclic_wanted: bool) -> list[str]:
    """Warnings of settings that another one makes idle."""
    said = []
    if not config.resolve.include_ancestor_init:
        if config.resolve.include_self_ancestor_init:
            said.append("warning: include-self-ancestor-init has no effect without include-ancestor-init")
        if config.cycles.ignore_derived_ancestor_init and cyclic_wanted:
            said.append("warning: ignore-derived-ancestor-init has no effect without include-ancestor-init")
    return said


class Console:
    """Where a run writes; tests read it back."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.err: list[str] = []

    def say(self, *lines: str) -> None:
        self.out.extend(lines)
        print(*lines, sep="\n")

    def warn(self, *lines: str) -> None:
        self.err.extend(lines)
        if lines:
            print(*lines, sep="\n", file=sys.stderr)


def run(args: list[str], spark: SparkSession | None = None, cwd: str | None = None, console: Console | None = None) -> int:
    """Exit code: 0 fine, 1 a finding or a failure, 2 a usage error."""
    console, cwd = console or Console(), cwd or os.getcwd()
    o = parser().parse_args(args)
    session = lambda: spark or SparkSession.builder.appName("knotwork").getOrCreate()
    if o.command == "report":
        if o.source_root:
            console.warn("warning: --source-root is an old name of --root")
        return report(o.input, o.output, o.root or o.source_root, session(), cwd, console)
    config_path = o.config or settings.find(cwd)
    if problem := _guards(o, config_path):
        console.warn(f"error: {problem}")
        return 2
    human = o.format == "human"
    verbose = human and o.verbose
    if config_path:
        if verbose:
            console.say(f"found config: {config_path}")
        with open(config_path, encoding="utf-8") as f:
            config = settings.load(f.read())
        project = os.path.dirname(os.path.abspath(config_path))
    else:
        if verbose:
            console.say(f"no {settings.FILE} found, using defaults")
        config, project = settings.Config(), cwd
    config = overridden(config, o)
    if o.check_max_cycles and config.cycles.max_cycles is None:
        console.warn("error: --check-max-cycles needs --max-cycles or max-cycles under [cycles]")
        return 2
    cyclic_wanted = o.dump_cyclic_files or o.check_cyclic_files or o.show_cyclic_files
    derived = config.cycles.ignore_derived_ancestor_init
    console.warn(*without_effect(config, cyclic_wanted))
    fallback = derived and config.resolve.include_ancestor_init and cyclic_wanted
    try:
        sources = session().read.schema(SOURCES).parquet(o.sources) if o.sources else read_tree(session(), project, list(config.source_roots))
    except DiscoveryError as e:
        console.warn(f"discovery error: {e}")
        return 1
    a = analyse(session(), config, sources, o.excludes, o.package, fallback)
    console.warn(*reports.event_warnings(a), *a.warnings)
    if verbose:
        console.say(*reports.verbose_text(a))
    if o.check_max_cycles:
        return check_max_cycles(a.kept.count(), config.cycles.max_cycles, console)
    cyclic = paths.sort_paths(r["path"] for r in a.cyclic_files(fallback).collect()) if cyclic_wanted else []
    if o.check_cyclic_files:
        return check_cyclic_files(config, cyclic, console)
    if o.dump_cyclic_files:
        if o.write:
            return write_cyclic_files(config_path, config, cyclic, human, console)
        if human:
            console.say(*reports.cyclic_toml(cyclic, derived))
        else:
            console.say(reports.show({"version": reports.VERSION, "ignore_derived_ancestor_init": derived, "cyclic_files": cyclic}))
        return 0
    if o.dump_ignores:
        cycles = [list(r["members"]) for r in a.kept.orderBy(paths.path_key("scc_id")).collect()]
        if o.write:
            return write_ignores(config_path, cycles, human, console)
        if human:
            console.say(*reports.ignores_toml(cycles))
        else:
            console.say(reports.show({"version": reports.VERSION, "ignore_entries": [{"files": sorted(c)} for c in cycles]}))
        return 0
    traced, unknown, said = traces(a, o.traces) if o.traces else ([], [], [])
    console.warn(*said)
    if human:
        console.say(*reports.cycles_text(a, o.package))
        if o.traces:
            console.say(*reports.traces_text(traced, unknown))
    else:
        console.say(reports.show(reports.json_report(a, traced, unknown, cyclic if o.show_cyclic_files else None)))
    if o.strict:
        found = any(f.get("impacts") for t in traced for f in t["files"]) if o.traces else a.kept.limit(1).count() > 0
        return int(found)
    return 0


def check_max_cycles(count: int, cap: int, console: Console) -> int:
    console.warn(f"cycle count {count} {'exceeds' if count > cap else 'within'} max-cycles {cap}")
    return int(count > cap)


def check_cyclic_files(config: settings.Config, cyclic: list[str], console: Console) -> int:
    known, computed = {f.strip().replace("\\", "/") for f in config.cycles.cyclic_files}, set(cyclic)
    if known == computed:
        console.warn(f"cyclic files unchanged ({len(computed)} files)")
        return 0
    console.warn("cyclic files changed:", *(f"  + {f}" for f in sorted(computed - known)), *(f"  - {f}" for f in sorted(known - computed)))
    return 1


def _written(path: str, edit, console: Console) -> bool | None:
    try:
        return config_edit.patch(path, edit)
    except (OSError, ValueError) as e:
        console.warn(f"error: failed to write {path}: {e}")
        return None


def write_cyclic_files(path: str, config: settings.Config, cyclic: list[str], human: bool, console: Console) -> int:
    changed = _written(path, lambda text: config_edit.set_cyclic_files(text, cyclic), console)
    if changed is None:
        return 1
    was = len(config.cycles.cyclic_files)
    console.warn(f"wrote {path}: cyclic-files {len(cyclic)} entries (was {was})" if changed else f"unchanged: cyclic-files {len(cyclic)} entries")
    if not human:
        console.say(json.dumps({"written": changed, "path": path, "cyclic_files": len(cyclic)}))
    return 0


def write_ignores(path: str, cycles: list[list[str]], human: bool, console: Console) -> int:
    with open(path, encoding="utf-8") as f:
        added = len(config_edit.missing_ignores(f.read(), cycles))
    changed = _written(path, lambda text: config_edit.merge_ignored_cycles(text, cycles), console)
    if changed is None:
        return 1
    console.warn(f"wrote {path}: added {added} ignore entries" if changed else "unchanged: no new ignore entries")
    if not human:
        console.say(json.dumps({"written": changed, "path": path, "added_entries": added}))
    return 0


def report(source: str, output: str, root: str | None, spark: SparkSession, cwd: str, console: Console) -> int:
    """HTML pages of a JSON report, with import lines where the project is at hand."""
    try:
        frame, loaded = reports.load(spark, source)
    except reports.ReportError as e:
        console.warn(f"error: {e}")
        return 1
    if root is None and (found := settings.find(cwd)):
        root = os.path.dirname(found)
    stats = {k: v.collect() for k, v in reports.statistics(frame).items()}
    code = {}
    if root:
        shown = sorted({f["path"] for c in loaded["cycles"] for f in c["files"] if os.path.isfile(os.path.join(root, f["path"]))})
        texts = []
        for path in shown:
            with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                texts.append((path, f.read()))
        edges = frame.select(F.explode("cycles").alias("c")).select(F.explode("c.files").alias("f")).select("f.path", F.explode("f.edges").alias("e"))
        wanted = edges.select("path", F.explode("e.lines").alias("line"))
        sources = spark.createDataFrame(texts, "rel_path string, source string")
        code = {(r["path"], r["line"]): r["text"] for r in reports.source_lines(sources, wanted).collect()}
    stem = os.path.splitext(os.path.basename(output))[0]
    pages = {output: html.report_page(loaded, stats, stem, code)}
    sizes = {c["index"]: c["size"] for c in loaded["cycles"]}
    for i, trace in enumerate(loaded.get("traced", [])):
        pages[os.path.join(os.path.dirname(output), paths.trace_page(stem, i, trace["path"]))] = html.trace_html(trace, os.path.basename(output), sizes)
    for path, text in pages.items():
        try:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        except OSError as e:
            console.warn(f"error: failed to write {path}: {e}")
            return 1
        console.warn(f"report written to {path}")
    return 0


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
