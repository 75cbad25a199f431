"""Queries on one small project from its sources to its reports, with the rows that they must give."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork import config as settings
from knotwork.operators import cycles as C
from knotwork.operators import trace as T
from knotwork.plans import config_edit, html, reports
from knotwork.plans.analysis import Analysis, analyse, traces
from knotwork.plans.golden import _sources, query, table

FILES = {
    "bad.py": "def (", "lone/x.py": "import lone.y\n", "lone/y.py": "import lone.x\n", "web/__init__.py": "", "web/a.py": "from web import b\n",
    "web/b.py": "\nfrom web import a\nimport web.c\n", "web/c.py": "from web import (\n    b,\n)\n", "web/main.py": "from web import a\n", "web/quiet.py": "",
}
A, B, Q = "src/web/a.py", "src/web/b.py", "src/web/c.py"
LONE = ["src/lone/x.py", "src/lone/y.py"]
CONFIG = '# kept\nsource-roots = ["src"]\n\n[cycles]\nmax-cycles = 1 # one\n'


def project(spark: SparkSession, text: str = CONFIG, **more) -> Analysis:
    return analyse(spark, settings.load(text), _sources(spark, FILES), **more)


def lines_of(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Lines with their numbers, from 1."""
    return table(spark, list(enumerate(lines, 1)) or [(0, "")], "n int, line string")


def numbered(lines: list[str]) -> list[tuple[int, str]]:
    return list(enumerate(lines, 1))


CYCLES_TEXT = ["", "--- dependency cycles (2) ---", "", "package: lone (1 cycle)", "", "cycle 1 (2 files)", *(f"  {f} (import at line 1)" for f in LONE), "", "package: web (1 cycle)",
               "", "cycle 2 (3 files)", f"  {A} (import at line 1)", f"  {B} (imports at lines 2, 3)", f"  {Q} (import at line 1)"]


@query("n INTEGER, line VARCHAR", numbered(CYCLES_TEXT))
def report_text(spark, sf_dir):
    """The report as text."""
    return lines_of(spark, reports.cycles_text(project(spark), False))


@query("cycle BIGINT, packages VARCHAR, size BIGINT, path VARCHAR, import_lines VARCHAR, edges VARCHAR, reported BIGINT, suppressed BIGINT", [
    (1, "web", 3, A, "1", f"{B}:1", 1, 1), (1, "web", 3, B, "2,3", f"{A}:2;{Q}:3", 1, 1), (1, "web", 3, Q, "1", f"{B}:1", 1, 1),
])
def report_json(spark, sf_dir):
    """The report written as JSON and read back, one cycle in an ignored directory."""
    a = project(spark, CONFIG + 'ignore-dirs = ["src/lone/"]\n')
    frame, _ = reports.parse(spark, reports.show(reports.json_report(a)))
    files = frame.select("summary", F.explode("cycles").alias("c")).select("summary", "c.*").select("*", F.explode("files").alias("f"))
    shown = F.transform("f.edges", lambda e: F.concat(e["to"], F.lit(":"), F.array_join(e["lines"].cast("array<string>"), ",")))
    return files.select(
        F.col("index").alias("cycle"), F.array_join("packages", ",").alias("packages"), "size", F.col("f.path").alias("path"),
        F.array_join(F.col("f.import_lines").cast("array<string>"), ",").alias("import_lines"), F.array_join(shown, ";").alias("edges"),
        F.col("summary.cycles_reported").alias("reported"), F.col("summary.cycles_suppressed").alias("suppressed"),
    )


TRACE_TEXT = ["", "--- cycle impact ---", "", "trace: src/web/main.py (file)", "    impacted by 1 cycle:", f"      cycle 2 (reachable via src/web/main.py:1 -> {A})",
              "", "trace: src/web/ (directory, 4 of 6 files impacted)", f"  {A}:", "    impacted by 1 cycle:", "      cycle 2 (member)", f"  {B}:", "    impacted by 1 cycle:",
              "      cycle 2 (member)", f"  {Q}:", "    impacted by 1 cycle:", "      cycle 2 (member)", "  src/web/main.py:", "    impacted by 1 cycle:",
              f"      cycle 2 (reachable via src/web/main.py:1 -> {A})", "", "trace: src/web/quiet.py (file)", "  not impacted by any cycle", "", "(unknown paths: web/a.py, none)"]


@query("n INTEGER, line VARCHAR", numbered(TRACE_TEXT))
def trace_text(spark, sf_dir):
    """What affects a file, a directory, a clean file, and paths that are none of the project's."""
    traced, unknown, _ = traces(project(spark), ["src/web/main.py", "./src/web/", "src/web/quiet.py", "web/a.py", "none", "none"])
    return lines_of(spark, reports.traces_text(traced, unknown))


@query("raw VARCHAR, kind VARCHAR, files INTEGER, hint VARCHAR", [
    ("src/web", "directory", 6, None), (A, "file", 1, None), (A + "/", None, 0, None), ("web/a.py", None, 0, A), ("web/", None, 0, "src/web"), ("zzz", None, 0, None),
])
def path_hints(spark, sf_dir):
    """Paths of users, and what one below a source root should have been."""
    nodes = project(spark).nodes
    rows = []
    for raw in ("src/web", A, A + "/", "web/a.py", "web/", "zzz"):
        found, hint = T.match_or_hint(nodes, raw, ["src"])
        rows.append((raw, found[0] if found else None, found[1].count() if found else 0, hint))
    return table(spark, rows, "raw string, kind string, files int, hint string")


@query("n INTEGER, line VARCHAR", numbered(["excluded src/lone/", f"excluded {A}", "warning: nothing to exclude at 'gone'", f"cycle 1: {A},{B},{Q}"]))
def exclude_patterns(spark, sf_dir):
    """Exclusions of the settings and the command line, each once: an unused directory goes, a file that is imported stays."""
    a = project(spark, 'source-roots = ["src"]\nexclude = ["src/lone/"]\n', excludes=["src/lone/", A, "gone"])
    kept = [f"cycle {r['cycle_index']}: {','.join(r['members'])}" for r in a.kept.orderBy("cycle_index").collect()]
    return lines_of(spark, [*(f"excluded {x}" for x in a.excluded), *a.warnings, *kept])


@query("n INTEGER, line VARCHAR", numbered(["  warning: parse error in bad"]))
def event_lines(spark, sf_dir):
    """Files that give no imports are told of, in discovery order."""
    return lines_of(spark, [":".join(w.split(":")[:2]) for w in reports.event_warnings(project(spark))])


@query("n INTEGER, line VARCHAR", numbered(["[[cycles.ignore]]", 'files = ["src/lone/x.py", "src/lone/y.py"]', "", "[[cycles.ignore]]", f'files = ["{A}", "{B}", "{Q}"]', ""]))
def dump_ignores(spark, sf_dir):
    """Cycles as entries of an ignore list."""
    return lines_of(spark, reports.ignores_toml([r["members"] for r in project(spark).kept.orderBy("scc_id").collect()]))


@query("n INTEGER, line VARCHAR", numbered(["# belongs under [cycles] of knotwork.toml", "[cycles]", "cyclic-files = [", *(f'    "{f}",' for f in (*LONE, A, B, Q)), "]"]))
def dump_cyclic_files(spark, sf_dir):
    """Cyclic files as a piece of settings."""
    files = sorted(r["path"] for r in project(spark).cyclic_files().collect())
    return lines_of(spark, reports.cyclic_toml(files, False))


WRITTEN = ["# kept", 'source-roots = ["src"]', "", "[cycles]", "max-cycles = 1 # one", "cyclic-files = [", '    "a.py",', '    "b/c.py",', "]", "", "[[cycles.ignore]]", 'files = ["x.py", "y.py"]', ""]


@query("n INTEGER, line VARCHAR", numbered(WRITTEN))
def config_written(spark, sf_dir):
    """Settings after a list of cyclic files and an ignored cycle are written, twice."""
    text = CONFIG
    for _ in range(2):
        text = config_edit.merge_ignored_cycles(config_edit.set_cyclic_files(text, ["b\\c.py", "a.py"]), [["y.py", "x.py"], ["x.py", "y.py"]])
    return lines_of(spark, text.split("\n"))


TRIED = {
    "plain": "", "no size": "[cycles]\nmin-scc-size = 0", "small most": "[cycles]\nmin-scc-size = 3\nmax-scc-size = 2", "empty entry": "[[cycles.ignore]]\nfiles = []",
    "absolute": '[cycles]\ncyclic-files = ["/a"]', "drive": 'exclude = ["C:/a"]', "blank": '[cycles]\nignore-dirs = [" "]', "unknown key": "more = 1", "mode": '[parse]\nstring-imports-mode = "x"',
}


@query("name VARCHAR, valid BOOLEAN", [(k, k in ("plain", "unknown key")) for k in TRIED] + [("nested roots", False), ("twice", False), ("dot and named", True), ("no roots", False)])
def config_checks(spark, sf_dir):
    """Settings that can be used, and those that can't."""
    tried = {k: f'source-roots = ["src"]\n{v}' for k, v in TRIED.items()}
    tried |= {"nested roots": 'source-roots = ["a", "a/b"]', "twice": 'source-roots = ["a", "a/"]', "dot and named": 'source-roots = [".", "lib"]', "no roots": ""}
    rows = []
    for name, text in tried.items():
        try:
            settings.load(text)
            rows.append((name, True))
        except settings.ConfigError:
            rows.append((name, False))
    return table(spark, rows, "name string, valid boolean")


@query("path VARCHAR, line INTEGER, text VARCHAR", [(Q, 1, "from web import ( b, )"), (B, 3, "import web.c"), (A, 1, "from web import b")])
def source_lines(spark, sf_dir):
    """Source of import lines; what a parenthesis spreads over lines is one line."""
    wanted = table(spark, [(Q, 1), (B, 3), (A, 1), (A, 99), ("gone.py", 1)], "path string, line int")
    return reports.source_lines(_sources(spark, FILES), wanted)


@query("name VARCHAR, good BOOLEAN", [("right", True), ("version", False), ("count", False), ("index", False), ("size", False), ("lacking", False)])
def report_checks(spark, sf_dir):
    """Reports that read back, and those whose numbers disagree."""
    cycle = {"index": 1, "packages": [], "size": 1, "files": [{"path": "a.py", "import_lines": [], "edges": []}]}
    right = {"version": 2, "summary": {"cycles_reported": 1, "cycles_suppressed": 0}, "cycles": [cycle]}
    tried = {"right": right, "version": right | {"version": 1}, "count": right | {"cycles": []}, "index": right | {"cycles": [cycle | {"index": 2}]},
             "size": right | {"cycles": [cycle | {"size": 2}]}, "lacking": {"version": 2}}
    rows = []
    for name, value in tried.items():
        try:
            reports.parse(spark, json.dumps(value))
            rows.append((name, True))
        except reports.ReportError:
            rows.append((name, False))
    return table(spark, rows, "name string, good boolean")


class _Text(HTMLParser):
    """What a page says, piece by piece, with where its links lead."""

    def __init__(self, page: str) -> None:
        super().__init__()
        self.said: list[str] = []
        self._mute = False
        self.feed(page)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._mute = tag in ("style", "script")
        self.said += [f"-> {value}" for name, value in attrs if name == "href"]

    def handle_endtag(self, tag: str) -> None:
        self._mute = False

    def handle_data(self, data: str) -> None:
        text = re.sub(r"\d{4}-\d\d-\d\d", "", data).strip()
        if text and not self._mute:
            self.said.append(text)


REPORT_PAGE = [
    "Import cycles", "Import cycles", "2", "Cycles Reported", "0", "Left Out", "5", "Files in Them", "Cycles by Package", "Package", "Cycles", "lone",
    "1", "web", "1", "Cycles by Size", "Files", "Cycles", "2", "1", "3", "1", "Cycles", "#", "Packages", "Size", "Files", "1", "lone", "2",
    "src/lone/x.py (L1)", "src/lone/y.py (L1)", "src/lone/x.py", "L1 → src/lone/y.py", "src/lone/y.py", "L1 → src/lone/x.py", "2", "web", "3",
    "src/web/a.py (L1)", "src/web/b.py (L2, L3)", "src/web/c.py (L1)", "src/web/a.py", "1", "from web import b  # <b>", "→ src/web/b.py",
    "src/web/b.py", "L2 → src/web/a.py", "L3 → src/web/c.py", "src/web/c.py", "L1 → src/web/b.py", "Files in Cycles", "5 files", "src/lone/x.py",
    "src/lone/y.py", "src/web/a.py", "src/web/b.py", "src/web/c.py", "Traced Paths", "Traced", "File or directory", "Result",
    "-> r_trace_src_web.html", "src/web/", "directory", "4 of 6 files impacted",
]
TRACE_PAGE = [
    "src/web/", "src/web/", "-> r.html", "all cycles", "1", "Cycles", "4", "Impacted", "6", "Scanned", "3", "In cycle", "1", "Leads to a cycle",
    "src/web/a.py", "cycle 2: member", "src/web/b.py", "cycle 2: member", "src/web/c.py", "cycle 2: member", "src/web/main.py",
    "cycle 2: reachable via src/web/main.py:1 → src/web/a.py",
]


@query("page VARCHAR, n INTEGER, said VARCHAR", [(page, n, said) for page, every in (("report", REPORT_PAGE), ("trace", TRACE_PAGE)) for n, said in enumerate(every, 1)])
def html_pages(spark, sf_dir):
    """All that the HTML pages say, in order, and their links; the date is left out."""
    a = project(spark)
    traced, unknown, _ = traces(a, ["src/web"])
    cyclic = sorted(r["path"] for r in a.cyclic_files().collect())
    frame, loaded = reports.parse(spark, reports.show(reports.json_report(a, traced, unknown, cyclic)))
    stats = {k: v.collect() for k, v in reports.statistics(frame).items()}
    made = {
        "report": html.report_page(loaded, stats, "r", {(A, 1): "from web import b  # <b>"}),
        "trace": html.trace_html(loaded["traced"][0], "r.html", {1: 2, 2: 3}),
    }
    return table(spark, [(page, n, said) for page, text in made.items() for n, said in enumerate(_Text(text).said, 1)], "page string, n int, said string")


@query("gate VARCHAR, code INTEGER", [("strict", 1), ("strict, package", 1), ("budget 1", 1), ("budget 2", 0), ("baseline same", 0), ("baseline other", 1)])
def gates(spark, sf_dir):
    """Exit codes of the gates on the project."""
    from knotwork import cli

    quiet = cli.Console()
    quiet.warn = lambda *lines: None
    a = project(spark)
    count = a.kept.count()
    cyclic = [r["path"] for r in a.cyclic_files().collect()]
    with_list = lambda files: settings.Config(cycles=settings.Cycles(cyclic_files=tuple(files)))
    rows = [
        ("strict", int(count > 0)),
        ("strict, package", int(C.within_package(a.kept, ["src"]).count() > 0)),
        ("budget 1", cli.check_max_cycles(count, 1, quiet)),
        ("budget 2", cli.check_max_cycles(count, 2, quiet)),
        ("baseline same", cli.check_cyclic_files(with_list(cyclic), cyclic, quiet)),
        ("baseline other", cli.check_cyclic_files(with_list([" src/ghost.py"]), cyclic, quiet)),
    ]
    return table(spark, rows, "gate string, code int")
