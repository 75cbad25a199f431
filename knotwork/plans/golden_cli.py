"""Queries on discovery, settings and the command line, with the rows that they must give."""

from __future__ import annotations

import json
import os
import shlex
import tempfile

from pyspark.sql import functions as F

from knotwork import cli
from knotwork import config as settings
from knotwork.operators import extract as E
from knotwork.operators.lineage import save, scratch
from knotwork.plans import reports
from knotwork.plans.analysis import analyse
from knotwork.plans.golden import query, table
from knotwork.plans.golden_project import lines_of, numbered, project
from knotwork.sources.python_tree import SOURCES, DiscoveryError, read_tree

TREE = {"src/kit/__init__.py": "", "src/kit/a.py": "from kit import b\n", "lib/tool.py": "import kit.a\n", "lib/.own.py": "", "top.py": "", "src/notes.md": ""}


def _tree(spark) -> str:
    folder = scratch(spark, "tree")
    for name, text in TREE.items():
        save(spark, f"{folder}/{name}", text.encode())
    return folder


class _Quiet(cli.Console):
    """Keeps what a run says to itself."""

    def say(self, *lines: str) -> None:
        self.out.extend(lines)

    def warn(self, *lines: str) -> None:
        self.err.extend(lines)


@query("root VARCHAR, problem VARCHAR", [("src", None), ("gone", "does not exist"), ("top.py", "is no directory")])
def bad_roots(spark, sf_dir):
    """A source root must be a folder that is there; which of both it isn't is told before anything is read."""
    folder, rows = _tree(spark), []
    for root in ("src", "gone", "top.py"):
        try:
            read_tree(spark, folder, [root])
            rows.append((root, None))
        except DiscoveryError as e:
            rows.append((root, next(p for p in ("does not exist", "is no directory") if p in str(e))))
    return table(spark, rows, "root string, problem string")


@query("roots VARCHAR, root_ord INTEGER, rel_path VARCHAR, module VARCHAR", [
    ("src lib", 0, "src/kit/__init__.py", "kit"), ("src lib", 0, "src/kit/a.py", "kit.a"), ("src lib", 1, "lib/.own.py", ".own"), ("src lib", 1, "lib/tool.py", "tool"),
    (". lib", 0, "lib/.own.py", "lib..own"), (". lib", 0, "lib/tool.py", "lib.tool"), (". lib", 0, "src/kit/__init__.py", "src.kit"), (". lib", 0, "src/kit/a.py", "src.kit.a"),
    (". lib", 0, "top.py", "top"), (". lib", 1, "lib/.own.py", ".own"), (". lib", 1, "lib/tool.py", "tool"),
])
def several_roots(spark, sf_dir):
    """Files of several roots have their root before their path; the project itself adds nothing, and finds files again."""
    folder, found = _tree(spark), None
    for roots in ("src lib", ". lib"):
        files = E.files_of(read_tree(spark, folder, roots.split())).select(F.lit(roots).alias("roots"), "root_ord", "rel_path", "module")
        found = files if found is None else found.unionByName(files)
    return found


@query("start VARCHAR, found VARCHAR", [("", "knotwork.toml"), ("a", "knotwork.toml"), ("a/b", "a/b/knotwork.toml"), ("a/b/c/d", "a/b/knotwork.toml")])
def config_found(spark, sf_dir):
    """The settings of a folder are those of the nearest one above it that has any."""
    with tempfile.TemporaryDirectory() as folder:
        os.makedirs(f"{folder}/a/b/c/d")
        for place in ("", "a/b/"):
            with open(f"{folder}/{place}{settings.FILE}", "w") as f:
                f.write('source-roots = ["src"]\n')
        rows = [(start, os.path.relpath(settings.find(os.path.join(folder, start)), folder)) for start in ("", "a", "a/b", "a/b/c/d")]
    return table(spark, rows, "start string, found string")


FLAGS = {
    "--write": True, "--write --dump-cyclic-files": False, "--write --dump-ignores": False, "--write --dump-cyclic-files --check-cyclic-files": True,
    "--check-max-cycles --check-cyclic-files": True, "--check-max-cycles --max-cycles 1": False, "--check-max-cycles": True, "--strict": False,
}


def _run(spark, args: str, config: str | None = 'source-roots = ["src"]\n') -> tuple[int, cli.Console, str | None]:
    """(exit code, what it said, the settings after it) of a run over the small tree, as a table of sources."""
    folder = scratch(spark, "sources")
    rows = [(0, "src", i, path, path.removeprefix("src/"), text, None) for i, (path, text) in enumerate(sorted(TREE.items())) if path.startswith("src/") and path.endswith(".py")]
    rows.append((0, "src", 9, "src/kit/b.py", "kit/b.py", "from kit import a\n", None))
    table(spark, rows, SOURCES).write.parquet(folder)
    console = _Quiet()
    with tempfile.TemporaryDirectory() as here:
        path = f"{here}/{settings.FILE}"
        if config is not None:
            with open(path, "w") as f:
                f.write(config)
        code = cli.run([*shlex.split(args), "--sources", folder], spark, here, console)
        after = None
        if os.path.isfile(path):
            with open(path) as f:
                after = f.read()
    return code, console, after


@query("flags VARCHAR, refused BOOLEAN", list(FLAGS.items()))
def flag_guards(spark, sf_dir):
    """Combinations of flags that are usage errors."""
    parse = cli.parser().parse_args
    known = lambda o: o.check_max_cycles and o.max_cycles is None
    rows = [(flags, bool(cli._guards(o := parse(flags.split()), "here.toml") or known(o))) for flags in FLAGS]
    return table(spark, rows, "flags string, refused boolean")


@query("setting VARCHAR, config VARCHAR, flags VARCHAR", [
    ("include_ancestor_init", "True", "False"), ("include_self_ancestor_init", "False", "True"), ("local_imports", "False", "True"), ("string_imports", "False", "True"),
    ("string_imports_mode", "all", "all"), ("min_scc_size", "3", "3"), ("max_cycles", "7", "2"), ("ignore_derived_ancestor_init", "False", "True"),
])
def precedence(spark, sf_dir):
    """What the command line says goes before the settings; what it can't say stays."""
    config = settings.load('source-roots = ["src"]\n[cycles]\nmax-cycles = 7\nmin-scc-size = 3\n[parse]\nstring-imports-mode = "all"\n')
    flags = "--max-cycles 2 --no-include-ancestor-init --include-self-ancestor-init --ignore-derived-ancestor-init --local-imports --include-string-imports"
    changed = cli.overridden(config, cli.parser().parse_args(flags.split()))
    same = cli.overridden(config, cli.parser().parse_args([]))
    places = {"resolve": ("include_ancestor_init", "include_self_ancestor_init"), "parse": ("local_imports", "string_imports", "string_imports_mode"),
              "cycles": ("min_scc_size", "max_cycles", "ignore_derived_ancestor_init")}
    rows = [(name, str(getattr(getattr(same, part), name)), str(getattr(getattr(changed, part), name))) for part, names in places.items() for name in names]
    return table(spark, rows, "setting string, config string, flags string")


@query("ancestors BOOLEAN, own BOOLEAN, derived BOOLEAN, cyclic BOOLEAN, warnings INTEGER", [
    (a, o, d, c, 0 if a else int(o) + int(d and c)) for a in (True, False) for o in (True, False) for d in (True, False) for c in (True, False)
])
def idle_settings(spark, sf_dir):
    """How many settings are said to have no effect, for every combination."""
    rows = []
    for a in (True, False):
        for o in (True, False):
            for d in (True, False):
                config = settings.Config().override("resolve", include_ancestor_init=a, include_self_ancestor_init=o).override("cycles", ignore_derived_ancestor_init=d)
                rows += [(a, o, d, c, len(cli.without_effect(config, c))) for c in (True, False)]
    return table(spark, rows, "ancestors boolean, own boolean, derived boolean, cyclic boolean, warnings int")


@query("setting VARCHAR, value VARCHAR", [
    ("source-roots", "src"), ("exclude", ""), ("local-imports", "False"), ("string-imports", "False"), ("string-imports-mode", "call-sites"), ("string-imports-min-dots", "2"),
    ("include-ancestor-init", "True"), ("include-self-ancestor-init", "False"), ("min-scc-size", "2"), ("max-scc-size", "None"), ("max-cycles", "None"), ("ignore", ""),
    ("cyclic-files", ""), ("ignore-derived-ancestor-init", "False"), ("ignore-dirs", ""),
])
def default_settings(spark, sf_dir):
    """What holds where nothing is said."""
    c = settings.Config()
    every = {"source_roots": c.source_roots, "exclude": c.exclude} | vars(c.parse) | vars(c.resolve) | vars(c.cycles)
    rows = [(name.replace("_", "-"), " ".join(value) if isinstance(value, tuple) else str(value)) for name, value in every.items()]
    return table(spark, rows, "setting string, value string")


@query("tried VARCHAR, outcome VARCHAR", [("tree", "0"), ("no such root", "1"), ("a file as root", "1"), ("broken settings", "ConfigError"), ("bad settings", "ConfigError")])
def failures(spark, sf_dir):
    """Exit codes of runs that can't find their sources; settings that can't be used raise."""
    tried = {"tree": 'source-roots = ["src"]', "no such root": 'source-roots = ["gone"]', "a file as root": 'source-roots = ["knotwork.toml"]',
             "broken settings": "source-roots = [", "bad settings": 'source-roots = ["src"]\n[cycles]\nmin-scc-size = 0'}
    rows = []
    for name, text in tried.items():
        with tempfile.TemporaryDirectory() as here:
            os.makedirs(f"{here}/src")
            with open(f"{here}/{settings.FILE}", "w") as f:
                f.write(text)
            try:
                rows.append((name, str(cli.run([], spark, here, _Quiet()))))
            except settings.ConfigError:
                rows.append((name, "ConfigError"))
    return table(spark, rows, "tried string, outcome string")


STATUS = [("--dump-cyclic-files", 1, 0, "written=True cyclic_files=2"), ("--dump-cyclic-files", 2, 0, "written=False cyclic_files=2"),
          ("--dump-ignores", 1, 0, "written=True added_entries=1"), ("--dump-ignores", 2, 0, "written=False added_entries=0")]


@query("flag VARCHAR, turn INTEGER, code INTEGER, status VARCHAR", STATUS)
def write_status(spark, sf_dir):
    """What a run says after it wrote settings, and after it had nothing more to write."""
    rows = []
    for flag in ("--dump-cyclic-files", "--dump-ignores"):
        text = 'source-roots = ["src"]\n'
        for turn in (1, 2):
            code, console, text = _run(spark, f"{flag} --write --format json", text)
            said = json.loads(console.out[-1])
            rows.append((flag, turn, code, " ".join(f"{k}={said[k]}" for k in ("written", "cyclic_files", "added_entries") if k in said)))
    return table(spark, rows, "flag string, turn int, code int, status string")


VERBOSE = ["", "source root: src (9 files)", "  src/bad.py -> bad", "  src/lone/x.py -> lone.x", "  src/lone/y.py -> lone.y", "  src/web/__init__.py -> web", "  src/web/a.py -> web.a",
           "  src/web/b.py -> web.b", "  src/web/c.py -> web.c", "  src/web/main.py -> web.main", "  src/web/quiet.py -> web.quiet", "", "total: 9 Python files", "", "--- imports ---",
           "", "  lone.x:", "    import  (lone.y)", "", "  lone.y:", "    import  (lone.x)", "", "  web.a:", "    from   web (b)", "", "  web.b:", "    from   web (a)", "    import  (web.c)",
           "", "  web.c:", "    from   web (b)", "", "  web.main:", "    from   web (a)", "", "--- resolved first-party dependencies (7) ---", "  lone.x -> lone.y", "  lone.y -> lone.x",
           "  web.a -> web.b", "  web.b -> web.a", "  web.b -> web.c", "  web.c -> web.b", "  web.main -> web.a", "", "--- unresolved imports (0) ---", "", "--- dependency graph ---", "",
           "src/bad.py", "src/lone/x.py", "  -> src/lone/y.py", "src/lone/y.py", "  -> src/lone/x.py", "src/web/__init__.py", "src/web/a.py", "  -> src/web/b.py", "src/web/b.py",
           "  -> src/web/a.py", "  -> src/web/c.py", "src/web/c.py", "  -> src/web/b.py", "src/web/main.py", "  -> src/web/a.py", "src/web/quiet.py"]


@query("n INTEGER, line VARCHAR", numbered(VERBOSE))
def verbose_lines(spark, sf_dir):
    """What a verbose run shows of files, imports, dependencies and the graph."""
    return lines_of(spark, reports.verbose_text(project(spark)))


@query("n INTEGER, line VARCHAR", numbered(["warning: could not read z/none.py", "warning: parse error in worse", "warning: parse error in bad", "warning: could not read lib/late.py"]))
def event_order(spark, sf_dir):
    """Files that give no imports, in the order of roots and of files in them, whatever order they came in."""
    rows = [(1, "lib", 7, "lib/late.py", "late.py", None, "gone"), (0, "z", 0, "z/none.py", "none.py", None, "gone"), (1, "lib", 0, "lib/bad.py", "bad.py", "def (", None),
            (0, "z", 3, "z/worse.py", "worse.py", "x = = 1", None), (0, "z", 1, "z/fine.py", "fine.py", "import os", None)]
    a = analyse(spark, settings.load('source-roots = ["z", "lib"]\n'), table(spark, rows, SOURCES))
    return lines_of(spark, [":".join(w.split(":")[:2]).strip() for w in reports.event_warnings(a)])
