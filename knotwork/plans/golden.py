"""Queries on small sources whose expected rows are known: the SQL beside each is a table of those rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import paths
from knotwork.functions.imports import ALL, CALL_SITES, ExtractOptions
from knotwork.operators import extract as E
from knotwork.operators import resolve as R
from knotwork.operators.lineage import save, scratch
from knotwork.sources.python_tree import read_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(columns: str, rows: list[tuple]):
    """Register a query with its rows; columns: names with types, as 'path VARCHAR, line INTEGER'."""
    names = [c.strip().split()[0] for c in columns.split(",")]
    casts = ", ".join(f"CAST({n} AS {c.strip().split()[1]}) AS {n}" for n, c in zip(names, columns.split(",")))
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(show(v) for v in row) + ")" for row in rows)

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"SELECT {casts} FROM (VALUES {values}) AS t({', '.join(names)})"
        return f

    return add


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# == names and paths


@query("path VARCHAR, module VARCHAR, package VARCHAR", [
    ("app.py", "app", None), ("pkg/__init__.py", "pkg", "pkg"), ("__init__.py", "", None), ("a/b/c.py", "a.b.c", "a"),
    ("foo.bar.py", "foo.bar", None), ("a-b/c.py", "a-b.c", "a-b"), ("pkg/sub/__init__.py", "pkg.sub", "pkg"),
])
def module_names(spark, sf_dir):
    """Modules and packages of paths."""
    rows = table(spark, [(p,) for p in ("app.py", "pkg/__init__.py", "__init__.py", "a/b/c.py", "foo.bar.py", "a-b/c.py", "pkg/sub/__init__.py")], "path string")
    return rows.select("path", paths.module_name("path").alias("module"), paths.package_of("path", []).alias("package"))


@query("source VARCHAR, level INTEGER, module VARCHAR, package BOOLEAN, target VARCHAR", [
    ("pkg.mod", 1, "other", False, "pkg.other"), ("pkg.mod", 2, "other", False, "other"), ("pkg.mod", 3, "x", False, None), ("", 1, "x", False, None),
    ("a.b.c", 2, "n.e", False, "a.n.e"), ("core.runner", 1, None, False, "core"), ("pkg", 1, "sub", True, "pkg.sub"), ("pkg", 1, None, True, "pkg"),
    ("pkg.sub", 2, "x", True, "pkg.x"),
])
def relative_resolve(spark, sf_dir):
    """Relative imports; in a package the first dot is itself; null climbs too far."""
    rows = table(spark, [
        ("pkg.mod", 1, "other", False), ("pkg.mod", 2, "other", False), ("pkg.mod", 3, "x", False), ("", 1, "x", False), ("a.b.c", 2, "n.e", False),
        ("core.runner", 1, None, False), ("pkg", 1, "sub", True), ("pkg", 1, None, True), ("pkg.sub", 2, "x", True),
    ], "source string, level int, module string, package boolean")
    return rows.select("*", paths.relative_target("source", paths.effective_level("level", "package"), "module").alias("target"))


@query("value VARCHAR, plain BOOLEAN, dotted BOOLEAN", [
    ("a.b.c", True, True), ("a.b", True, False), ("plugins", True, False), ("a..b", False, False), ("1a.b.c", False, False), ("_x.y.class", True, True),
    ("a b.c.d", False, False), ("é.ü.ñ1", True, True), ("", False, False), ("a.b.c.", False, False),
])
def string_candidate(spark, sf_dir):
    """Strings shaped like modules, without and with two dots."""
    values = ("a.b.c", "a.b", "plugins", "a..b", "1a.b.c", "_x.y.class", "a b.c.d", "é.ü.ñ1", "", "a.b.c.")
    return table(spark, [(v,) for v in values], "value string").select("value", paths.is_candidate("value", 0).alias("plain"), paths.is_candidate("value", 2).alias("dotted"))


@query("candidate VARCHAR, tries VARCHAR", [("k.l.m.n", "k.l.m.n,k.l.m"), ("k.l.m", "k.l.m"), ("k.l", ""), ("k", "")])
def shortened(spark, sf_dir):
    """What is tried for a candidate while two dots remain."""
    return table(spark, [("k.l.m.n",), ("k.l.m",), ("k.l",), ("k",)], "candidate string").select("candidate", F.array_join(paths.shortened("candidate", 2), ",").alias("tries"))


@query("path VARCHAR, bare VARCHAR, key VARCHAR", [
    ("src/app/a.py", "app/a.py", "src|app|a.py"), ("src/lib/x.py", "x.py", "src|lib|x.py"), ("srcs/a.py", "srcs/a.py", "srcs|a.py"), ("a.py", "a.py", "a.py"),
])
def strip_root(spark, sf_dir):
    """Paths below the longest source root that begins them."""
    rows = table(spark, [("src/app/a.py",), ("src/lib/x.py",), ("srcs/a.py",), ("a.py",)], "path string")
    return rows.select("path", paths.strip_root("path", ["src", ".", "src/lib/", ""]).alias("bare"), F.array_join(paths.path_key("path"), "|").alias("key"))


@query("path VARCHAR, place INTEGER", [("a/b.py", 1), ("a-b/c.py", 2), ("a.py", 3)])
def path_order(spark, sf_dir):
    """Paths compare by component: a/b.py comes before a-b/c.py."""
    from pyspark.sql import Window

    rows = table(spark, [("a-b/c.py",), ("a.py",), ("a/b.py",)], "path string")
    return rows.select("path", F.row_number().over(Window.orderBy(paths.path_key("path"))).alias("place"))


@query("raw VARCHAR, path VARCHAR, slug VARCHAR, escaped VARCHAR", [
    (" ./src/a.py ", "src/a.py", "src_a_py", " ./src/a.py "), ("././x/", "./x", "x", "././x/"), ("a\\b\\", "a/b/", "a_b", "a\\b\\"), ("<&\">'", "<&\">'", "", "&lt;&amp;&quot;&gt;'"),
])
def user_paths(spark, sf_dir):
    """Paths as users type them, their slugs, and text for a page."""
    raws = (" ./src/a.py ", "././x/", "a\\b\\", "<&\">'")
    return table(spark, [(r, paths.normalize_path(r), paths.slug(paths.normalize_path(r)), paths.html_escape(r)) for r in raws], "raw string, path string, slug string, escaped string")


# == extraction

SAMPLE = '''"""Doc of pkg.sub.mod."""
import os, pkg.a as alias
from . import sibling
from ..up import (one,
    two as second)
from star import *
import importlib
plugin = importlib.import_module("plug.in")
other = __import__("solo")
names = ["pkg.sub.Thing", b"no.bytes.here", f"{x}.a.b.{importlib.import_module('in.f')}"]
def f(a=importlib.import_module("de.fault"), *, k=1) -> "ann.o.t":
    import local_one
    importlib.import_module("lo.cal")
class K:
    from deep import thing
if True:
    import guarded
try:
    import tried
except ImportError:
    tried = None
'''


def _sources(spark: SparkSession, files: dict[str, str | None]) -> DataFrame:
    rows = [(0, "src", i, f"src/{name}", name, text, None if text is not None else "unreadable") for i, (name, text) in enumerate(files.items())]
    return table(spark, rows, "root_ord int, root string, file_ord long, rel_path string, walked string, source string, error string")


def _found(spark: SparkSession, options: ExtractOptions, files: dict[str, str | None] | None = None) -> DataFrame:
    facts = E.extract_facts(_sources(spark, files or {"pkg/m.py": SAMPLE}), options)
    names = F.array_join(F.transform("names", lambda n: F.concat(n["name"], F.when(n["asname"].isNull(), "").otherwise(F.concat(F.lit(" as "), n["asname"])))), ", ")
    return E.raw_imports(facts).select("kind", F.coalesce("module", F.lit("")).alias("module"), names.alias("names"), "level", "line")


SHAPE = "kind VARCHAR, module VARCHAR, names VARCHAR, level INTEGER, line INTEGER"
TOP = [("import", "", "os, pkg.a as alias", 0, 2), ("from", "", "sibling", 1, 3), ("from", "up", "one, two as second", 2, 4), ("from", "star", "*", 0, 6), ("import", "", "importlib", 0, 7)]
LOCAL = [("import", "", "local_one", 0, 12), ("from", "deep", "thing", 0, 15), ("import", "", "guarded", 0, 17), ("import", "", "tried", 0, 19)]
CALLS = [("string", "", "plug.in", 0, 8), ("string", "", "solo", 0, 9), ("string", "", "in.f", 0, 10), ("string", "", "de.fault", 0, 11)]


@query(SHAPE, TOP)
def extract_imports(spark, sf_dir):
    """Imports at the top of a module: what is in functions, classes and blocks is not there."""
    return _found(spark, ExtractOptions())


@query(SHAPE, TOP + LOCAL)
def extract_local(spark, sf_dir):
    """Imports at any depth."""
    return _found(spark, ExtractOptions(include_local=True))


@query(SHAPE, TOP + CALLS)
def extract_strings(spark, sf_dir):
    """First arguments of dynamic imports; defaults of a function count as the module's level, its body doesn't."""
    return _found(spark, ExtractOptions(string_imports=True))


@query(SHAPE, TOP + CALLS + LOCAL + [("string", "", "lo.cal", 0, 13)])
def extract_strings_local(spark, sf_dir):
    """The same at any depth."""
    return _found(spark, ExtractOptions(include_local=True, string_imports=True))


@query(SHAPE, TOP + [("string", "", "pkg.sub.Thing", 0, 10), ("string", "", "ann.o.t", 0, 11)])
def extract_strings_all(spark, sf_dir):
    """Every literal with two dots: not bytes, not pieces of f-strings; the annotation of a result is an expression."""
    return _found(spark, ExtractOptions(string_imports=True, mode=ALL))


@query("rel_path VARCHAR, module VARCHAR, stage VARCHAR", [("src/bad.py", "bad", "parse"), ("src/gone.py", "gone", "read")])
def extract_errors(spark, sf_dir):
    """Files that can't be parsed or read give an error row; an empty file and one of two line ends don't."""
    facts = E.extract_facts(_sources(spark, {"ok.py": "import a\r\nimport b\n", "bad.py": "def (", "gone.py": None, "empty.py": ""}))
    return E.extract_errors(facts).select("rel_path", "module", "stage")


@query("path VARCHAR, line INTEGER", [("src/dos.py", 1), ("src/dos.py", 2), ("src/mac.py", 1), ("src/mac.py", 1), ("src/mac.py", 2)])
def import_lines_of(spark, sf_dir):
    """Only line feeds end lines: a lone carriage return doesn't."""
    facts = E.extract_facts(_sources(spark, {"dos.py": "import a\r\nimport b\n", "mac.py": "import a\rimport b\nimport c\n"}))
    return E.raw_imports(facts).select(F.col("rel_path").alias("path"), "line")


# == a project

PROJECT = {
    "alpha/__init__.py": "from beta import helpers\n",
    "alpha/core.py": "from . import late\nfrom .late import X\n",
    "alpha/late.py": "import alpha.core\nimport nowhere.mod\nfrom ... import up\n",
    "beta/__init__.py": "",
    "beta/helpers.py": "from alpha import core, SYMBOL\nfrom alpha import NAME\nfrom void import a, b\nfrom alpha import *\n",
    "__init__.py": "import beta\n",
    ".hidden.py": "import beta.helpers\n",
    "self_pkg/__init__.py": "from . import SYMBOL\nimport importlib\nimportlib.import_module('self_pkg')\n",
}
WALKED = [(".hidden.py", ".hidden"), ("__init__.py", ""), ("alpha/__init__.py", "alpha"), ("alpha/core.py", "alpha.core"), ("alpha/late.py", "alpha.late"),
          ("beta/__init__.py", "beta"), ("beta/helpers.py", "beta.helpers"), ("self_pkg/__init__.py", "self_pkg")]


@query("file_ord BIGINT, rel_path VARCHAR, module VARCHAR, is_package BOOLEAN", [(i, f"src/{w}", m, w.endswith("__init__.py")) for i, (w, m) in enumerate(WALKED)])
def discover_files(spark, sf_dir):
    """A tree on disk, walked by the data source: hidden files, __init__.py and empty files are there, others aren't."""
    project = scratch(spark, "discovered")
    for name, text in {**PROJECT, "notes.txt": "", "mod.pyi": "", "dir.py/inner.txt": ""}.items():
        save(spark, f"{project}/src/{name}", text.encode())
    return E.files_of(read_tree(spark, project, ["src"])).select("file_ord", "rel_path", "module", "is_package")


def _resolved(spark: SparkSession, ancestor_init: bool = True) -> dict[str, DataFrame]:
    sources = _sources(spark, {w: PROJECT[w] for w, _ in WALKED})
    facts = E.extract_facts(sources, ExtractOptions(string_imports=True, mode=CALL_SITES))
    return R.resolve(E.raw_imports(facts), R.module_index(E.files_of(sources)), ancestor_init=ancestor_init)


DIRECT = [("alpha", "beta.helpers", 1, False), ("alpha.core", "alpha.late", 1, False), ("alpha.core", "alpha.late", 2, False), ("alpha.late", "alpha.core", 1, False),
          ("beta.helpers", "alpha.core", 1, False), ("beta.helpers", "alpha", 2, False), ("beta.helpers", "alpha", 4, False), ("", "beta", 1, False),
          (".hidden", "beta.helpers", 1, False), ("self_pkg", "self_pkg", 1, False)]


@query("source VARCHAR, target VARCHAR, line INTEGER, derived BOOLEAN", DIRECT + [("alpha", "beta", 1, True), ("beta.helpers", "alpha", 1, True), (".hidden", "beta", 1, True)])
def project_deps(spark, sf_dir):
    """Edges of a project: submodules before bases, packages on the way, a package's import of itself kept, a string's not."""
    return _resolved(spark)["deps"]


@query("source VARCHAR, target VARCHAR, line INTEGER, derived BOOLEAN", DIRECT)
def project_deps_direct(spark, sf_dir):
    """The same without edges to ancestors."""
    return _resolved(spark, False)["deps"]


@query("source VARCHAR, import_path VARCHAR", [("alpha.late", "nowhere.mod"), ("alpha.late", "..."), ("beta.helpers", "void"), ("self_pkg", "importlib")])
def project_unresolved(spark, sf_dir):
    """Imports of no first-party module, one for a from statement; one that climbs too far keeps its dots."""
    return _resolved(spark)["unresolved"]


@query("source VARCHAR, ancestor_package VARCHAR, line INTEGER", [("alpha.core", "alpha", 1), ("alpha.core", "alpha", 2), ("alpha.late", "alpha", 1)])
def project_suppressed(spark, sf_dir):
    """Edges to own ancestors that were left out."""
    return _resolved(spark)["suppressed"]
