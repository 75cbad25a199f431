import json

import pytest

from knotwork import cli
from tests import projects as P

JSON = ("--format", "json")


@pytest.fixture
def go(spark, tmp_path):
    def run(files, *args, config='source-roots = ["src"]\n'):
        P.write(tmp_path, files, config)
        console = cli.Console()
        code = cli.run(list(args), spark, str(tmp_path), console)
        return code, "\n".join(console.out), "\n".join(console.err)

    return run


def cycles(out):
    return [[f["path"] for f in c["files"]] for c in json.loads(out)["cycles"]]


def test_default_report(go):
    code, out, _ = go(P.A_B)
    assert code == 0
    assert "--- dependency cycles (1) ---" in out and "package: web (1 cycle)" in out
    assert "cycle 1 (2 files)" in out and "  src/web/a.py (import at line 1)" in out


def test_json_and_strict(go):
    code, out, _ = go(P.A_B, *JSON, "--strict", "--show-cyclic-files")
    report = json.loads(out)
    assert code == 1 and report["version"] == 2
    assert report["summary"] == {"cycles_reported": 1, "cycles_suppressed": 0}
    assert report["cycles"][0]["files"][0] == {"path": "src/web/a.py", "import_lines": [1], "edges": [{"to": "src/web/b.py", "lines": [1]}]}
    assert report["cyclic_files"] == ["src/web/a.py", "src/web/b.py"]
    assert "traced" not in report and "excluded" not in report


def test_relative_imports_without_package(go):
    code, out, _ = go(P.TINY, *JSON)
    report = json.loads(out)
    assert report["cycles"][0]["packages"] == [] and report["cycles"][0]["size"] == 3
    assert cycles(go(P.TINY, *JSON, "--package")[1]) == []


def test_package_filter_and_order(go):
    out = go(P.MULTI, *JSON)[1]
    assert cycles(out) == [["src/auth/a.py", "src/auth/b.py"], ["src/auth/c.py", "src/models/x.py"]]
    assert cycles(go(P.MULTI, *JSON, "--package")[1]) == [["src/auth/a.py", "src/auth/b.py"]]
    assert "(cross-package: auth, models) (1 cycle)" in go(P.MULTI)[1]


def test_trace(go):
    code, out, err = go(P.BRANCH, *JSON, "-t", "src/web/,src/web/entry.py,nope", "--strict")
    report = json.loads(out)
    assert code == 1 and report["unknown_paths"] == ["nope"] and "nope" in err
    folder, entry = report["traced"]
    assert folder["kind"] == "directory" and folder["path"] == "src/web/"
    hit = {f["path"]: f.get("impacts", []) for f in folder["files"]}
    assert len(hit) == 6 and sum(bool(v) for v in hit.values()) == 4
    assert hit["src/web/core_a.py"][0]["relationship"] == "member" and "path" not in hit["src/web/core_a.py"][0]
    way = entry["files"][0]["impacts"][0]
    assert [h["from"] for h in way["path"]] == ["src/web/entry.py", "src/web/mid.py"] and way["entry"] == "src/web/core_a.py"
    assert way["from_lines"] == [1] and way["path"][1]["lines"] == [2]
    text = go(P.BRANCH, "-t", "src/web/entry.py", "-t", "src/web/isolated.py")[1]
    assert "cycle 1 (reachable via src/web/entry.py:1 -> src/web/mid.py:2 -> src/web/core_a.py)" in text
    assert "not impacted by any cycle" in text


def test_trace_hint(go):
    code, out, err = go(P.A_B, *JSON, "-t", "web/a.py")
    assert "did you mean 'src/web/a.py'" in err and json.loads(out)["unknown_paths"] == ["web/a.py"]


def test_self_ancestor_init(go):
    assert cycles(go(P.SELF_INIT, *JSON)[1]) == []
    out = go(P.SELF_INIT, *JSON, "--include-self-ancestor-init")[1]
    assert cycles(out) == [["src/kit/__init__.py", "src/kit/child.py"]]
    assert json.loads(out)["cycles"][0]["files"][1]["edges"] == [{"to": "src/kit/__init__.py", "lines": [2]}]
    code, out, err = go(P.SELF_INIT, *JSON, "--include-self-ancestor-init", "--no-include-ancestor-init")
    assert cycles(out) == [] and "no effect" in err


def test_derived_baseline(go):
    files = {"src/north/__init__.py": "from south import helpers\n", "src/north/core.py": "", "src/south/__init__.py": "", "src/south/helpers.py": "from north import core\n"}
    wanted = ["src/north/__init__.py", "src/south/helpers.py"]
    for flags in ([], ["--ignore-derived-ancestor-init"]):
        assert json.loads(go(files, *JSON, "--dump-cyclic-files", *flags)[1])["cyclic_files"] == wanted
    assert cycles(go(files, *JSON, "--no-include-ancestor-init")[1]) == []


def test_ignore_dirs(go):
    config = 'source-roots = ["src"]\n[cycles]\nignore-dirs = ["./src/web/protos/"]\n'
    out = go(P.IGNORE_DIRS, *JSON, config=config)[1]
    assert cycles(out) == [["src/web/foo.py", "src/web/protos/z.py"]]
    assert json.loads(out)["summary"]["cycles_suppressed"] == 1


def test_ignore_list(go):
    config = 'source-roots = ["src"]\n[[cycles.ignore]]\nfiles = ["src/web/b.py", "src/web/a.py"]\nreason = "old"\n'
    code, out, err = go(P.A_B, *JSON, "--strict", config=config)
    assert code == 0 and json.loads(out)["summary"] == {"cycles_reported": 0, "cycles_suppressed": 1}
    code, out, err = go(P.A_B, config=config.replace("src/web", "web"))
    assert "did not match any detected cycle" in err and 'files = ["src/web/b.py", "src/web/a.py"]' in err


def test_exclude(go):
    files = P.A_B | {"src/extra/x.py": "from extra import y\n", "src/extra/y.py": "from extra import x\n"}
    out = go(files, *JSON, "--exclude", "src/extra/,src/web/a.py,none")
    assert cycles(out[1]) == [["src/web/a.py", "src/web/b.py"]] and json.loads(out[1])["excluded"] == ["src/extra/", "src/web/a.py"]
    assert "nothing to exclude at 'none'" in out[2]


def test_gates(go):
    assert go(P.A_B, "--check-max-cycles", "--max-cycles", "1")[0] == 0
    assert go(P.A_B, "--check-max-cycles", "--max-cycles", "0")[0] == 1
    assert go(P.A_B, "--check-max-cycles")[0] == 2
    assert go(P.A_B, "--check-max-cycles", "--check-cyclic-files")[0] == 2
    assert go(P.A_B, "--write")[0] == 2
    known = 'source-roots = ["src"]\n[cycles]\ncyclic-files = ["src/web/a.py", "src/web/ghost.py"]\n'
    code, _, err = go(P.A_B, "--check-cyclic-files", config=known)
    assert code == 1 and "  + src/web/b.py" in err and "  - src/web/ghost.py" in err


def test_write_is_idempotent(go, tmp_path):
    config = '# kept\nsource-roots = ["src"] # too\n\n[cycles]\nmin-scc-size = 2\n'
    code, out, err = go(P.A_B, "--dump-cyclic-files", "--write", *JSON, config=config)
    text = (tmp_path / "knotwork.toml").read_text()
    assert code == 0 and json.loads(out)["written"] and text.startswith("# kept\n") and '    "src/web/a.py",\n    "src/web/b.py",\n]' in text
    code, out, _ = go(P.A_B, "--dump-cyclic-files", "--write", *JSON, config=None)
    assert not json.loads(out)["written"] and (tmp_path / "knotwork.toml").read_text() == text
    code, out, _ = go(P.A_B, "--dump-ignores", "--write", *JSON, config=None)
    assert json.loads(out)["added_entries"] == 1 and 'files = ["src/web/a.py", "src/web/b.py"]' in (tmp_path / "knotwork.toml").read_text()
    assert go(P.A_B, "--strict", config=None)[0] == 0


def test_bad_files_and_roots(go, tmp_path):
    code, out, err = go(P.A_B | {"src/bad.py": "def (", "src/odd.py": "x = 1"}, "-v")
    assert code == 0 and "parse error in bad" in err and "src/web/a.py\n  -> src/web/b.py" in out and "total: 4 Python files" in out
    code, _, err = go(P.A_B, config='source-roots = ["gone"]\n')
    assert code == 1 and err.startswith("discovery error")


def test_multiroot_collision_and_strings(go):
    files = {"src/kit/a.py": "from kit import b\n", "src/kit/b.py": "import importlib\nimportlib.import_module('kit.a')\n", "lib/kit/c.py": "import kit.a\n",
             "src/utils/helper.py": "", "lib/utils/helper.py": ""}
    config = 'source-roots = ["src", "lib"]\n[parse]\nstring-imports = true\n'
    code, out, err = go(files, *JSON, "-t", "lib/kit/c.py", config=config)
    assert cycles(out) == [["src/kit/a.py", "src/kit/b.py"]]
    assert "module 'utils.helper' is defined by multiple files: lib/utils/helper.py, src/utils/helper.py" in err
    assert json.loads(out)["traced"][0]["files"][0]["impacts"][0]["entry"] == "src/kit/a.py"


def test_dot_root_finds_files_twice(go):
    files = {"app.py": "import models.user\n", "models/user.py": "import utils\n", "lib/utils.py": "import app\n"}
    out = go(files, *JSON, config='source-roots = [".", "lib"]\n')[1]
    assert cycles(out) == [["app.py", "lib/utils.py", "models/user.py"]]


def test_html(go, tmp_path):
    out = go(P.BRANCH, *JSON, "-t", "src/web/")[1]
    (tmp_path / "r.json").write_text(out)
    code, _, err = go(P.BRANCH, "report", str(tmp_path / "r.json"), "-o", str(tmp_path / "page.html"), "--root", str(tmp_path))
    page = (tmp_path / "page.html").read_text()
    assert code == 0 and "<code>from web import core_b</code>" in page and 'href="page_trace_src_web.html"' in page
    assert "reachable via" in (tmp_path / "page_trace_src_web.html").read_text()
    (tmp_path / "r.json").write_text(out.replace('"cycles_reported": 1', '"cycles_reported": 2'))
    assert go(P.BRANCH, "report", str(tmp_path / "r.json"))[0] == 1


def test_a_loop_closed_by_a_package_on_the_way(go):
    five = ["src/shop/__init__.py", "src/shop/maker.py", "src/shop/stock/__init__.py", "src/shop/stock/source.py", "src/yard/deal.py"]
    config = 'source-roots = ["src"]\n[cycles]\nignore-derived-ancestor-init = true\n'
    dump = json.loads(go(P.MIXED, *JSON, "--dump-cyclic-files", config=config)[1])
    assert dump["ignore_derived_ancestor_init"] and dump["cyclic_files"] == five  # no direct loop is left, so all of it stays
    assert cycles(go(P.MIXED, *JSON, config=config)[1]) == [five]


def test_local_imports(go):
    files = {"src/kit/a.py": "from . import b\n", "src/kit/b.py": "def late():\n    from . import a\n    return a\n"}
    assert cycles(go(files, *JSON)[1]) == []
    assert cycles(go(files, *JSON, "--local-imports")[1]) == [["src/kit/a.py", "src/kit/b.py"]]


def test_string_imports(go):
    one, two = (["src/our/kit/a.py", "src/our/kit/b.py"], ["src/our/kit/c.py", "src/our/kit/d.py"])
    least = 'source-roots = ["src"]\n[cycles]\nmin-scc-size = 1\n'
    every = 'source-roots = ["src"]\n[parse]\nstring-imports-mode = "all"\n'
    found = lambda config, *flags: cycles(go(P.STRINGS, *JSON, *flags, config=config)[1])
    assert found(least) == found(least, "--local-imports") == []
    assert found(least, "--include-string-imports") == [one]  # c names itself, which is no cycle
    assert found(least, "--include-string-imports", "--local-imports") == [one, two]
    assert found(every, "--include-string-imports") == [one]
    assert found(every + "string-imports-min-dots = 3\n", "--include-string-imports") == []
    for config, there in ((least, False), (every, True)):
        assert ("    string  (our.kit.b)" in go(P.STRINGS, "-v", "--include-string-imports", config=config)[1].replace("string (", "string  (")) == there


def test_strings_of_no_module_are_dropped(go):
    files = {"src/kit/x.py": 'import importlib\nX = importlib.import_module("no.such.module")\n'}
    code, out, _ = go(files, "-v", "--include-string-imports", "--strict")
    assert code == 0 and "no.such.module" not in out.split("--- unresolved imports")[1].split("---")[1]


def test_relative_import_in_a_package_file(go):
    files = {"src/svc/__init__.py": "from .staff import load\n", "src/svc/staff.py": "from user import go\n", "src/user.py": "from svc import load\n"}
    assert cycles(go(files, *JSON)[1]) == [["src/svc/__init__.py", "src/svc/staff.py", "src/user.py"]]


def test_an_excluded_file_keeps_its_own_loop(go):
    files = {"src/kit/a.py": "from . import s\n", "src/kit/s.py": "from . import s\n"}
    config = 'source-roots = ["src"]\n[cycles]\nmin-scc-size = 1\n'
    assert cycles(go(files, *JSON, "--exclude", "src/kit/s.py", config=config)[1]) == [["src/kit/s.py"]]


def test_json_is_the_same_every_time(go):
    first, again = (go(P.MULTI | P.STRINGS, *JSON, "-t", "src/auth/", "--include-string-imports")[1] for _ in range(2))
    assert first == again and len(cycles(first)) == 3


def test_sources_from_a_table(go, spark, tmp_path):
    from knotwork.sources.python_tree import SOURCES

    rows = [(0, "src", i, path, path[4:], text, None) for i, (path, text) in enumerate(sorted(P.MULTI.items()))]
    spark.createDataFrame(rows, SOURCES).write.parquet(str(tmp_path / "table"))
    assert cycles(go({}, *JSON, "--sources", str(tmp_path / "table"))[1]) == cycles(go(P.MULTI, *JSON)[1])
