import tomllib

import pytest

from knotwork import config as S
from knotwork.plans import config_edit as E


def test_defaults():
    c = S.load('source-roots = ["src"]\nunknown = 1\n[cycles]\nother = 2\n')
    assert c == S.Config() and c.cycles.min_scc_size == 2 and c.resolve.include_ancestor_init and c.parse.string_imports_min_dots == 2


def test_all_values():
    c = S.load("""
source-roots = ["src", "lib"]
exclude = ["src/gen/"]
[parse]
local-imports = true
string-imports = true
string-imports-mode = "all"
string-imports-min-dots = 0
[resolve]
include-ancestor-init = false
include-self-ancestor-init = true
[cycles]
min-scc-size = 1
max-scc-size = 9
max-cycles = 3
cyclic-files = ["src/a.py"]
ignore-dirs = ["src/x"]
ignore-derived-ancestor-init = true
[[cycles.ignore]]
files = ["a.py"]
reason = "why"
""")
    assert c.parse == S.Parse(True, True, 0, "all") and c.resolve == S.Resolve(False, True)
    assert c.cycles == S.Cycles(1, 9, 3, (S.Ignored(("a.py",), "why"),), ("src/a.py",), True, ("src/x",))


@pytest.mark.parametrize(
    "text",
    ["", "source-roots = 1", 'source-roots = ["a", "a/"]', 'source-roots = ["a/b", "a"]', 'source-roots = [".", ""]', "x = ",
     *(f'source-roots = ["a"]\n[cycles]\n{x}' for x in ("min-scc-size = 0", "max-scc-size = 0", "max-scc-size = 1", 'cyclic-files = [" "]', 'cyclic-files = ["/a"]',
       'ignore-dirs = ["C:/x"]', "[[cycles.ignore]]\nfiles = []", "min-scc-size = true")),
     'source-roots = ["a"]\nexclude = ["\\\\a"]', 'source-roots = ["a"]\n[parse]\nstring-imports-mode = "some"'],
)
def test_rejected(text):
    with pytest.raises(S.ConfigError):
        S.load(text)


def test_project_root_conflicts_with_no_named_root():
    assert S.load('source-roots = [".", "lib"]').source_roots == (".", "lib")


def test_find(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert S.find(str(tmp_path / "a" / "b")) is None
    (tmp_path / S.FILE).write_text("")
    assert S.find(str(tmp_path / "a" / "b")) == str(tmp_path / S.FILE)


TEXTS = [
    "",
    'source-roots = ["src"]\n',
    '# head\nsource-roots = ["src"] # x\n\n[cycles] # c\nmin-scc-size = 2\ncyclic-files = [\n  "old.py", # gone\n  "x[.py",\n]\n\n[parse]\nlocal-imports = true\n',
    'a = 1\n[[cycles.ignore]]\nfiles = ["a.py", "b.py"]\nreason = "kept"\n\n[resolve]\ninclude-ancestor-init = true\n',
    "[cycles]\nignore = []\nmax-cycles = 1",
]


@pytest.mark.parametrize("text", TEXTS)
def test_cyclic_files_are_set(text):
    before = tomllib.loads(text)
    after = E.set_cyclic_files(text, ["b\\c.py", "a.py"])
    want = {**before, "cycles": {**before.get("cycles", {}), "cyclic-files": ["a.py", "b/c.py"]}}
    assert tomllib.loads(after) == want and E.set_cyclic_files(after, ["a.py", "b/c.py"]) == after
    assert [x for x in text.split("\n") if "#" in x and "gone" not in x] == [x for x in after.split("\n") if "#" in x]
    assert tomllib.loads(E.set_cyclic_files(after, []))["cycles"]["cyclic-files"] == []


@pytest.mark.parametrize("text", TEXTS)
def test_ignores_are_merged(text):
    before = tomllib.loads(text).get("cycles", {}).get("ignore", [])
    after = E.merge_ignored_cycles(text, [["b.py", "a.py"], ["z.py", "y.py"], ["a.py", "b.py"]])
    found = tomllib.loads(after)["cycles"]["ignore"]
    assert found[: len(before)] == before and sorted(sorted(f["files"]) for f in found) == [["a.py", "b.py"], ["y.py", "z.py"]]
    rest = tomllib.loads(text)
    rest.get("cycles", {}).pop("ignore", None)
    got = tomllib.loads(after)
    got["cycles"].pop("ignore")
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in rest.items() if v}
    assert E.merge_ignored_cycles(after, [["y.py", "z.py"], ["b.py", "a.py"]]) == after


def test_patch_writes_only_changes(tmp_path):
    path = tmp_path / "knotwork.toml"
    path.write_text('source-roots = ["src"]\n')
    assert E.patch(str(path), lambda t: E.set_cyclic_files(t, ["a.py"]))
    assert not E.patch(str(path), lambda t: E.set_cyclic_files(t, ["a.py"]))
