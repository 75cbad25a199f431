import os

import pytest

from knotwork.operators import lineage as L
from knotwork.sources.python_tree import DiscoveryError, read_tree, walk


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(L, "_setting", lambda spark: str(tmp_path))
    return str(tmp_path)


def test_a_bare_path_and_a_uri_are_one_folder(spark, folder):
    assert L.qualified(spark, folder) == L.qualified(spark, f"file://{folder}/") == L.shared_dir(spark) == f"file:{folder}"
    table = L.cut(spark.range(3), "three")
    assert table.count() == 3 and table._knotwork_path.startswith(f"file:{folder}/knotwork/three-")


def test_tables_go(spark, folder):
    def build():
        first = L.cut(spark.range(10), "first")
        second = L.cut(first.where("id > 3"), "second")
        return second.join(first, "id")

    kept = L.cut(spark.range(1), "kept")
    made = L.written(spark, build, "made")
    assert made.count() == 6 and kept.count() == 1
    assert sorted(n.split("-")[0] for n in os.listdir(f"{folder}/knotwork") if not n.startswith(".")) == ["kept", "made"]
    L.release(made, kept, spark.range(1))
    assert not [n for n in os.listdir(f"{folder}/knotwork") if not n.startswith(".")]


def test_a_tree_by_uri(spark, tmp_path):
    (tmp_path / "src" / "pkg").mkdir(parents=True)
    for name in ("pkg/__init__.py", ".hidden.py", "pkg/b.py", "notes.txt"):
        (tmp_path / "src" / name).write_text("import os\n")
    want = [".hidden.py", "pkg/__init__.py", "pkg/b.py"]
    assert [p for p, _ in walk(str(tmp_path / "src"))] == [p for p, _ in walk(f"file://{tmp_path}/src")] == want
    rows = read_tree(spark, f"file://{tmp_path}", ["src"]).collect()
    assert sorted(r["walked"] for r in rows) == want and all(r["source"] == "import os\n" and r["error"] is None for r in rows)


def test_a_remote_tree(tmp_path, monkeypatch):
    from pyarrow import fs

    from knotwork.sources import python_tree as T

    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "__init__.py").write_bytes(b"x")
    monkeypatch.setattr(T, "opened", lambda path: (fs.LocalFileSystem(), path.removeprefix("mem://")))
    assert T.walk(f"mem://{tmp_path}") == [("pkg/__init__.py", 1)] and T.read_bytes(f"mem://{tmp_path}/pkg/__init__.py") == b"x"
    for bad in ("none", "pkg/__init__.py"):
        with pytest.raises(DiscoveryError):
            T.walk(f"mem://{tmp_path}/{bad}")
