"""A batch source of Python files: every .py below the roots, __init__.py, hidden and empty files too.

Spark's text and binary sources skip names that begin with _ or a dot and files of no bytes, so the tree is walked here.
Planning lists the files and splits them by size; tasks read their own, so contents never pass the driver. A project is
a local path, which all workers must have, or a URI of any file system that Arrow opens.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SOURCES = "root_ord int, root string, file_ord long, rel_path string, walked string, source string, error string"
BYTES_PER_TASK = 8 << 20


class DiscoveryError(Exception):
    """A source root that can't be walked."""


def opened(path: str) -> tuple[fs.FileSystem | None, str]:
    """(file system of a URI, the path in it); a local path has none."""
    local = re.fullmatch(r"file:/*(/.*)", path)
    if local:
        return None, local[1]
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", path) else (None, path)


def walk(root: str) -> list[tuple[str, int]]:
    """(path, bytes) of .py files below ``root``, by component; links are not followed and nothing is ignored."""
    system, base = opened(root)
    found = _walk_local(base) if system is None else _walk_remote(system, base)
    return sorted(found, key=lambda x: x[0].split("/"))


def _walk_remote(system: fs.FileSystem, root: str) -> list[tuple[str, int]]:
    kind = system.get_file_info(root).type
    if kind != fs.FileType.Directory:
        raise DiscoveryError(f"source root {'does not exist' if kind == fs.FileType.NotFound else 'is no directory'}: {root}")
    every = system.get_file_info(fs.FileSelector(root, recursive=True))
    return [(x.path[len(root.rstrip("/")) + 1 :], x.size) for x in every if x.type == fs.FileType.File and os.path.splitext(x.base_name)[1] == ".py"]


def _walk_local(root: str) -> list[tuple[str, int]]:
    if not os.path.exists(root):
        raise DiscoveryError(f"source root does not exist: {root}")
    if not os.path.isdir(root):
        raise DiscoveryError(f"source root is no directory: {root}")

    def stop(error: OSError) -> None:
        raise DiscoveryError(f"cannot walk {error.filename}: {error.strerror}")

    found = []
    for folder, _, names in os.walk(root, onerror=stop, followlinks=False):
        for name in names:
            full = os.path.join(folder, name)
            if os.path.splitext(name)[1] == ".py" and os.path.isfile(full) and not os.path.islink(full):
                found.append((os.path.relpath(full, root).replace(os.sep, "/"), os.path.getsize(full)))
    return found


def read_bytes(path: str) -> bytes:
    system, inner = opened(path)
    with open(inner, "rb") if system is None else system.open_input_stream(inner) as f:
        return f.read()


def below(root: str, walked: str) -> str:
    root = root.rstrip("/")
    return walked if root in ("", ".") else f"{root}/{walked}"


@dataclass
class Files(InputPartition):
    rows: list[tuple]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.project = options["project"]
        self.roots = json.loads(options["roots"])

    def partitions(self) -> list[Files]:
        parts, size = [Files([])], 0
        for i, root in enumerate(self.roots):
            base = os.path.join(self.project, root)
            for j, (walked, n) in enumerate(walk(base)):
                if size > BYTES_PER_TASK:
                    parts.append(Files([]))
                    size = 0
                full = os.path.join(base, walked)
                parts[-1].rows.append((i, root, j, below(root, walked), walked, full))
                size += 512 + n
        return parts

    def read(self, partition: Files):
        for *row, full in partition.rows:
            try:
                yield (*row, read_bytes(full).decode("utf-8"), None)
            except (OSError, UnicodeDecodeError) as e:
                yield (*row, None, str(e))


class PythonTree(DataSource):
    """Options: project (a folder), roots (a JSON list of folders below it)."""

    @classmethod
    def name(cls) -> str:
        return "python_tree"

    def schema(self) -> str:
        return SOURCES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, project: str, roots: list[str]) -> DataFrame:
    """Files of a project below its source roots, with their text or the reason there is none. Bad roots fail at once."""
    for root in roots:
        base = os.path.join(project, root)
        system, inner = opened(base)
        if system is not None or not os.path.isdir(inner):
            walk(base)
    spark.dataSource.register(PythonTree)
    return spark.read.format("python_tree").option("project", project).option("roots", json.dumps(list(roots))).load()
