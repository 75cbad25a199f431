"""Cutting lineage through tables in the shared folder, so that a lost executor never loses an iteration."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_here = threading.local()


def _file_system(spark: SparkSession, path: str) -> tuple:
    """(Hadoop's file system of a path, the path in its terms)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def qualified(spark: SparkSession, path: str) -> str:
    system, target = _file_system(spark, path)
    return system.makeQualified(target).toString().rstrip("/")


def _setting(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` with the scheme of its file system, so that a bare path means the same to
    Hadoop and to Python; where that is unset, a folder of our own, in local mode only."""
    setting = _setting(spark)
    if not setting:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        setting = tempfile.mkdtemp(prefix="knotwork-")
        atexit.register(shutil.rmtree, setting, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(setting)
    return qualified(spark, setting)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there when the driver ends is deleted then, unless ``written`` did before."""
    path = f"{shared_dir(spark)}/knotwork/{name}-{uuid.uuid4().hex}"
    system, target = _file_system(spark, path)
    if not hasattr(_here, "paths"):
        _here.paths = []
    _here.paths.append(path)
    system.mkdirs(target.getParent())
    system.create(target, True).close()  # only what is there can be marked
    system.deleteOnExit(target)
    system.delete(target, True)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the plan behind it ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._knotwork_path = path
    return back


def release(*frames: DataFrame | None) -> None:
    """Delete the tables of frames that ``cut`` made and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_knotwork_path", None)
        if path:
            delete(df.sparkSession, path)


def save(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file of the shared folder, whatever file system that is on."""
    system, target = _file_system(spark, path)
    out = system.create(target, True)
    try:
        for i in range(0, len(data), 8 << 20):
            out.write(bytearray(data[i : i + (8 << 20)]))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)
    if path in getattr(_here, "paths", ()):
        _here.paths.remove(path)


def written(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """``cut`` what ``build`` returns, and delete the tables that it made on the way."""
    before = set(getattr(_here, "paths", ()))
    back = cut(build(), name)
    for path in [p for p in _here.paths if p not in before and p != back._knotwork_path]:
        delete(spark, path)
    return back
