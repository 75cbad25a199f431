"""Files and the imports in them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions import paths
from knotwork.functions.imports import ExtractOptions, extract

FACTS = (
    "root_ord int, file_ord long, rel_path string, source_module string, is_package boolean, stmt_ord int, kind string, module string, "
    "names array<struct<name:string,asname:string>>, level int, line int, message string"
)


def with_modules(sources: DataFrame) -> DataFrame:
    """Adds module and is_package to rows of root_ord, root, file_ord, rel_path, walked."""
    return sources.withColumn("module", paths.module_name("walked")).withColumn("is_package", paths.is_package("walked"))


def files_of(sources: DataFrame) -> DataFrame:
    """(root_ord, root, file_ord, rel_path, path_key, module, is_package)."""
    return with_modules(sources).select("root_ord", "root", "file_ord", "rel_path", paths.path_key("rel_path").alias("path_key"), "module", "is_package")


def _extractor(options: ExtractOptions):
    named = pa.list_(pa.struct([("name", pa.string()), ("asname", pa.string())]))
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), named, pa.int32(), pa.int32(), pa.string()]
    labels = ["root_ord", "file_ord", "rel_path", "source_module", "is_package", "stmt_ord", "kind", "module", "names", "level", "line", "message"]

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = []
            for r in batch.to_pylist():
                who = (r["root_ord"], r["file_ord"], r["rel_path"], r["module"], r["is_package"])
                if r["source"] is None:
                    rows.append((*who, 0, "read_error", None, None, None, None, r["error"] or "no text"))
                    continue
                try:
                    found = extract(r["source"], options)
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    rows.append((*who, 0, "parse_error", None, None, None, None, str(e)))
                    continue
                for i, (kind, module, names, level, line) in enumerate(found):
                    rows.append((*who, i, kind, module, [{"name": n, "asname": a} for n, a in names], level, line, None))
            columns = zip(*rows) if rows else [()] * len(labels)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=labels)

    return run


def extract_facts(sources: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """Imports of every file as rows, and a read_error or parse_error row for a file that gives none."""
    rows = with_modules(sources).select("root_ord", "file_ord", "rel_path", "module", "is_package", "source", "error")
    return rows.mapInArrow(_extractor(options), FACTS)


def raw_imports(facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("kind").isin("read_error", "parse_error")).drop("message")


def extract_errors(facts: DataFrame) -> DataFrame:
    """(root_ord, file_ord, rel_path, module, stage, message); order by the first two for discovery order."""
    stage = F.regexp_replace("kind", "_error$", "").alias("stage")
    return facts.where(F.col("kind").isin("read_error", "parse_error")).select("root_ord", "file_ord", "rel_path", F.col("source_module").alias("module"), stage, "message")
