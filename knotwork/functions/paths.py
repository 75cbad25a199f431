"""Paths and dotted names as Column expressions, with their few driver-side counterparts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def path_key(path: str | Column) -> Column:
    """Components of a path: arrays compare as paths do, component by component."""
    return F.split(_c(path), "/")


def node_path(root: str | Column, rel: str | Column) -> Column:
    """A walked path below its root; a root of '' or '.' adds nothing."""
    root = F.regexp_replace(_c(root), "/+$", "")
    return F.when(root.isin("", "."), _c(rel)).otherwise(F.concat(root, F.lit("/"), _c(rel)))


def module_name(path: str | Column) -> Column:
    """Dotted module of a path below its root: the last extension goes, and so does a final __init__."""
    parts = F.split(F.regexp_replace(_c(path), r"\.py$", ""), "/")
    n = F.size(parts)
    return F.array_join(F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, n - 1)).otherwise(parts), ".")


def is_package(path: str | Column) -> Column:
    """Whether a path is a package's __init__.py."""
    return _c(path).rlike(r"(^|/)__init__\.py$")


def is_ancestor_or_self(candidate: str | Column, module: str | Column) -> Column:
    return (_c(candidate) == _c(module)) | F.startswith(_c(module), F.concat(_c(candidate), F.lit(".")))


def ancestors(module: str | Column) -> Column:
    """Proper dotted prefixes, the shortest first; none for one segment (a sequence from 1 to 0 would run backwards)."""
    parts = F.split(_c(module), r"\.")
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return F.when(n > 1, prefixes).otherwise(F.array().cast("array<string>"))


def shortened(candidate: str | Column, min_dots: int) -> Column:
    """The candidate and what is left as segments go from its right, while ``min_dots`` dots remain; the longest first."""
    parts = F.split(_c(candidate), r"\.")
    n = F.size(parts)
    lengths = F.sequence(n, F.lit(min_dots + 1))
    return F.when(n > min_dots, F.transform(lengths, lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(F.array().cast("array<string>"))


def relative_target(source: str | Column, level: str | Column, module: str | Column) -> Column:
    """Absolute module of a relative import; null where it climbs beyond the root."""
    source = _c(source)
    parts = F.when(source == "", F.array().cast("array<string>")).otherwise(F.split(source, r"\."))
    left = F.size(parts) - _c(level)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(left, F.lit(0))), ".")
    suffix = F.coalesce(_c(module), F.lit(""))
    joined = F.when(suffix == "", base).when(base == "", suffix).otherwise(F.concat(base, F.lit("."), suffix))
    return F.when(left >= 0, joined)


def effective_level(level: str | Column, package: str | Column) -> Column:
    """In a package's __init__ the first dot is the package itself."""
    return F.when(_c(package), F.greatest(_c(level) - 1, F.lit(0))).otherwise(_c(level))


def is_candidate(value: str | Column, min_dots: int) -> Column:
    """Whether a string has the shape of a module: enough dots, every segment like an identifier, keywords too."""
    shape = _c(value).rlike(r"^[\p{L}\p{Nl}_][\p{L}\p{N}_]*(\.[\p{L}\p{Nl}_][\p{L}\p{N}_]*)*$")
    return shape & (F.size(F.split(_c(value), r"\.")) > min_dots)


def usable_roots(roots: list[str]) -> list[str]:
    """Roots that are a prefix of anything, the longest first."""
    bare = [re.sub(r"[/\\]+$", "", r) for r in sorted(roots, key=len, reverse=True)]
    return [r for r in bare if r not in ("", ".")]


def strip_root(path: str | Column, roots: list[str]) -> Column:
    """The path without the longest source root that begins it."""
    path = _c(path)
    cases = [(F.startswith(path, F.lit(r + "/")), F.lit(len(r) + 2)) for r in usable_roots(roots)]
    if not cases:
        return path
    at = reduce(lambda whole, case: whole.when(*case), cases[1:], F.when(*cases[0])).otherwise(F.lit(1))
    return F.substring(path, at, F.length(path))


def package_of(path: str | Column, roots: list[str]) -> Column:
    """First component of a path below its root, if there are two or more."""
    parts = path_key(strip_root(path, roots))
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0)))


def packages_of(members: str | Column, roots: list[str]) -> Column:
    """Sorted distinct packages of a cycle's members."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(_c(members), lambda m: package_of(m, roots)), lambda p: p.isNotNull())))


def under(path: str | Column, directory: str | Column) -> Column:
    """Whether a path is a directory or lies below it."""
    return (_c(path) == _c(directory)) | F.startswith(_c(path), F.concat(_c(directory), F.lit("/")))


def chain(path: str | Column, entry: str | Column) -> Column:
    """'from:1,2 -> ... -> entry' of an array of hops (from, to, lines)."""
    hops = F.transform(_c(path), lambda h: F.concat(h["from"], F.lit(":"), F.array_join(h["lines"].cast("array<string>"), ",")))
    return F.concat_ws(" -> ", hops, _c(entry))


# == on the driver


def normalize_path(raw: str) -> str:
    """What a user types: trimmed, one leading ./ and trailing slashes gone, backslashes turned."""
    text = raw.strip()
    return text.removeprefix("./").rstrip("/").replace("\\", "/")


def normalize_dirs(dirs: list[str]) -> list[str]:
    """Usable directories of a list: those that are neither empty nor the project itself."""
    bare = [d.replace("\\", "/").removeprefix("./").rstrip("/") for d in dirs]
    return [d for d in bare if d not in ("", ".")]


def slug(path: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in path).strip("_")


def trace_page(stem: str, i: int, path: str) -> str:
    """File name of a trace's page."""
    return f"{stem}_trace_{slug(path) or i}.html"


def html_escape(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(raw, safe)
    return text


def sort_paths(paths) -> list[str]:
    return sorted(paths, key=lambda p: p.split("/"))
