"""Project settings: knotwork.toml, its defaults and what it must hold."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, replace

from knotwork.functions.imports import ALL, CALL_SITES, ExtractOptions

FILE = "knotwork.toml"


class ConfigError(ValueError):
    """Settings that can't be used."""


@dataclass(frozen=True)
class Parse:
    local_imports: bool = False
    string_imports: bool = False
    string_imports_min_dots: int = 2
    string_imports_mode: str = CALL_SITES

    def options(self) -> ExtractOptions:
        return ExtractOptions(self.local_imports, self.string_imports, self.string_imports_mode, self.string_imports_min_dots)


@dataclass(frozen=True)
class Resolve:
    include_ancestor_init: bool = True
    include_self_ancestor_init: bool = False


@dataclass(frozen=True)
class Ignored:
    files: tuple[str, ...]
    reason: str | None = None


@dataclass(frozen=True)
class Cycles:
    min_scc_size: int = 2
    max_scc_size: int | None = None
    max_cycles: int | None = None
    ignore: tuple[Ignored, ...] = ()
    cyclic_files: tuple[str, ...] = ()
    ignore_derived_ancestor_init: bool = False
    ignore_dirs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    source_roots: tuple[str, ...] = ("src",)
    exclude: tuple[str, ...] = ()
    parse: Parse = field(default_factory=Parse)
    resolve: Resolve = field(default_factory=Resolve)
    cycles: Cycles = field(default_factory=Cycles)

    def override(self, section: str, **values) -> Config:
        """A copy with some values of a section replaced, as the command line does."""
        return replace(self, **{section: replace(getattr(self, section), **values)})


KINDS = {
    "local_imports": bool, "string_imports": bool, "string_imports_min_dots": int, "string_imports_mode": str,
    "include_ancestor_init": bool, "include_self_ancestor_init": bool,
    "min_scc_size": int, "max_scc_size": int, "max_cycles": int, "ignore_derived_ancestor_init": bool,
}


def _strings(value, name: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise ConfigError(f"{name} must be a list of strings")
    return tuple(value)


def _section(kind, table, name: str, **special):
    if not isinstance(table, dict):
        raise ConfigError(f"[{name}] must be a table")
    values = {}
    for key, value in table.items():
        attribute = key.replace("-", "_")
        if key in special:
            values[attribute] = special[key](value)
        elif attribute in KINDS and attribute in kind.__dataclass_fields__ and "_" not in key:
            wanted = KINDS[attribute]
            if not isinstance(value, wanted) or wanted is int and (isinstance(value, bool) or value < 0):
                raise ConfigError(f"{key} must be {'a count' if wanted is int else 'a ' + wanted.__name__}")
            values[attribute] = value
    return kind(**values)  # other keys are ignored


def _ignored(value) -> tuple[Ignored, ...]:
    if not isinstance(value, list):
        raise ConfigError("[[cycles.ignore]] must be a list of tables")
    found = []
    for entry in value:
        if not isinstance(entry, dict) or "files" not in entry:
            raise ConfigError("a [[cycles.ignore]] entry needs files")
        found.append(Ignored(_strings(entry["files"], "files"), entry.get("reason")))
    return tuple(found)


def load(text: str) -> Config:
    """Parse and validate settings. Unknown keys are ignored; source-roots must be given."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    if "source-roots" not in doc:
        raise ConfigError("source-roots is missing")
    strings = lambda name: lambda value: _strings(value, name)
    config = Config(
        source_roots=_strings(doc["source-roots"], "source-roots"),
        exclude=_strings(doc.get("exclude", []), "exclude"),
        parse=_section(Parse, doc.get("parse", {}), "parse"),
        resolve=_section(Resolve, doc.get("resolve", {}), "resolve"),
        cycles=_section(
            Cycles, doc.get("cycles", {}), "cycles",
            **{"ignore": _ignored, "cyclic-files": strings("cyclic-files"), "ignore-dirs": strings("ignore-dirs")},
        ),
    )
    validate(config)
    return config


def _relative(values: tuple[str, ...], name: str) -> None:
    for value in values:
        text = value.strip().replace("\\", "/")
        if not text:
            raise ConfigError(f"an entry of {name} is empty")
        if text.startswith("/") or ":" in text.split("/")[0]:
            raise ConfigError(f"an entry of {name} is no relative path: {value}")


def validate(config: Config) -> None:
    check_roots(config.source_roots)
    c = config.cycles
    if config.parse.string_imports_mode not in (ALL, CALL_SITES):
        raise ConfigError(f"string-imports-mode is neither {CALL_SITES} nor {ALL}")
    if c.min_scc_size < 1:
        raise ConfigError("min-scc-size is below 1")
    if c.max_scc_size is not None and c.max_scc_size < 1:
        raise ConfigError("max-scc-size is below 1")
    if c.max_scc_size is not None and c.max_scc_size < c.min_scc_size:
        raise ConfigError("max-scc-size is below min-scc-size")
    if any(not entry.files for entry in c.ignore):
        raise ConfigError("a [[cycles.ignore]] entry lists no file")
    _relative(c.cyclic_files, "cyclic-files")
    _relative(config.exclude, "exclude")
    _relative(c.ignore_dirs, "ignore-dirs")


def check_roots(roots: tuple[str, ...]) -> None:
    """Roots must neither repeat nor lie in each other; the project itself conflicts with no named root."""
    bare = sorted(("" if r == "." else r, raw) for raw in roots for r in [raw.strip().replace("\\", "/").rstrip("/")])
    for i, (a, shown) in enumerate(bare):
        for b, other in bare[i + 1 :]:
            if a == b:
                raise ConfigError(f"source root '{shown}' is given twice")
            if b.startswith(a + "/"):
                raise ConfigError(f"source root '{other}' lies in '{shown}'")


def find(start: str) -> str | None:
    """The settings file of a folder or of the nearest one above it."""
    folder = os.path.abspath(start)
    while True:
        path = os.path.join(folder, FILE)
        if os.path.isfile(path):
            return path
        above = os.path.dirname(folder)
        if above == folder:
            return None
        folder = above


def merged_excludes(config: Config, more: list[str]) -> list[str]:
    """Excludes of the settings, then of the command line, each once."""
    return list(dict.fromkeys([*config.exclude, *more]))
