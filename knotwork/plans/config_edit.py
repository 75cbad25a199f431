"""Changes to knotwork.toml that keep every other line as it is. A file is written only if its text changes."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable

HEADER = re.compile(r"^\s*\[{1,2}\s*([A-Za-z0-9_.\"'\s-]+?)\s*\]{1,2}\s*(#.*)?$")


def _quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _open_brackets(line: str, depth: int) -> int:
    """Bracket depth after a line, minding strings and comments."""
    quote = ""
    i = 0
    while i < len(line):
        c = line[i]
        if quote:
            if c == "\\" and quote == '"':
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "#":
            break
        else:
            depth += (c == "[") - (c == "]")
        i += 1
    return depth


def _sections(lines: list[str]) -> list[tuple[str, bool, int]]:
    """(name, whether one of an array of tables, line) of each header outside of values."""
    found, depth = [], 0
    for i, line in enumerate(lines):
        match = HEADER.match(line) if depth == 0 else None
        if match:
            found.append((re.sub(r"[\s\"']", "", match[1]), line.strip().startswith("[["), i))
        else:
            depth = _open_brackets(line, depth)
    return found


def _spread(values: list[str]) -> str:
    return "[\n" + "".join(f"    {_quote(v)},\n" for v in values) + "]" if values else "[]"


def _key_span(lines: list[str], first: int, last: int, key: str) -> tuple[int, int] | None:
    """Lines [begin, end) of a key's value between two lines."""
    i = first
    while i < last:
        depth = _open_brackets(lines[i], 0)
        j = i + 1
        while depth > 0 and j < last:
            depth = _open_brackets(lines[j], depth)
            j += 1
        if re.match(rf"^\s*[\"']?{re.escape(key)}[\"']?\s*=", lines[i]):
            return i, j
        i = j
    return None




def set_cyclic_files(text: str, files: list[str]) -> str:
    """The text with cyclic-files of [cycles] set to the sorted paths, one a line; the table is made if there is none."""
    new = "cyclic-files = " + _spread(sorted(f.replace("\\", "/") for f in files))
    lines = text.split("\n")
    sections = _sections(lines)
    at = next((i for name, array, i in sections if name == "cycles" and not array), None)
    if at is None:
        first = next((i for name, _, i in sections if name.startswith("cycles.")), None)
        if first is not None:
            return "\n".join([*lines[:first], "[cycles]", *new.split("\n"), "", *lines[first:]])
        return text.rstrip("\n") + ("\n\n" if text.strip() else "") + "[cycles]\n" + new + "\n"
    end = min((i for _, _, i in sections if i > at), default=len(lines))
    span = _key_span(lines, at + 1, end, "cyclic-files")
    if span:
        old = "\n".join(lines[span[0] : span[1]])
        if old == new:
            return text
        return "\n".join([*lines[: span[0]], *new.split("\n"), *lines[span[1] :]])
    while end > at + 1 and not lines[end - 1].strip():
        end -= 1
    return "\n".join([*lines[:end], *new.split("\n"), *lines[end:]])


def _keys(text: str) -> set[tuple[str, ...]]:
    entries = tomllib.loads(text).get("cycles", {}).get("ignore", [])
    return {tuple(sorted(f.replace("\\", "/") for f in e["files"])) for e in entries if isinstance(e, dict) and isinstance(e.get("files"), list)}


def missing_ignores(text: str, cycles: list[list[str]]) -> list[tuple[str, ...]]:
    """Cycles that no [[cycles.ignore]] entry lists, each once, sorted."""
    return sorted({tuple(sorted(f.replace("\\", "/") for f in c)) for c in cycles} - _keys(text))


def merge_ignored_cycles(text: str, cycles: list[list[str]]) -> str:
    """The text with a [[cycles.ignore]] entry for each cycle that has none; entries there are, and their reasons, stay."""
    new = missing_ignores(text, cycles)
    if not new:
        return text
    lines = text.split("\n")
    sections = _sections(lines)
    entry = lambda files: ["[[cycles.ignore]]", "files = [" + ", ".join(map(_quote, files)) + "]", ""]
    added = [line for files in new for line in entry(files)]
    ours = [k for k, (name, array, _) in enumerate(sections) if name == "cycles.ignore" and array]
    if not ours:  # a plain ignore = [] under [cycles] would clash with tables of that name
        table = next((i for name, array, i in sections if name == "cycles" and not array), None)
        if table is not None:
            end = min((i for _, _, i in sections if i > table), default=len(lines))
            span = _key_span(lines, table + 1, end, "ignore")
            if span:
                lines[span[0] : span[1]] = []
                sections = _sections(lines)
        ours = [k for k, (name, array, _) in enumerate(sections) if name == "cycles" and not array]
    end = sections[ours[-1] + 1][2] if ours and ours[-1] + 1 < len(sections) else len(lines)
    head, tail = lines[:end], lines[end:]
    while head and not head[-1].strip():
        head.pop()
    return "\n".join([*head, *([""] if head else []), *added[: None if tail else -1], *tail]) + ("" if tail else "\n")


def patch(path: str, edit: Callable[[str], str]) -> bool:
    """Apply an edit to a file; whether that changed it. What the edit makes must parse."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    tomllib.loads(text)
    after = edit(text)
    if after == text:
        return False
    tomllib.loads(after)
    with open(path, "w", encoding="utf-8") as f:
        f.write(after)
    return True
