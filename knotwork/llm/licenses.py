"""Licences of documents: Aho-Corasick finds tags and notice phrases, a shunting-yard parser evaluates expressions.

Scale: one scan, no shuffle; an automaton of all phrases is built once a worker. Text that follows an identifier tag is
parsed to the end of its line only, as an expression never goes further.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm._text import batches

FOUND = (
    "doc_id long, licenses array<string>, expressions array<string>, permissive boolean, "
    "matches array<struct<kind:string,license:string,phrase:string,at:int>>"
)
_CC = ("1.0", "2.0", "2.5", "3.0", "4.0")
_GNU = [f"{n}-{v}-{how}" for n, vs in (("GPL", "123"), ("AGPL", "13")) for v in (f"{x}.0" for x in vs) for how in ("only", "or-later")]
_GNU += [f"LGPL-{v}-{how}" for v in ("2.0", "2.1", "3.0") for how in ("only", "or-later")]
_GNU += [f"GFDL-1.{v}-{how}" for v in "123" for how in ("only", "or-later")]
_FAMILIES = {
    "permissive": """0BSD AFL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause
        BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSD-Source-Code BSL-1.0 CC0-1.0 curl ECL-2.0 EFL-2.0 FSFAP FTL HPND ICU
        IJG ISC JSON Libpng libtiff MIT MIT-0 MIT-CMU MIT-Modern-Variant MS-PL MulanPSL-2.0 NCSA Naumen NTP OFL-1.1 OGL-UK-3.0 OLDAP-2.8 OpenSSL
        PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby SAX-PD Spencer-94 SSLeay TCL Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim
        W3C WTFPL X11 Xnet Zend-2.0 Zlib zlib-acknowledgement ZPL-2.0 ZPL-2.1 blessing bzip2-1.0.6 """
    + " ".join(f"CC-BY-{v}" for v in _CC),
    "copyleft": "APSL-2.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPAL-1.0 CPL-1.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 IPL-1.0 MPL-1.0 MPL-1.1 MPL-2.0 "
    "MPL-2.0-no-copyleft-exception MS-RL NPL-1.1 ODbL-1.0 OSL-3.0 QPL-1.0 RPL-1.5 Sleepycat "
    + " ".join([*_GNU, *(f"CC-BY-SA-{v}" for v in _CC)]),
    "restricted": "BUSL-1.1 Elastic-2.0 SSPL-1.0 PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0 LicenseRef-AllRightsReserved "
    + " ".join(f"CC-BY-{kind}-{v}" for kind in ("NC", "NC-SA", "NC-ND", "ND") for v in _CC),
}
#: Identifier -> family.
LICENSES = {name: family for family, names in _FAMILIES.items() for name in names.split()}
RESERVED = "LicenseRef-AllRightsReserved"
#: Old identifiers and usual spellings, lower-cased -> identifier.
ALIASES = {x[:-5].lower(): x for x in _GNU if x.endswith("-only")} | {x[:-9].lower() + "+": x for x in _GNU if x.endswith("-or-later")}
ALIASES |= {"apache 2.0": "Apache-2.0", "apache2": "Apache-2.0", "bsd": "BSD-3-Clause", "gplv2": "GPL-2.0-only", "gplv3": "GPL-3.0-only"}
KNOWN = {k.lower(): k for k in LICENSES} | ALIASES
#: Exceptions that lift the terms of a copyleft licence for what is linked or built with the work.
EXCEPTIONS = {
    x.lower(): x
    for x in "Autoconf-exception-3.0 Bison-exception-2.2 Classpath-exception-2.0 Font-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 LLVM-exception "
    "Linux-syscall-note LGPL-3.0-linking-exception OpenSSL-exception Qt-LGPL-exception-1.1 Universal-FOSS-exception-1.0 WxWindows-exception-3.1".split()
}
TAGS = ("spdx-license-identifier:", "license-expression:")


def _phrases() -> dict[str, str]:
    """Phrase, lower-cased and with single blanks -> identifier."""
    made = {
        "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
        "under the mit license": "MIT",
        "the mit license": "MIT",
        "mit license": "MIT",
        "mit licence": "MIT",
        "redistribution and use in source and binary forms": "BSD-2-Clause",  # what its clauses add: see MARKS
        "this software is provided 'as-is', without any express or implied warranty": "Zlib",
        "permission to use, copy, modify, and/or distribute this software for any purpose": "ISC",
        "permission to use, copy, modify, and distribute this software for any purpose": "ISC",
        "isc license": "ISC",
        "zlib license": "Zlib",
        "boost software license": "BSL-1.0",
        "common development and distribution license": "CDDL-1.0",
        "this is free and unencumbered software released into the public domain": "Unlicense",
        "released into the public domain": "Unlicense",
        "the unlicense": "Unlicense",
        "do what the fuck you want to public license": "WTFPL",
        "artistic license 2.0": "Artistic-2.0",
        "sil open font license": "OFL-1.1",
        "postgresql license": "PostgreSQL",
        "python software foundation license": "PSF-2.0",
        "academic free license": "AFL-3.0",
        "open software license": "OSL-3.0",
        "business source license 1.1": "BUSL-1.1",
        "server side public license": "SSPL-1.0",
        "elastic license 2.0": "Elastic-2.0",
        "creativecommons.org/publicdomain/zero/1.0": "CC0-1.0",
        "cc0 1.0": "CC0-1.0",
        "all rights reserved": RESERVED,
    }
    for name, also in (("BSD-2-Clause", "simplified bsd"), ("BSD-3-Clause", "new bsd"), ("BSD-3-Clause", "modified bsd"), ("BSD-4-Clause", "original bsd")):
        n = name[4]
        made |= {f"{also} license": name, f"bsd {n}-clause": name, f"{n}-clause bsd": name, f"bsd-{n}-clause license": name}
    for form in ("license, version 2.0", "license version 2.0", "license 2.0", "license, 2.0", "license v2.0", "license, v2.0", "software license 2.0", "2.0 license"):
        made |= {f"apache {form}": "Apache-2.0", f"under the apache {form}": "Apache-2.0"}
    for name, key, versions in (("mozilla", "MPL", ("1.1", "2.0")), ("eclipse", "EPL", ("1.0", "2.0")), ("european union", "EUPL", ("1.1", "1.2"))):
        for v in versions:
            for word in ("license", "licence"):
                made |= {f"{name} public {word}{gap}{v}": f"{key}-{v}" for gap in (", version ", " version ", " ", ", v. ", " v. ", " v", ", v", " - v ")}
    free = "as published by the free software foundation"
    for name, key, versions in (("general", "GPL", "123"), ("affero general", "AGPL", "3"), ("lesser general", "LGPL", ("2.1", "3")), ("library general", "LGPL", "2")):
        for v in versions:
            base = f"{key}-{v if '.' in v else v + '.0'}"
            whole = f"gnu {name} public license"
            forms = [f"{whole}{gap}{v}" for gap in (", version ", " version ", " v", ", v", " (version ")] + [f"version {v} of the {whole}"]
            for form in forms:
                made[form] = f"{base}-only"
                for later in (" or later", ", or later", " or any later version", ", or any later version", ", or (at your option) any later version", " or (at your option) any later version"):
                    made[form + later] = f"{base}-or-later"
            for sign in (";", ","):
                made[f"{whole} {free}{sign} either version {v} of the license"] = f"{base}-or-later"
                made[f"{whole} {free}{sign} version {v} of the license"] = f"{base}-only"
            made[f"{whole} version {v} only {free}"] = f"{base}-only"
    long = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    for kind in ("by", "by-sa", "by-nc", "by-nc-sa", "by-nc-nd", "by-nd"):
        name = "-".join(long[x] for x in kind.split("-"))
        for v in _CC:
            key = f"CC-{kind.upper()}-{v}"
            made |= {f"cc {kind} {v}": key, f"cc-{kind}-{v}": key, f"cc {kind}-{v}": key, f"creativecommons.org/licenses/{kind}/{v}": key}
            made |= {f"creative commons {x} {v}": key for x in (name, name.replace("noncommercial", "non-commercial"), f"{name} license")}
    return made


PHRASES = _phrases()
#: What tells the longer forms of the licence that begins "redistribution and use" -> identifier, the longest form first.
MARKS = {"all advertising materials mentioning features": "BSD-4-Clause", "neither the name of": "BSD-3-Clause"}
MARKED = "redistribution and use in source and binary forms"
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"\(|\)|/|[A-Za-z0-9.+:-]+")
#: An identifier that isn't in the list: a reference, or with a version behind a hyphen.
IDENTIFIER = re.compile(r"(?i)(?:DocumentRef-[a-z0-9.-]+:)?(?:LicenseRef|AdditionRef)-[a-z0-9.-]+|[a-z][a-z0-9.]*-[a-z0-9.-]*\d[a-z0-9.+-]*|[a-z0-9.-]+-exception")


#: What stands between two words of a wrapped notice: white space, and comment marks where a line begins.
BETWEEN = re.compile(r"\s*\n\s*(?:[#*/;%!>|<-]+\s*)*|\s+")


class ExpressionError(ValueError):
    """The text isn't a licence expression."""


def name_of(word: str) -> str:
    return KNOWN.get(word.lower(), EXCEPTIONS.get(word.lower(), word))


def family(name: str) -> str:
    return LICENSES.get(name) or LICENSES.get(name_of(name.removesuffix("+")), "unknown")


def _is_identifier(word: str) -> bool:
    low = word.lower()
    return low in KNOWN or low in EXCEPTIONS or low.removesuffix("+") in KNOWN or IDENTIFIER.fullmatch(word) is not None


def to_postfix(text: str) -> list[str]:
    """Shunting-yard: with binds closer than and, and closer than or; all are left-associative. Operators in lower case.

    A slash is an or. An expression ends before what can't go on: a licence after a licence, or an operator in small
    letters, or a slash, with no identifier behind it, which is prose.
    """
    out: list[str] = []
    held: list[str] = []
    operand = True
    tokens = TOKEN.findall(text)
    for i, token in enumerate(tokens):
        word = "or" if token == "/" else token.lower()
        if word in PRECEDENCE:
            if operand:
                raise ExpressionError(f"{token} without a licence before it")
            after = next((x for x in tokens[i + 1 :] if x != "("), None)
            if not token.isupper() and after is not None and not _is_identifier(after):
                break
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        elif token == "(":
            if not operand:
                break
            held.append(token)
        elif token == ")":
            if operand:
                raise ExpressionError("an empty parenthesis")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ExpressionError("a parenthesis too many")
            held.pop()
        else:
            if not operand:
                break
            out.append(name_of(token))
            operand = False
    if operand or "(" in held:
        raise ExpressionError("unfinished expression")
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[str, bool, list[str]]:
    """(expression with the parentheses it needs, whether its terms can be met permissively, licences in it).

    or offers a choice: one permissive side is enough. and demands both. with keeps the licence, and makes one of a
    copyleft family permissive if the exception is a known one.
    """
    stack: list[tuple[str, int, bool, list[str], str]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append((token, 4, family(token) == "permissive", [token], family(token)))
            continue
        if len(stack) < 2:
            raise ExpressionError("an operator without its sides")
        right, left = stack.pop(), stack.pop()
        rank = PRECEDENCE[token]
        if token == "with":
            if left[1] != 4 or right[1] != 4:
                raise ExpressionError("with joins one licence and one exception")
            lifted = right[0].lower() in EXCEPTIONS and left[4] == "copyleft"
            stack.append((f"{left[0]} WITH {right[0]}", rank, left[2] or lifted, left[3], left[4]))
            continue
        sides = [f"({x[0]})" if x[1] < rank else x[0] for x in (left, right)]
        met = (left[2] or right[2]) if token == "or" else (left[2] and right[2])
        stack.append((f" {token.upper()} ".join(sides), rank, met, left[3] + right[3], ""))
    if len(stack) != 1:
        raise ExpressionError("more than one expression")
    return stack[0][0], stack[0][2], stack[0][3]


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase, license_id in PHRASES.items():
        made.add_word(phrase, ("notice", license_id, phrase))
    for tag in TAGS:
        made.add_word(tag, ("tag", "", tag))
    for phrase, license_id in MARKS.items():
        made.add_word(phrase, ("mark", license_id, phrase))
    made.make_automaton()
    return made


def triggers() -> ahocorasick.Automaton:
    """The longest word of each tag and phrase: a text without any of them holds none."""
    made = ahocorasick.Automaton()
    for phrase in (*PHRASES, *TAGS):
        made.add_word(max(phrase.split(" "), key=len), True)
    made.make_automaton()
    return made


def _word_char(c: str) -> bool:
    return c.isalnum()


def _ends_well(folded: str, last: int) -> bool:
    """Whether a notice may end here: not inside a word, nor inside a version."""
    after = folded[last + 1 : last + 3]
    if after and _word_char(after[0]):
        return False
    return not (folded[last].isdigit() and len(after) == 2 and after[0] == "." and after[1].isdigit() and after[1] != "0")


def scan_text(text: str, finder: ahocorasick.Automaton, trigger: ahocorasick.Automaton | None = None) -> tuple[list[str], list[str], bool, list[tuple[str, str, str, int]]] | None:
    """(licences, expressions, permissive, matches) of one text, or None without any.

    Of overlapping phrases the one that begins first and is longest counts; a phrase must not begin or end inside a word.
    """
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer: keep positions
        lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    if trigger is not None and next(trigger.iter(lowered), None) is None:
        return None
    folded = BETWEEN.sub(" ", lowered)
    hits, marks = [], []
    for last, (kind, license_id, phrase) in finder.iter(folded):
        first = last - len(phrase) + 1
        if first and _word_char(folded[first - 1]) or kind == "notice" and not _ends_well(folded, last):
            continue
        if kind == "mark":
            marks.append((first, license_id))
        else:
            hits.append((first, last, kind, license_id, phrase))
    if not hits:
        return None
    blanks, shifts = [], [0]  # places of blanks in folded that stand for more, and how far what follows them was moved
    for m in BETWEEN.finditer(lowered):
        if m.end() - m.start() > 1:
            blanks.append(m.start() - shifts[-1])
            shifts.append(shifts[-1] + m.end() - m.start() - 1)
    place = lambda i: i + shifts[bisect_left(blanks, i)]
    hits.sort(key=lambda h: (h[0], -h[1]))
    chosen, reach = [], -1
    for hit in hits:
        if hit[0] > reach:
            chosen.append(hit)
            reach = hit[1]
    begins = [first for first, _, _, _, phrase in chosen if phrase == MARKED]
    matches, licenses, expressions, met = [], [], [], []
    for first, last, kind, license_id, phrase in chosen:
        if phrase == MARKED:
            upto = next((x for x in begins[bisect_right(begins, first) :]), len(folded))
            own = {name for at, name in marks if first < at < upto}
            license_id = next((name for name in MARKS.values() if name in own), license_id)
        first, last = place(first), place(last)
        if kind == "notice":
            matches.append(("notice", license_id, phrase, first))
            licenses.append(license_id)
            if license_id != RESERVED:
                met.append(family(license_id) == "permissive")
            continue
        end = text.find("\n", last + 1)
        line = text[last + 1 : end if end >= 0 else len(text)].strip().strip("*/#-<>! ").strip()
        try:
            expression, permissive, named = evaluate(to_postfix(line))
        except ExpressionError:
            matches.append(("broken_tag", line, phrase, first))
            met.append(False)
            continue
        matches.append(("tag", expression, phrase, first))
        expressions.append(expression)
        licenses.extend(named)
        met.append(permissive)
    return sorted(set(licenses)), sorted(set(expressions)), bool(met) and all(met), matches


_finders: list[tuple[ahocorasick.Automaton, ahocorasick.Automaton]] = []


def _scan(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _finders:
        _finders.append((automaton(), triggers()))
    for batch in batches(parts):
        ids, rows = batch["doc_id"].to_pylist(), []
        for doc_id, text in zip(ids, batch["text"]):
            found = scan_text(text.as_py(), *_finders[0]) if text.is_valid else None
            if found:
                rows.append((doc_id, *found))
        struct = pa.struct([("kind", pa.string()), ("license", pa.string()), ("phrase", pa.string()), ("at", pa.int32())])
        columns = list(zip(*rows)) if rows else [()] * 5
        matches = [[dict(zip(("kind", "license", "phrase", "at"), m)) for m in row] for row in columns[4]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.list_(pa.string())),
                pa.array(columns[2], pa.list_(pa.string())),
                pa.array(columns[3], pa.bool_()),
                pa.array(matches, pa.list_(struct)),
            ],
            names=["doc_id", "licenses", "expressions", "permissive", "matches"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, expressions, permissive, matches) of the rows in which a tag or a notice is found.

    licenses: identifiers, sorted, each once. expressions: what follows identifier tags, in normal form. permissive: every
    notice and expression can be met by permissive terms; "all rights reserved", which stands above permissive notices too,
    counts where nothing else is found. A tag whose expression can't be parsed is not permissive, and is listed as
    'broken_tag' with the rest of its line. matches: in order of place, ``at`` in characters. A notice may be wrapped,
    indented or behind comment marks. Texts are read whole, however long. Rows with null or empty texts, or without a match,
    are left out, so an empty table gives none; repeated rows each give a row. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, FOUND)
