"""License scans by ordered signature rules.

A text is lower-cased and reduced to its words. Each rule is a regular expression over them with a keyword, a label and a
priority; only rules whose keyword the text contains are run. Of overlapping detections, one that lies within another of higher
priority (or equal priority and greater length) is suppressed. Signatures of license texts, headers, grants and notices are written
out one by one in license_rules; names with versions, and identifiers, are made from a table of families and their versions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.llm.license_rules import SIGNATURES

# The phrases that are always reported, each wherever its words follow each other.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, keyword, name (a regular expression over lower-case words), versions.
FAMILIES = [
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", "1 3"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e", "2.1 3"),
    ("lgpl", "library", "(?:gnu )?library general public licen[cs]e", "2"),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e", "1 2 3"),
    ("agpl", "agpl", "(?:gnu )?agpl", "1 3"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "2 2.1 3"),
    ("gpl", "gpl", "(?:gnu )?gpl", "1 2 3"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e", "1.1 1.2 1.3"),
    ("apache", "apache", "apache(?: software)? licen[cs]e", "1 1.1 2"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "1 1.1 2"),
    ("epl", "eclipse", "eclipse public licen[cs]e", "1 2"),
    ("cddl", "common development", "common development and distribution licen[cs]e", "1 1.1"),
    ("cpl", "common public", "common public licen[cs]e", "1"),
    ("eupl", "european union public", "european union public licen[cs]e", "1 1.1 1.2"),
    ("osl", "open software", "open software licen[cs]e", "1 1.1 2 2.1 3"),
    ("afl", "academic free", "academic free licen[cs]e", "1.1 1.2 2 2.1 3"),
    ("artistic", "artistic", "artistic licen[cs]e", "1 2"),
    ("bsl", "boost", "boost software licen[cs]e", "1"),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e", "1 1.1"),
    ("psf", "python", "python(?: software foundation)? licen[cs]e", "2"),
    ("php", "php licen", "php licen[cs]e", "3 3.01"),
    ("zpl", "zope", "zope public licen[cs]e", "1.1 2 2.1"),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e", ""),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e", ""),
    ("ecl", "educational community", "educational community licen[cs]e", "1 2"),
    ("cecill", "cecill", "cecill(?: free software)?(?: licen[cs]e)?", "1 1.1 2 2.1"),
    ("odbl", "open database", "open database licen[cs]e", "1"),
    ("mulan", "mulan", "mulan (?:permissive software|psl)(?: licen[cs]e)?", "1 2"),
    ("upl", "universal permissive", "universal permissive licen[cs]e", "1"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", ""),
    ("isc", "isc licen", "isc licen[cs]e", ""),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", ""),
    ("unlicense", "unlicense", "(?:the )?unlicense", ""),
    ("wtfpl", "do what the", "do what the fuck you want to public licen[cs]e", "1 2"),
    ("cc0", "cc0", "cc0(?: universal)?", "1"),
    ("mit", "mit licen", "mit licen[cs]e", ""),
    ("mit", "expat", "expat licen[cs]e", ""),
    ("bsd", "bsd licen", "(?:modified |simplified |revised |new )?bsd licen[cs]e", ""),
]
# The parts of Creative Commons licenses, in short and in words, and their versions.
COMMONS = {
    "cc-by": "attribution", "cc-by-sa": "attribution share ?alike", "cc-by-nd": "attribution no ?derivatives", "cc-by-nc": "attribution non ?commercial",
    "cc-by-nc-sa": "attribution non ?commercial share ?alike", "cc-by-nc-nd": "attribution non ?commercial no ?derivatives",
}
COMMONS_VERSIONS = "1 2 2.5 3 4"

#: Priorities, by the way a license is cited.
IDENTIFIER, LATER, VERSION, NAME = 90, 80, 70, 40


@dataclass(frozen=True)
class Rule:
    keyword: bytes
    pattern: re.Pattern[bytes]
    label: str
    priority: int


def _rule(keyword: str, pattern: str, label: str, priority: int) -> Rule:
    return Rule(keyword.encode(), re.compile(rf"(?<![^ ]){pattern}(?![^ ])".encode()), label, priority)


def _number(version: str) -> str:
    """A version as words: '2' also stands for '2 0', v2 and version 2."""
    major, _, minor = version.partition(".")
    tail = f" {minor}" if minor else "(?: 0)?(?! [0-9])"
    return rf"(?:version |ver |v )?v?{major}{tail}"


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, by priority and then length of pattern: a few hundred."""
    out = [_rule(keyword, f"(?:{pattern})", label, priority) for label, priority, keyword, pattern in SIGNATURES]
    for label, keyword, name, versions in FAMILIES:
        out.append(_rule(keyword, name, label, NAME))
        for v in versions.split():
            out.append(_rule(keyword, rf"{name},? {_number(v)}", f"{label}-{v}", VERSION))
            out.append(_rule(keyword, rf"{name} {_number(v)}(?: of the licen[cs]e)? or(?: \S+)? (?:any )?later(?: version)?", f"{label}-{v}-or-later", LATER))
    for label in sorted({f[0] for f in FAMILIES}):
        words = label.replace("-", " ")
        versions = sorted({v for f in FAMILIES if f[0] == label for v in f[3].split()})
        for v in versions:
            out.append(_rule(words, rf"spdx licen[cs]e identifier {words} {_number(v)}(?: only)?", f"{label}-{v}", IDENTIFIER))
            out.append(_rule(words, rf"spdx licen[cs]e identifier {words} {_number(v)} or later", f"{label}-{v}-or-later", IDENTIFIER))
        out.append(_rule(words, rf"spdx licen[cs]e identifier {words}(?! [0-9])", label, IDENTIFIER))
    for label, name in COMMONS.items():
        short = label.replace("-", " ")
        more = "" if label.endswith(("sa", "nd")) else "(?! (?:nc|nd|sa))"
        out.append(_rule("creative commons", rf"creative commons {name}(?! (?:non|no ?deriv|share))", label, NAME))
        out.append(_rule("cc by", rf"{short}{more}", label, NAME))
        for v in COMMONS_VERSIONS.split():
            out.append(_rule("creative commons", rf"creative commons {name}(?: international| unported)? {_number(v)}", f"{label}-{v}", VERSION))
            out.append(_rule("cc by", rf"{short} {_number(v)}", f"{label}-{v}", VERSION))
    for n, word in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        out.append(_rule("clause", rf"(?:bsd (?:{n}|{word}) clause|(?:{n}|{word}) clause bsd)(?: licen[cs]e)?", f"bsd-{n}-clause", VERSION))
    return tuple(sorted(out, key=lambda r: (-r.priority, -len(r.pattern.pattern), r.label)))


#: What isn't part of a word becomes a space: all ASCII but digits and small letters.
_TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else 32 for b in range(256))


def words_of(text: str | None) -> bytes:
    """The words, a space before and after each."""
    return b" " + b" ".join((text or "").encode().lower().translate(_TABLE).split()) + b" "


def detect(text: str | None) -> tuple[int, list[tuple[str, int, int, int, bool]]]:
    """The number of words and the detections left: (label, first word, word after the last, priority, base), in order."""
    words = words_of(text)
    found = []
    for phrase, label in BASE.items():
        at, padded = words.find(b" " + phrase.encode() + b" "), f" {phrase} ".encode()
        while at >= 0:
            found.append((at + 1, at + len(padded) - 1, 100, label, True))
            at = words.find(padded, at + 1)
    keywords: dict[bytes, bool] = {}
    for rule in rules():
        if rule.keyword not in keywords:
            keywords[rule.keyword] = rule.keyword in words
        if keywords[rule.keyword]:
            found += [(m.start(), m.end(), rule.priority, rule.label, False) for m in rule.pattern.finditer(words)]
    kept = _unsuppressed(found)
    spaces, at, n = {}, 0, 0
    for edge in sorted({e for begin, end, *_ in kept for e in (begin, end)}):
        n, at = n + words.count(b" ", at, edge), edge
        spaces[edge] = n
    return (words.count(b" ") - 1 if len(words) > 2 else 0), [(label, spaces[begin] - 1, spaces[end], priority, base) for begin, end, priority, label, base in kept]


def _unsuppressed(found: list[tuple[int, int, int, str, bool]]) -> list[tuple[int, int, int, str, bool]]:
    """Base detections, and of the others those that lie within none that ranks before them (by priority, length, label)."""
    rank = lambda d: (-d[2], d[0] - d[1], d[3])
    kept: list[tuple[int, int, int, str, bool]] = []
    open_: list[tuple[int, int, int, str, bool]] = []
    # in order of begin, the longer first, whatever contains a detection and begins before it is still open
    for d in sorted(set(found), key=lambda d: (d[0], -d[1], *rank(d))):
        open_ = [o for o in open_ if o[1] > d[0]]
        if d[4] or not any(not o[4] and o[0] <= d[0] and d[1] <= o[1] and rank(o) < rank(d) for o in open_):
            kept.append(d)
        open_.append(d)
    return kept


DETECTIONS = "n_words long, detections array<struct<label: string, first: long, after: long, priority: int, base: boolean>>"


def scan(text: Column) -> Column:
    """struct of n_words and detections (label, first word, word after the last, priority, base), of the whole text.

    A null or empty text has no words and no detections. Each row is scanned by itself, so repeated rows get the same result and an
    empty table gives an empty one.
    """

    @F.pandas_udf(DETECTIONS)
    def of(texts: pd.Series) -> pd.DataFrame:
        names = ("label", "first", "after", "priority", "base")
        rows = [(n, [dict(zip(names, d, strict=True)) for d in found]) for n, found in map(detect, texts)]
        return pd.DataFrame(rows, columns=["n_words", "detections"])

    return of(text)
