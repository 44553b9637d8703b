"""License scans by ordered signature rules.

Texts are normalised to lower-cased words, single-spaced.  Hundreds of regular
expressions, made from a table of licenses and a list of hand-written phrasings, are
tried in order of priority; a rule runs only on texts that hold its keywords, and a
text without any of the few words that every rule needs is done after that test.
Detections are resolved by priority and containment: one that lies within a detection
of higher priority (or an equal or longer one of the same priority) is suppressed.
The base phrases are rules that are never suppressed.
"""

from __future__ import annotations

import bisect
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text, words_of

# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, the names a license goes by, and its SPDX ids, as normalised words.
LICENSES = (
    ("mit", "mit|expat|x11", "mit|mit 0|x11"),
    ("apache", "apache|apache software", "apache 2 0|apache 1 1"),
    ("gpl", "gnu general public|gnu gpl|gpl|gplv2|gplv3", "gpl 2 0(?: only| or later)?|gpl 3 0(?: only| or later)?"),
    ("lgpl", "gnu lesser general public|gnu library general public|lgpl", "lgpl 2 1(?: only| or later)?|lgpl 3 0(?: only| or later)?"),
    ("agpl", "gnu affero general public|affero general public|agpl", "agpl 3 0(?: only| or later)?"),
    ("gfdl", "gnu free documentation|gfdl", "gfdl 1 [123](?: only| or later)?"),
    ("mpl", "mozilla public|mpl", "mpl 2 0|mpl 1 1"),
    ("epl", "eclipse public|epl", "epl 2 0|epl 1 0"),
    ("cddl", "common development and distribution|cddl", "cddl 1 0|cddl 1 1"),
    ("bsd", "bsd|(?:new|modified|simplified|revised|original) bsd|[234] clause bsd|bsd [234] clause|berkeley software distribution", "bsd [234] clause|0bsd"),
    ("isc", "isc|internet systems consortium", "isc"),
    ("zlib", "zlib|zlib libpng", "zlib"),
    ("boost", "boost software|boost", "bsl 1 0"),
    ("artistic", "artistic|perl artistic", "artistic 2 0|artistic 1 0"),
    ("unlicense", "unlicense|the unlicense", "unlicense"),
    ("wtfpl", "wtfpl|do what the fuck you want to public", "wtfpl"),
    ("cc0", "cc0|creative commons zero", "cc0 1 0"),
    ("cc-by", "creative commons attribution|cc by", "cc by [1234] 0"),
    ("cc-by-sa", "creative commons attribution share ?alike|cc by sa", "cc by sa [1234] 0"),
    ("cc-by-nc", "creative commons attribution non ?commercial|cc by nc", "cc by nc [1234] 0"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative|s|atives)?|cc by nd", "cc by nd [1234] 0"),
    ("psf", "python software foundation|psf", "psf 2 0|python 2 0"),
    ("php", "php", "php 3 0|php 3 01"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl|ssleay", "openssl"),
    ("w3c", "w3c software|w3c", "w3c"),
    ("eupl", "european union public|eupl", "eupl 1 [012]"),
    ("ofl", "sil open font|open font", "ofl 1 1"),
    ("ncsa", "university of illinois ncsa open source|ncsa", "ncsa"),
    ("ms-pl", "microsoft public|ms pl", "ms pl"),
    ("postgresql", "postgresql", "postgresql"),
    ("odbl", "open database|odbl", "odbl 1 0"),
)
# Priority, phrasing and the words that it cannot do without.  {n} is a name, {s} an SPDX id.
PHRASINGS = (
    (10, r"spdx license identifier (?:{s})", ("spdx",)),
    (9, r"licen[sc]ed under the (?:terms of the )?(?:{n})(?: licen[sc]e)?(?: version [0-9]+(?: [0-9]+)?)?", ("licen",)),
    (9, r"(?:released|distributed|published|available|covered|dual licensed) under the (?:terms of the )?(?:{n}) licen[sc]e(?: version [0-9]+(?: [0-9]+)?)?", ("licen",)),
    (8, r"under the terms (?:and conditions )?of the (?:{n}) licen[sc]e(?: version [0-9]+(?: [0-9]+)?)?", ("licen",)),
    (7, r"(?:{n}) licen[sc]e version [0-9]+(?: [0-9]+)?", ("licen",)),
    (7, r"subject to the (?:terms of the )?(?:{n}) licen[sc]e", ("licen",)),
    (6, r"licen[sc]e (?:type |name |is |the )?(?:{n})(?: licen[sc]e)?", ("licen",)),
    (5, r"(?:{n}) (?:style |like )?licen[sc]ed?", ("licen",)),
)
# Phrasings of licenses that are not named: priority, label, expression, words.
UNNAMED = (
    (8, "mit", r"permission is hereby granted free of charge to any person obtaining a copy", ("permission",)),
    (8, "isc", r"permission to use copy modify and or distribute this software for any purpose", ("permission",)),
    (8, "bsd", r"redistribution and use in source and binary forms with or without modification are permitted", ("redistribution",)),
    (8, "bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy", ("permission",)),
    (8, "zlib", r"this software is provided as is without any express or implied warranty in no event will the authors", ("warranty",)),
    (8, "gpl", r"this program is free software you can redistribute it and or modify it", ("redistribute",)),
    (8, "unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered",)),
    (4, "public-domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain", ("public domain",)),
    (3, "proprietary", r"all rights reserved", ("all rights reserved",)),
    (2, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", ("copyright",)),
    (1, "unknown", r"licen[sc]ed? (?:under|agreement|terms)", ("licen",)),
)


@dataclass(frozen=True)
class Signature:
    priority: int
    label: str
    pattern: re.Pattern
    words: tuple[bytes, ...]


def options(text: str) -> list[str]:
    """The alternatives of an expression at its top level."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def literal(text: str) -> str:
    """The longest literal run outside groups; optional characters are not in it."""
    plain = re.sub(r"\[[^\]]*\]", "|", re.sub(r"\(\?:[^()]*\)\??", "|", text))
    return max(re.sub(r".\?", "|", plain).split("|"), key=len)


def signatures() -> list[Signature]:
    """All rules, highest priority first, then as listed; a name gates its rules with its literal part."""
    rows = [
        (p, label, f.format(n=name, s=name), (*words, literal(name)))
        for p, f, words in PHRASINGS
        for label, names, ids in LICENSES
        for name in options(ids if "{s}" in f else names)
    ]
    rows += UNNAMED
    return [
        Signature(p, label, re.compile(b"(?<= )" + text.encode() + b"(?= )"), tuple(w.encode() for w in words))
        for p, label, text, words in sorted(rows, key=lambda r: -r[0])
    ]


#: A text without all of these has no detection of any rule.
NEEDED = (b"licen", b"spdx", b"permission", b"redistribut", b"warranty", b"unencumbered", b"public domain", b"all rights", b"copyright")


class Detector:
    def __init__(self):
        self.rules = signatures()
        self.base = [(b" " + phrase.encode() + b" ", label) for phrase, label in BASE]

    def detect(self, text: bytes) -> dict:
        """n_words, base [(word, label)] in order, and detections [(label, priority, first word, last word)]."""
        words = words_of(text)
        out = {"n_words": len(words), "base": [], "found": []}
        plain = b" " + b" ".join(words) + b" "
        if not any(k in plain for k in NEEDED):
            return out
        spaces = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 32)

        def word(at: int) -> int:
            return int(np.searchsorted(spaces, at))

        for phrase, label in self.base:
            at = plain.find(phrase)
            while at >= 0:
                out["base"].append((word(at), label))
                at = plain.find(phrase, at + 1)
        out["base"].sort()
        matches: dict[int, list[tuple[int, int, int, str]]] = {}
        has: dict[bytes, bool] = {}
        for number, rule in enumerate(self.rules):
            for w in rule.words:
                if w not in has:
                    has[w] = w in plain
            if all(has[w] for w in rule.words):
                matches.setdefault(rule.priority, []).extend((m.start(), -m.end(), number, rule.label) for m in rule.pattern.finditer(plain))
        out["found"] = [(label, p, word(a - 1), word(b)) for a, b, p, label in resolved(matches)]
        return out


def resolved(matches: dict[int, list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """Of matches (start, -end, rule's number, label) by priority, those (start, end, priority, label) that lie in none
    of higher priority, and in no longer one, or an equal one of an earlier rule, of the same; in order.

    Priorities go from high to low.  Within one, by start and with the longer first, a match lies in another if it
    ends no further than any before it; those of higher priorities are asked by start for how far they reach.
    """
    kept: list[tuple[int, int, int, str]] = []
    starts: list[int] = []
    reach: list[int] = []
    for priority in sorted(matches, reverse=True):
        furthest = -1
        for a, minus_b, _, label in sorted(matches[priority]):
            b = -minus_b
            if b <= furthest:
                continue
            furthest = b
            i = bisect.bisect_right(starts, a) - 1
            if i < 0 or reach[i] < b:
                kept.append((a, b, priority, label))
        kept.sort()
        starts = [k[0] for k in kept]
        reach = list(itertools.accumulate((k[1] for k in kept), max))
    return kept


_detectors: list[Detector] = []


def detector() -> Detector:
    if not _detectors:
        _detectors.append(Detector())
    return _detectors[0]


FIELDS = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "detections": pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])),
}
DDL = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "detections array<struct<label:string,priority:int,first:bigint,last:bigint>>"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its words, the base phrases' places, labels, a score and the detections kept
    (word spans, the last one exclusive).

    ``score`` is the highest priority of a detection over 10, at least 0.5 with a base
    phrase, 0 without any.  Null and empty texts have no words and no labels (empty
    strings); null ids and repeated rows are kept; other columns are ignored.
    """

    def rows(texts: list[bytes]) -> dict[str, list]:
        d = detector()
        out: dict[str, list] = {k: [] for k in FIELDS}
        for t in texts:
            r = d.detect(t)
            base = {label for _, label in r["base"]}
            out["n_words"].append(r["n_words"])
            out["n_base"].append(len(r["base"]))
            out["first_word"].append(r["base"][0][0] if base else None)
            out["last_word"].append(r["base"][-1][0] if base else None)
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | {f[0] for f in r["found"]})))
            out["score"].append(max([0.5 * bool(base), *(f[1] / 10 for f in r["found"])]))
            out["detections"].append([dict(zip(("label", "priority", "first", "last"), f, strict=True)) for f in r["found"]])
        return out

    return map_text(docs, id_col, text_col, rows, FIELDS, DDL)
