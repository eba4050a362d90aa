"""License scans by ordered signature rules.

Rules are regular expressions over the text's words: over a hundred written by hand, and those of families of licences,
their versions and the ways licences are mentioned, made by a rule. A rule runs only where its keyword occurs. A detection inside another one of higher priority,
or of equal priority and longer, is suppressed; of equal spans the earlier rule stays.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import defaultdict
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, lean, letter_words, records

# Phrases and labels of the base scan.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Label, keyword, full names (as alternatives), short name, versions.
FAMILIES = (
    ("gpl", "licen", "gnu general public licen[sc]e|general public licen[sc]e", "gpl", "1 2 3"),
    ("lgpl", "licen", "gnu lesser general public licen[sc]e|lesser general public licen[sc]e|library general public licen[sc]e", "lgpl", "2 2.1 3"),
    ("agpl", "licen", "gnu affero general public licen[sc]e|affero general public licen[sc]e", "agpl", "1 3"),
    ("gfdl", "licen", "gnu free documentation licen[sc]e", "gfdl", "1.1 1.2 1.3"),
    ("apache", "licen", "apache software licen[sc]e|apache licen[sc]e", "apache", "1 1.1 2"),
    ("mit", "licen", "mit licen[sc]e|expat licen[sc]e", "mit license", ""),
    ("bsd", "licen", "bsd licen[sc]e|berkeley software distribution licen[sc]e|modified bsd licen[sc]e|simplified bsd licen[sc]e", "bsd", "1 2 3 4"),
    ("mpl", "licen", "mozilla public licen[sc]e", "mpl", "1 1.1 2"),
    ("epl", "licen", "eclipse public licen[sc]e", "epl", "1 2"),
    ("cpl", "licen", "common public licen[sc]e", "cpl", "1"),
    ("cddl", "licen", "common development and distribution licen[sc]e", "cddl", "1 1.1"),
    ("eupl", "licen", "european union public licen[sc]e", "eupl", "1 1.1 1.2"),
    ("artistic", "licen", "artistic licen[sc]e", "artistic", "1 2"),
    ("bsl", "licen", "boost software licen[sc]e", "bsl", "1"),
    ("isc", "licen", "isc licen[sc]e", "isc license", ""),
    ("zlib", "licen", "zlib licen[sc]e|zlib libpng licen[sc]e", "zlib license", ""),
    ("wtfpl", "licen", "do what the fuck you want to public licen[sc]e", "wtfpl", "1 2"),
    ("ofl", "licen", "sil open font licen[sc]e|open font licen[sc]e", "ofl", "1 1.1"),
    ("python", "licen", "python software foundation licen[sc]e", "psf", "2"),
    ("php", "licen", "php licen[sc]e", "php license", "3 3.01"),
    ("openssl", "licen", "openssl licen[sc]e", "openssl license", ""),
    ("odbl", "licen", "open database licen[sc]e", "odbl", "1"),
    ("odc-by", "licen", "open data commons attribution licen[sc]e", "odc by", "1"),
    ("ms-pl", "licen", "microsoft public licen[sc]e", "ms pl", ""),
    ("ms-rl", "licen", "microsoft reciprocal licen[sc]e", "ms rl", ""),
    ("ogl", "licen", "open government licen[sc]e", "ogl", "1 2 3"),
    ("unlicense", "licen", "unlicen[sc]e", "unlicense", ""),
    ("cc-by", "cc by", "creative commons attribution(?: licen[sc]e)?", "cc by", "1 2 2.5 3 4"),
    ("cc-by-sa", "cc by", "creative commons attribution share ?alike(?: licen[sc]e)?", "cc by sa", "1 2 2.5 3 4"),
    ("cc-by-nc", "cc by", "creative commons attribution non ?commercial(?: licen[sc]e)?", "cc by nc", "1 2 2.5 3 4"),
    ("cc-by-nd", "cc by", "creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)?", "cc by nd", "1 2 2.5 3 4"),
    ("cc-by-nc-sa", "cc by", "creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?", "cc by nc sa", "1 2 2.5 3 4"),
    ("cc-by-nc-nd", "cc by", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[sc]e)?", "cc by nc nd", "1 2 2.5 3 4"),
)
# Rules written by hand, from notices, headers and addresses, as label, keyword, pattern, confidence.
SINGLE = (
    ("public-domain", "public domain", "(?:released|placed|dedicated|is)(?: in| into| to)? the public domain", 0.9),
    ("public-domain", "public domain", "public domain", 0.5),
    ("public-domain", "publicdomain mark", "creativecommons org publicdomain mark 1 0", 0.9),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.9),
    ("cc0-1", "publicdomain zero", "creativecommons org publicdomain zero 1 0", 1.0),
    ("cc0", "waived all copyright", "waived all copyright and related or neighbou?ring rights", 0.9),
    ("reserved", "rights reserved", "copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,6}?all rights reserved", 0.9),
    ("reserved", "rights reserved", "(?:all|some|no) rights reserved", 0.6),
    ("copyright", "copyright", "copyright (?:c )?[0-9]{4}", 0.3),
    ("proprietary", "proprietary", "proprietary (?:and confidential|licen[sc]e|software)", 0.7),
    ("proprietary", "confidential", "confidential and proprietary(?: information)?", 0.7),
    ("proprietary", "unauthori", "unauthori[sz]ed copying of this file via any medium is strictly prohibited", 0.9),
    ("proprietary", "be reproduced", "no part of this [a-z]+ may be reproduced(?: or transmitted)? in any form", 0.8),
    ("proprietary", "written permission", "without the (?:prior )?(?:express )?written permission of", 0.5),
    ("proprietary", "trade secret", "(?:contains|is a) (?:the )?trade secrets?(?: of)?", 0.6),
    ("proprietary", "internal use only", "for internal use only", 0.6),
    ("eula", "licen", "end user licen[sc]e agreement", 0.7),
    ("noncommercial", "commercial use only", "non ?commercial use only", 0.7),
    ("noncommercial", "personal use only", "for personal use only", 0.6),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 0.9),
    ("mit", "mit style", "mit style licen[sc]e", 0.7),
    ("mit", "opensource org", "opensource org licen[sc]es? mit(?: license php)?", 0.95),
    ("mit", "mit x11", "mit x11(?: licen[sc]e)?", 0.8),
    ("x11", "x11 licen", "x11 licen[sc]e", 0.7),
    ("json", "used for good not evil", "the software shall be used for good not evil", 1.0),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification", 0.9),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice", 0.8),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice", 0.8),
    ("bsd-3", "neither the name of", "neither the name of (?:[^ ]+ ){1,12}?nor the names of (?:its|any) contributors may be used to endorse", 0.95),
    ("bsd-4", "all advertising materials", "all advertising materials mentioning features or use of this software must display", 0.95),
    ("bsd-2", "bsd 2 clause", "bsd 2 clause(?: licen[sc]e)?", 0.9),
    ("bsd-3", "bsd 3 clause", "bsd 3 clause(?: licen[sc]e)?", 0.9),
    ("bsd-2", "clause bsd", "(?:2|two) clause bsd(?: licen[sc]e)?", 0.9),
    ("bsd-3", "clause bsd", "(?:3|three) clause bsd(?: licen[sc]e)?", 0.9),
    ("0bsd", "0bsd", "0bsd", 0.9),
    ("0bsd", "zero clause bsd", "zero clause bsd(?: licen[sc]e)?", 0.95),
    ("bsd", "bsd style", "bsd style licen[sc]e", 0.7),
    ("apache-2", "compliance with the licen", "licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e", 1.0),
    ("apache-2", "apache org", "apache org licenses license 2 0(?: txt| html)?", 0.95),
    ("apache-2", "asl 2", "asl 2 0", 0.6),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation", 0.8),
    ("gpl", "you can redistribute it", "free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 0.95),
    ("gpl-2", "either version 2", "gnu general public licen[sc]e as published by the free software foundation either version 2", 1.0),
    ("gpl-3", "either version 3", "gnu general public licen[sc]e as published by the free software foundation either version 3", 1.0),
    ("lgpl-2.1", "either version 2 1", "gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1", 1.0),
    ("lgpl-3", "either version 3", "gnu lesser general public licen[sc]e as published by the free software foundation either version 3", 1.0),
    ("agpl-3", "either version 3", "gnu affero general public licen[sc]e as published by the free software foundation either version 3", 1.0),
    ("gpl", "gnu org", "gnu org (?:licenses|copyleft) gpl(?: html| txt)?", 0.8),
    ("lgpl", "gnu org", "gnu org (?:licenses|copyleft) lgpl(?: html| txt)?", 0.8),
    ("agpl", "gnu org", "gnu org (?:licenses|copyleft) agpl(?: html| txt)?", 0.8),
    ("gfdl", "gnu org", "gnu org (?:licenses|copyleft) fdl(?: html| txt)?", 0.8),
    ("gpl", "gnu gpl", "gnu gpl", 0.7),
    ("lgpl", "gnu lgpl", "gnu lgpl", 0.7),
    ("agpl", "gnu agpl", "gnu agpl", 0.7),
    ("gpl-classpath", "classpath exception", "classpath exception", 0.9),
    ("gfdl", "modify this document under", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 1.0),
    ("mpl-2", "source code form", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 1.0),
    ("mpl-2", "mozilla org mpl", "mozilla org mpl 2 0", 0.95),
    ("mpl-1.1", "contents of this file", "contents of this file are subject to the mozilla public licen[sc]e version 1 1", 1.0),
    ("epl-1", "eclipse org legal", "eclipse org legal epl v10(?: html)?", 0.95),
    ("epl-2", "eclipse org legal", "eclipse org legal epl (?:v20|2 0)(?: html)?", 0.95),
    ("cddl", "contents of this file", "contents of this file are subject to the terms of the common development and distribution licen[sc]e", 0.95),
    ("isc", "permission to use copy", "permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("isc", "the author disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software", 0.8),
    ("zlib", "express or implied warranty", "provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 0.95),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such", 0.9),
    ("libpng", "libpng licen", "libpng licen[sc]e", 0.8),
    ("bsl-1", "boost org", "boost org license 1 0 txt", 0.95),
    ("unlicense", "unencumbered software", "free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "unlicense org", "unlicense org", 0.9),
    ("wtfpl", "you just do what", "you just do what the fuck you want to", 0.95),
    ("beerware", "beer", "beer ?ware(?: licen[sc]e)?", 0.9),
    ("cc-by-4", "creativecommons org", "creativecommons org licenses by 4 0", 1.0),
    ("cc-by-3", "creativecommons org", "creativecommons org licenses by 3 0", 1.0),
    ("cc-by-sa-4", "creativecommons org", "creativecommons org licenses by sa 4 0", 1.0),
    ("cc-by-sa-3", "creativecommons org", "creativecommons org licenses by sa 3 0", 1.0),
    ("cc-by-nc-4", "creativecommons org", "creativecommons org licenses by nc 4 0", 1.0),
    ("cc-by-nd-4", "creativecommons org", "creativecommons org licenses by nd 4 0", 1.0),
    ("cc-by-nc-sa-4", "creativecommons org", "creativecommons org licenses by nc sa 4 0", 1.0),
    ("cc-by-nc-nd-4", "creativecommons org", "creativecommons org licenses by nc nd 4 0", 1.0),
    ("cc-by-sa", "text is available under", "text is available under the creative commons attribution share ?alike licen[sc]e", 0.95),
    ("ofl-1.1", "sil org", "sil org ofl", 0.9),
    ("ofl", "reserved font name", "with reserved font names?", 0.8),
    ("python-2", "psf licen", "psf licen[sc]e agreement(?: for python)?", 0.9),
    ("php-3.01", "php net", "php net licen[sc]e 3 01 txt", 0.95),
    ("openssl", "openssl project", "software developed by the openssl project", 0.9),
    ("openssl", "eric young", "cryptographic software written by eric young", 0.9),
    ("artistic", "as perl itself", "under the same terms as perl itself", 0.8),
    ("ruby", "ruby s licen", "ruby s licen[sc]e", 0.8),
    ("ms-pl", "opensource org", "opensource org licen[sc]es? ms pl", 0.95),
    ("odbl-1", "opendatacommons org", "opendatacommons org licenses odbl(?: 1 0)?", 0.95),
    ("odc-by-1", "opendatacommons org", "opendatacommons org licenses by(?: 1 0)?", 0.95),
    ("pddl-1", "opendatacommons org", "opendatacommons org licenses pddl(?: 1 0)?", 0.95),
    ("ogl-3", "nationalarchives gov uk", "nationalarchives gov uk doc open government licence version 3", 0.95),
    ("ncsa", "university of illinois", "university of illinois ncsa open source licen[sc]e", 0.95),
    ("postgresql", "postgresql licen", "postgresql licen[sc]e", 0.9),
    ("hpnd", "historical permission notice", "historical permission notice and disclaimer", 0.9),
    ("afl-3", "academic free licen", "academic free licen[sc]e(?: v(?:ersion)? ?3(?: 0)?)?", 0.9),
    ("osl-3", "open software licen", "open software licen[sc]e(?: v(?:ersion)? ?3(?: 0)?)?", 0.9),
    ("qpl", "q public licen", "q public licen[sc]e", 0.9),
    ("ipl-1", "ibm public licen", "ibm public licen[sc]e(?: version 1(?: 0)?)?", 0.9),
    ("lppl", "latex project public licen", "latex project public licen[sc]e", 0.95),
    ("sspl-1", "server side public licen", "server side public licen[sc]e", 0.95),
    ("busl-1.1", "business source licen", "business source licen[sc]e(?: 1 1)?", 0.95),
    ("elastic-2", "elastic licen", "elastic licen[sc]e(?: 2(?: 0)?)?", 0.9),
    ("commons-clause", "commons clause", "commons clause", 0.9),
    ("vim", "vim licen", "vim licen[sc]e", 0.9),
    ("ftl", "freetype project licen", "freetype project licen[sc]e", 0.9),
    ("ijg", "independent jpeg group", "work of the independent jpeg group", 0.8),
    ("unicode", "unicode", "unicode(?: inc)? licen[sc]e agreement", 0.9),
    ("w3c", "w3c software", "w3c software (?:and document )?notice and licen[sc]e", 0.95),
    ("sleepycat", "sleepycat licen", "sleepycat licen[sc]e", 0.9),
    ("upl-1", "universal permissive licen", "universal permissive licen[sc]e(?: v(?:ersion)? ?1(?: 0)?)?", 0.95),
    ("mulan-2", "mulan permissive", "mulan permissive software licen[sc]e(?: v(?:ersion)? ?2)?", 0.95),
    ("cecill", "cecill", "cecill(?: [bc])?(?: licen[sc]e)?", 0.8),
    ("erlang", "erlang public licen", "erlang public licen[sc]e", 0.9),
    ("nasa-1.3", "nasa open source", "nasa open source agreement(?: version 1 3)?", 0.9),
    ("openrail", "rail m", "open ?rail m(?: licen[sc]e)?", 0.9),
    ("llama", "community licen", "llama (?:[0-9] )*community licen[sc]e", 0.9),
)


# SPDX identifiers that are not the family's short name.
SPDX = {"mit": "mit", "isc": "isc", "zlib": "zlib", "php": "php", "openssl": "openssl", "python": "psf|python", "ogl": "ogl(?: uk)?"}


class Rule(NamedTuple):
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    confidence: float


@functools.lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, those of higher priority first."""
    out = []

    def add(label, keyword, pattern, priority, confidence):
        out.append(Rule(label, keyword.encode(), re.compile(f"(?<= )(?:{pattern})(?= )".encode()), priority, confidence))

    for label, keyword, names, short, versions in FAMILIES:
        ids = SPDX.get(label, short)
        gate = "licen" if keyword == "licen" else "creative commons"
        for version in versions.split():
            v = version.replace(".", " ") + ("(?: 0)?" if "." not in version else "")
            named = f"{label}-{version}"
            full = f"(?:{names})(?: (?:version|v|ver))? ?v?{v}"
            add(named, "spdx", f"spdx licen[sc]e identifier (?:{ids}) ?v?{v}(?: only| or later| clause)?", 90, 1.0)
            add(named, gate, f"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?{full}(?: (?:or|and) (?:any )?later(?: version)?)?", 80, 0.95)
            add(named, gate, f"{full}(?: (?:or|and) (?:any )?later(?: version)?)?", 70, 0.9)
            add(named, short if keyword == "licen" else keyword, f"{short} ?(?:version |v )?v?{v}(?: (?:only|or later|clause|international|unported))?", 60, 0.8)
        add(label, gate, f"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:{names})", 50, 0.8)
        add(label, gate, names, 40, 0.7)
        add(label, "spdx", f"spdx licen[sc]e identifier (?:{ids})", 85, 0.95)
        add(label, short, f"(?:licen[sc]ed?|released) under (?:a |an |the )?(?:{short})", 45, 0.7)
        if keyword == "cc by":
            add(label, keyword, short, 20, 0.6)
    for label, keyword, pattern, confidence in SINGLE:
        add(label, keyword, pattern, 35, confidence)
    return tuple(sorted(out, key=lambda r: -r.priority))


def detect(text: bytes) -> list[tuple[int, int, Rule]]:
    """Spans, in bytes of the words joined by single blanks, that survive suppression, by start."""
    found, there = defaultdict(list), {}
    for rule in rules():
        if rule.keyword not in there:
            there[rule.keyword] = rule.keyword in text
        if there[rule.keyword]:
            found[rule.priority] += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(text)]
    kept: list[tuple[int, int, Rule]] = []
    starts, ends = [], []  # of all spans of higher priority, by start, and the greatest end so far
    for priority in sorted(found, reverse=True):
        top, own = -1, sorted(found[priority], key=lambda x: (x[0], -x[1]))
        for s, e, rule in own:
            k = bisect_right(starts, s)
            if max(top, ends[k - 1] if k else -1) < e:
                kept.append((s, e, rule))
            top = max(top, e)
        spans = sorted([*zip(starts, ends), *((s, e) for s, e, _ in own)])
        starts, ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    return sorted(kept, key=lambda x: x[:2])


_BASE = tuple((f" {p} ".encode(), label) for p, label in BASE)
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.string()))])
_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<string>"


def scan(text: str | None) -> tuple:
    words = letter_words(text)
    joined = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in _BASE:
        at = joined.find(phrase)
        while at >= 0:
            starts.append(at)
            labels.add(label)
            at = joined.find(phrase, at + 1)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    before = lambda at: int(np.searchsorted(blanks, at))  # noqa: E731  blanks left of a place
    places = [before(at) for at in ((min(starts), max(starts)) if starts else ())]
    found = detect(joined)
    miss = 1.0 if not starts else 0.5
    for _, _, rule in found:
        miss *= 1 - rule.confidence
    told = [f"{before(s) - 1}:{before(e)}:{r.label}" for s, e, r in found]
    return len(words), len(starts), *(places or (None, None)), ",".join(sorted(labels)), ",".join(sorted(labels | {r.label for _, _, r in found})), 1 - miss, told


def license_scan(docs: DataFrame) -> DataFrame:
    """A row for each input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections: start:end:label, in words, the end exclusive; of equal spans of equal priority the earlier rule stays.
    Null or empty text has no words, labels or score. Very long texts are scanned whole, in time linear in their matches.
    Repeated rows are scanned each, extra columns ignored; an empty table gives no rows.
    """

    def run(frames):
        yield from batches(((doc_id, *scan(text)) for doc_id, text in records(frames)), _OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), _DDL)
