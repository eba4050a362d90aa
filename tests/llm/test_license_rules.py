"""Hand-written rules, suppression against brute force, and long texts."""

import random
import re
import time

import pytest

from tessera.llm.common import letter_words
from tessera.llm.licenses import SINGLE, detect, rules, scan


@pytest.mark.parametrize("text, label", [("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("See https://www.apache.org/licenses/LICENSE-2.0", "apache-2"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"), ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of it", "gpl-3"), ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of", "lgpl-2.1"), ("Neither the name of the University nor the names of its contributors may be used to endorse", "bsd-3"), ("(http://creativecommons.org/licenses/by-sa/4.0/)", "cc-by-sa-4"), ("The Software shall be used for Good, not Evil.", "json"), ("This is free and unencumbered software released into the public domain.", "unlicense"), ("Business Source License 1.1", "busl-1.1"), ("the origin of this software must not be misrepresented", "zlib")])
def test_notices(text, label):
    assert label in scan(text)[5].split(",")


@pytest.mark.parametrize("text", ["the mit campus", "business source of income", "a zero clause", "permission is granted to enter", "apache helicopters version 2", "the public square", "json is good not evil", "version 2 of the general plan"])
def test_near_misses(text):
    assert scan(text)[5:] == ("", 0.0, [])


def shortest(pattern, pick):
    """A short text of a parsed pattern; pick chooses a branch."""
    out = ""
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            out += chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])
        elif name == "NOT_LITERAL":
            out += "q"
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += shortest(arg[2], pick) * max(arg[0], 0)
        elif name == "SUBPATTERN":
            out += shortest(arg[3], pick)
        elif name == "BRANCH":
            out += shortest(arg[1][pick % len(arg[1])], pick)
    return out


def test_gates_let_every_form_pass():
    """No rule's keyword is missing from a text that its pattern fits."""
    assert len(SINGLE) > 100 and len(rules()) > 500
    for r in rules():
        for pick in range(4):
            text = " " + shortest(re._parser.parse(r.pattern.pattern.decode()), pick) + " "
            assert r.pattern.search(text.encode()) and r.keyword in text.encode(), (r.label, text)


def test_suppression_and_base_against_brute_force():
    rng = random.Random(7)
    phrases = ["gnu general public license", "version 2", "or later", "licensed under the", "mit license", "cc by", "cc-by-sa 4.0", "creative commons attribution", "all rights reserved", "copyright 2020 x", "apache license 2.0", "spdx-license-identifier: gpl-3.0-only", "general public license", "word", "public domain", "released into the"]
    for _ in range(150):
        text = " ".join(rng.choice(phrases) for _ in range(rng.randint(0, 25)))
        w = letter_words(text)
        joined = b" " + b" ".join(w) + b" "
        every = [(m.start(), m.end(), k, r) for k, r in enumerate(rules()) if r.keyword in joined for m in r.pattern.finditer(joined)]
        inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and (y[3].priority > x[3].priority or y[3].priority == x[3].priority and (y[1] - y[0], -y[2]) > (x[1] - x[0], -x[2]))
        want = sorted((x[0], x[1], x[3].label) for x in every if not any(inside(x, y) for y in every))
        assert sorted((s, e, r.label) for s, e, r in detect(joined)) == want
        base = sorted((k, l) for p, l in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for k in range(len(w)) if [x.decode() for x in w[k : k + len(p.split())]] == p.split())
        got = scan(text)
        assert got[:5] == (len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({l for _, l in base})))
        assert [tuple(map(int, d.split(":")[:2])) for d in got[7]] == [(len(re.findall(b" ", joined[:s])) - 1, len(re.findall(b" ", joined[:e]))) for s, e, _ in want]


def test_long_text_is_linear():
    began = time.time()
    got = scan("gnu general public license version 2 " * 50_000)
    assert got[1] == 50_000 and len(got[7]) == 50_000 and time.time() - began < 30
