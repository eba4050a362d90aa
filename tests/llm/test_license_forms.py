"""SPDX identifiers and joined forms of the families, and Creative Commons without the word license."""

import pytest

from tessera.llm.licenses import scan


@pytest.mark.parametrize("text, label", [*((f"// SPDX-License-Identifier: {i}", l) for i, l in (("MIT", "mit"), ("ISC", "isc"), ("Zlib", "zlib"), ("OpenSSL", "openssl"), ("PHP-3.01", "php-3.01"), ("Python-2.0", "python-2"), ("OGL-UK-3.0", "ogl-3"), ("GPL-3.0-only", "gpl-3"))), ("uses GPLv3 code", "gpl-3"), ("LGPLv3", "lgpl-3"), ("(LGPLv2.1+)", "lgpl-2.1"), ("AGPLv3", "agpl-3"), ("under GPL v2", "gpl-2")])
def test_forms(text, label):
    *_, every, score, told = scan(text)
    assert every.split(",") == [label] and score > 0.5 and len(told) == 1


def test_creative_commons():
    *_, every, score, told = scan("released under Creative Commons Attribution 4.0")
    assert every == "cc-by-4" and abs(score - 0.95) < 1e-9 and len(told) == 1
    assert scan("mit students and isc members of zlib")[5:] == ("", 0.0, [])
