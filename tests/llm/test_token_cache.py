"""Token ids don't depend on what a worker still holds of earlier texts."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing

TEXTS = ["The cat, the CAT... (2024)", None, "", "jekyll's jekyll-2 a<|endoftext|>b", "don't stop -- ever!!", "naïve ΣΑΣ é 文 x.", "the cat, again", "." * 300]


@pytest.mark.parametrize("units, held", [(1, 1 << 20), (6, 1 << 20), (1_000_000, 16), (1_000_000, 1 << 20)])
def test_ids_after_eviction(monkeypatch, units, held):
    monkeypatch.setattr(packing, "CACHE", units)
    monkeypatch.setattr(packing, "HELD_BYTES", held)
    monkeypatch.setattr(packing, "GATHER", 2)
    monkeypatch.setattr(packing, "ENCODED", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens, plain = packing.Tokens(path), Tokenizer.from_file(path)
    for some in (TEXTS, TEXTS[3:], TEXTS[:4], TEXTS[::-1], [], TEXTS):
        got = [np.frombuffer(b, "<u4").tolist() for b in tokens.of(some)]
        assert got == [plain.encode(x or "", add_special_tokens=False).ids for x in some]
