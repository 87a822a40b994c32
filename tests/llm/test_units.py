"""Units that no cache has seen go to the tokenizers library's model past its pre-tokeniser."""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from tidemark.llm.tokens import UnitEncoder

TEXTS = ["the cat, the CAT -- naïve façade (ÆØÅ) don't x1 42nd\n\n\ta  b", "  ", None, "Ġ Ċ ÷×Ã §§ <|endoftext|>", "ünïcödé" * 9 + "; ok\r\n", "plain words only"]


def test_plain_units_pass_by_the_pre_tokeniser():
    enc = UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    library, asked = enc.whole, []
    enc.whole = lambda text: asked.append(text) or library(text)
    ids, counts = enc.encode(pa.array(TEXTS))
    assert not asked
    assert ids.tolist() == [x for t in TEXTS for x in library(t or "")]
    assert counts.tolist() == [len(library(t or "")) for t in TEXTS]
