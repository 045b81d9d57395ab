"""The ids are those of the tokenizers library, also where a text holds an added token."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

from harvestlens.llm import packing
from tests.llm.cases import texts


def test_ids_with_added_tokens_equal_the_library():
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    awkward = [f"{mark} a", f"a  {mark}  b", mark * 3, f"x{mark}\n\n{mark}y", "<|endoftext|", "<|endoftext |>", f"é{mark}ß "]
    for text in [*awkward, *[t for t in texts() if t], *[f"{t}{mark}{t}" for t in texts() if t]]:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids
    assert 50256 in encode(f"{mark} a")
