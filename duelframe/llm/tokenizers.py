"""Where the public tokenizers' files lie; they are read in place and never copied."""

from __future__ import annotations

import public_tokenizers


def word_bpe() -> str:
    """Byte-pair merges with word ends over lower-cased text; white space is dropped."""
    return public_tokenizers.path("word_bpe_49k.json")
