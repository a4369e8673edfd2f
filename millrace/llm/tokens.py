"""Token ids of a public byte-level BPE vocabulary.

The vocabulary comes as a tokenizer file and as ranks. Both give the same ids for
texts of common letters; the rank form is four times as fast and is used for those.
Texts with other characters, or with a special token's string, take the tokenizer.
"""

from __future__ import annotations

import base64
import re

import numpy as np

NAME = "byte_bpe_50k"
# Characters on whose classes all Unicode versions agree.
_COMMON = "\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u024f\\u2013-\\u2014\\u2018-\\u201e\\u2022\\u2026\\u20ac"
_OTHER = re.compile(f"[^{_COMMON}]|<\\|")


class Encoder:
    def __init__(self, name: str):
        import public_tokenizers as public
        import tiktoken
        import tokenizers

        with open(public.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = tokenizers.Tokenizer.from_file(public.path(f"{name}.json"))

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if _OTHER.search(text):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def array(self, text: str | None):
        found = self.ids(text)
        return np.fromiter(found, np.uint32, len(found))


def encoder(name: str = NAME) -> Encoder:
    """One encoder for each Python process. It hangs on a module that is imported, not
    sent along with every task."""
    import os

    import tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = tokenizers.__dict__.setdefault("_millrace_encoders", {})
    if name not in kept:
        kept[name] = Encoder(name)
    return kept[name]
