"""Token counts of texts under a public byte-level BPE vocabulary.

The vocabulary's own pattern never joins a run of white space and the run of other
characters after it with what follows, so a text's count is the sum of the counts
of such units. Most units recur, and their counts are remembered per worker.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

VOCABULARY = os.environ.get("LEXLODE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNIT = re.compile(r"\s*\S+|\s+\Z")
_REMEMBER = 400_000


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file of token bytes and ranks, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Counts tokens of texts, remembering the counts of their units."""

    def __init__(self, path: str = VOCABULARY):
        self.path, self.known = path, {}

    def unit(self, u: str) -> int:
        n = self.known.get(u)
        if n is None:
            if len(self.known) > _REMEMBER:
                self.known.clear()
            n = len(encoder(self.path).encode_ordinary(u))
            if len(u) < 64:
                self.known[u] = n
        return n

    def __call__(self, text: str) -> int:
        return self.total(UNIT.findall(text))

    def total(self, units: list[str]) -> int:
        known, total = self.known, 0
        for u in units:
            n = known.get(u)
            total += self.unit(u) if n is None else n
        return total
