"""Byte-level BPE vocabularies in the ranks format, loaded once in each worker process."""

from __future__ import annotations

import base64
from functools import lru_cache

import tiktoken

#: Where the vocabulary lies; every operator takes it as a parameter.
PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary parts a text before merging: contractions, letters, digits, other marks, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def ranks(path: str = PATH) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(2)
def encoding(path: str = PATH) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(2)
def sizes(path: str = PATH) -> list[int]:
    """Bytes of each token by rank."""
    out = [0] * (max(ranks(path).values()) + 1)
    for token, rank in ranks(path).items():
        out[rank] = len(token)
    return out
