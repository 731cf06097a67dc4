"""Byte-level BPE ids of whole texts.

The split pattern is used without its look-ahead, which is the slow part:
texts are first cut before the last white-space character of a run that a word
follows, where a match of the full pattern always begins.  Long texts are
encoded piece by piece, cut before a space between a visible character and a
letter, so memory does not follow the length of a text.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN = re.compile(f"(?<=[{_SPACES}])(?=[{_SPACES}][^{_SPACES}])")
_HAS_RUN = re.compile(f"[{_SPACES}][{_SPACES}][^{_SPACES}]")
_CUT = re.compile(f"(?<=[^{_SPACES}]) (?=[a-zA-Z])")
# Fixed value: the public split pattern less its look-ahead.
_FAST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
PIECE = 1 << 20


def default_ranks() -> str:
    """Ranks of the vocabulary of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(4)
def encoder(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=_FAST, mergeable_ranks=ranks, special_tokens={})


def _encode(text: str, own) -> list[int]:
    if not _HAS_RUN.search(text):
        return own.encode_ordinary(text)
    return [i for part in _RUN.split(text) for i in own.encode_ordinary(part)]


def default_added() -> dict[str, int]:
    """Added tokens of byte_bpe_50k.json and their ids: their strings are found in a text before anything else."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encode_with_added(text: str, ranks_path: str, added: dict[str, int]) -> np.ndarray:
    """The ids of a text where each string of ``added``, the leftmost and longest first, has its own id."""
    if not any(t in text for t in added):
        return encode(text, ranks_path)
    parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
    return np.concatenate([np.array([added[p]], np.uint32) if k % 2 else encode(p, ranks_path) for k, p in enumerate(parts)])


def encode(text: str, ranks_path: str) -> np.ndarray:
    """The ids of a text; special strings in it are ordinary text."""
    own, out, at = encoder(ranks_path), [], 0
    while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
        out.append(np.array(_encode(text[at : cut.start()], own), np.uint32))
        at = cut.start()
    out.append(np.array(_encode(text[at:] if at else text, own), np.uint32))
    return out[0] if len(out) == 1 else np.concatenate(out)
