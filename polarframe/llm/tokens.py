"""Token ids of a public byte-level BPE vocabulary file, by a library tokenizer in every Python worker."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken

# The splitting pattern of byte-level BPE files without one of their own, and the bytes that such
# files write as themselves; the others are written as the code points from 256 on.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_of() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(PLAIN)]
    return {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[int, int]], dict[str, int]]:
    """Ordinary tokens with their ids, merges as id pairs in order of priority, and special tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    back = byte_of()
    named = {t: i for t, i in file["model"]["vocab"].items() if t not in special}
    tokens = {bytes(back[c] for c in t): i for t, i in named.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    merges = [(named[a], named[b]) for a, b in pairs]
    if [named[a + b] for a, b in pairs] != sorted(named[a + b] for a, b in pairs):
        raise ValueError(f"{path}: ids do not follow the order of the merges")
    return tokens, merges, special


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    tokens, _, special = vocabulary(path)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens=special)


def encode(path: str, text: str | None, specials: bool = True) -> np.ndarray:
    """Ids of a text (none for null). ``specials``: strings of special tokens become those tokens."""
    if not text:
        return np.zeros(0, np.uint32)
    return encoding(path).encode_to_numpy(text, allowed_special="all" if specials else set(), disallowed_special=())
