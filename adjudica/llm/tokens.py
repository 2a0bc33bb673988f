"""The byte-level tokenizer inside tasks: one encoder for each worker process."""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Callable

import numpy as np

#: Text of the vocabulary's only special token.
MARK = "<|endoftext|>"
#: Fixed pattern of the byte-level vocabulary: how text is cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that a vocabulary file writes for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def worker_cache() -> dict:
    """What a worker process keeps from task to task. Functions travel by value, each time with a new module of their own,
    so it can't be kept there."""
    return sys.modules.setdefault("_adjudica_worker", types.ModuleType("_adjudica_worker")).__dict__


def encoder(path: str | None = None) -> Callable[[str], np.ndarray]:
    """Ids of a text under the vocabulary file at `path` (add_special_tokens=False).

    Merges run in tiktoken, which is several times faster on the same vocabulary; a text with the special token's mark
    goes to the tokenizers library itself.
    """
    kept = worker_cache().setdefault("encoders", {})
    if path not in kept:
        kept[path] = _encoder(path)
    return kept[path]


def _encoder(path: str | None) -> Callable[[str], np.ndarray]:
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if word != MARK}
    fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if MARK in text:
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode
