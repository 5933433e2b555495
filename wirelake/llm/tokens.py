"""Token ids of public vocabularies; a worker loads a vocabulary once."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np


def special_tokens(path: str) -> dict[str, int]:
    """The special tokens that a ``.json`` vocabulary finds in texts."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", []) if t.get("special")}


@lru_cache(maxsize=1)
def encoder(path: str, specials: tuple[tuple[str, int], ...] = ()):
    """A function from a text to its ids (uint32), those of ``tokenizers`` without added special tokens.

    A byte-level ``.json`` vocabulary that has the same vocabulary beside it as ranks is encoded by
    those, which is several times as fast and takes a fraction of the memory; special tokens that a
    text spells out get their own ids, as in ``tokenizers``. The tests hold both against each other.
    """
    ranks = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=dict(specials))
        names = [s for s, _ in specials]

        def by_ranks(text: str) -> np.ndarray:
            odd = any(s in text for s in names)
            return np.array(fast.encode(text, allowed_special="all") if odd else fast.encode_ordinary(text), dtype=np.uint32)

        return by_ranks
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def by_tokenizers(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return by_tokenizers
