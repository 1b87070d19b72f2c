"""Token ids of texts under a published byte-level BPE vocabulary.

One parameter names the vocabulary: a `tokenizers` JSON file. Texts whose characters all lie below
U+0250, where Unicode's classes have long been settled, go through the same merges in tiktoken's
faster implementation; all others go through `tokenizers` itself. Both give the same ids.
"""

from __future__ import annotations

import functools
import json
import os
import re

#: The pre-tokenizer pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BEYOND = re.compile("[^\x00-ɏ]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = _byte_of_char()
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if all(c in of for c in token) and not token.startswith("<|")}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def exact(self):
        """Loaded when the first text needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def __call__(self, text: str) -> list[int]:
        if _BEYOND.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.cache
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)
