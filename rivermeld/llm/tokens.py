"""Token ids of whole texts by a public tokenizer, at most once per distinct word and worker.

The tokenizer splits at white space and drops it, so the ids of a text are the ids of its words one after another.
Ids are held as packed little-endian 32-bit integers; a word costs one dictionary look-up.
"""

from __future__ import annotations

import os
import re
import string
import struct
from collections.abc import Callable
from operator import attrgetter

#: Words held by a worker in each of two generations; older ones are looked up again or encoded anew.
GENERATION = 300_000

_cached: dict[str, Callable[[str], bytes]] = {}
_id = attrgetter("id")


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in printable:
        out[b] = chr(b)
    spare = 256
    for b in range(256):
        if not out[b]:
            out[b] = chr(spare)
            spare += 1
    return out


class _Words(dict):
    """word -> packed ids; missing words are encoded by the tokenizers library."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.old = tokenizer, {}
        self.model = tokenizer.model
        self.letters = _byte_letters()

    def _encode(self, word: str) -> bytes:
        # A word of Latin letters up to U+00FF has one normal form, its lower case, and is one piece for the merges.
        if word.isalpha() and (word.isascii() or max(word) <= "ÿ"):
            lower = word.lower()
            if lower != word:
                return self[lower]
            mapped = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            return _pack([*map(_id, self.model.tokenize(mapped))])
        # Letters before a run of ASCII marks are pieces of their own, and so is the run; both share the entries of the bare ones.
        bare = word.rstrip(string.punctuation)
        if bare != word and bare.isalpha() and max(bare) <= "ÿ":
            return self[bare.lower()] + self[word[len(bare):]]
        return _pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        value = self.old.pop(word, None)
        if value is None:
            value = self._encode(word)
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> packed ids of the whole text without special tokens; kept per worker process and tokenizer file."""
    if path not in _cached:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        words = _Words(Tokenizer.from_file(path))
        get, odd, blank = words.__getitem__, re.compile("[\x1c-\x1f]"), re.compile("[^\\S\x1c-\x1f]+")

        def encode(text: str) -> bytes:
            # Python also splits at four control characters that are no white space to the tokenizer.
            parts = [x for x in blank.split(text) if x] if odd.search(text) else text.split()
            return b"".join(map(get, parts))

        _cached[path] = encode
    return _cached[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
