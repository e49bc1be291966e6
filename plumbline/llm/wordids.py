"""Token ids of whole texts, each distinct word encoded once per worker.

The byte-level pattern never lets a token cross a single space between two characters that
aren't white space, so a text's ids are those of its parts, cut before each such space. Parts
repeat; a worker keeps a bounded dictionary of their ids. New parts are encoded from the same
vocabulary file by ranks where its merges are in order of their ids (checked on loading, as is
parity on a set of probes), and by the tokenizers library where they aren't; texts that hold a
special token always go to the tokenizers library whole.
"""

from __future__ import annotations

import json
import re
import struct

#: Entries a worker's dictionary may hold before it is emptied.
CACHE_WORDS = 600_000
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RARE_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
_INNER = re.compile(r"(?<=\S) (?=\S)")
_PROBES = ["", "a", " the", "Don't  stop 12,345!\n\n x", "naïve café — 東京 🙂", " \t end ", "x" * 60, "THE!! ###$$$ 3.14"]


def _octets() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level vocabularies means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _by_ranks(path: str, tokenizer):
    """An encoder of the same file by ranks, or None if the file isn't of that kind."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, octet = spec["model"], _octets()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    try:
        ranks = {bytes(octet[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(p)] for p in pairs]
        encoding = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (KeyError, ValueError):
        return None
    if made != sorted(made) or any(encoding.encode_ordinary(p) != tokenizer.encode(p, add_special_tokens=False).ids for p in _PROBES):
        return None
    return encoding.encode_ordinary


class _Words(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encode(" " + word)
        return ids


class WordIds:
    """ids of texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _by_ranks(path, self.tokenizer)
        self.words = _Words(self._packed)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _packed(self, text: str) -> bytes:
        if self.ranked is None:
            return self._whole(text)
        ids = self.ranked(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def parts(text: str) -> list[str]:
        if text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or _RARE_SPACE.search(text):
            return _INNER.split(text)
        return text.split(" ")

    def encode(self, text: str) -> bytes:
        if self.ranked is None or any(s in text for s in self.special):
            return self._whole(text)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        first, *rest = self.parts(text)
        return self._packed(first) + b"".join(map(self.words.__getitem__, rest))


_LOADED: dict[str, WordIds] = {}


def loaded(path: str) -> WordIds:
    """This worker's dictionary for the vocabulary file at ``path``."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
