"""Token ids of whole texts by the tokenizers library.

The library is slow on running text, as it tracks alignments. Where a text holds only
characters for which lower-casing and composition are plain, it is cut here at blanks,
its words into the pieces that the tokenizer's own pre-tokenizer would cut, and the
library's model encodes each distinct piece once. Any other text, and any tokenizer of another make,
goes through the library whole. Both ways give the same ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np

#: Words and pieces in each of a worker's two stores, and the longest that is remembered.
CACHE, LONGEST = 200_000, 64
#: The pre-tokenizer's pattern that the short way is made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The normalizers that it is made for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Latin letters and ASCII without the four characters that Python alone counts as blank.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]*")
_LETTERS = "a-zß-öø-ÿ"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\t-\r {_LETTERS}0-9]+")
_ENCODERS: dict[str, Encoder] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Store(dict):
    """Ids of words and pieces as bytes. When it is full it becomes the old store, from which those that come again move on."""

    def __init__(self, tokenize: Callable[[str], bytes], limit: int):
        super().__init__()
        self.tokenize, self.limit = tokenize, limit
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            pieces = _PIECES.findall(word)
            ids = self.tokenize(word) if len(pieces) == 1 else b"".join(map(self.__getitem__, pieces))
            if len(word) > LONGEST:
                return ids
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """encode(text) -> uint32 ids, without special tokens added."""

    def __init__(self, path: str, limit: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.short = (made.get("normalizer") or {}).get("normalizers") == NORMALIZERS and steps[0].get("pattern") == {"Regex": PATTERN} and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        self.marks = [x["content"] for x in made.get("added_tokens", [])]
        self.width = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        self.known = _Store(self._tokenize, limit)

    def _tokenize(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isprintable() else self.bytes.pre_tokenize_str(piece)[0][0]
        return array(self.width, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not self.short or not _PLAIN.fullmatch(text) or any(m in text for m in self.marks):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, text.lower().split())), self.width).astype(np.uint32)


def encoder(path: str) -> Encoder:
    """The worker's encoder for the file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
