"""Token ids of whole texts with a public vocabulary file.

The vocabulary's rules cut a text at white space before anything else, so the ids of a text are
those of its white-space chunks in turn. Each worker remembers the ids of recent chunks; a chunk met again costs one
lookup. The result equals that of encoding the whole text (tested).
"""

from __future__ import annotations

import re
import string

import numpy as np

REMEMBERED = 300_000  # chunks per generation of a worker's memory; two generations are held
LONGEST = 64  # longer chunks are encoded but not remembered

#: Letters whose lower-case form and byte form need no further normalization.
PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Control characters that Python's split takes for white space and the vocabulary's rules don't.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder(dict):
    """White-space chunk -> its ids as little-endian bytes; the older generation refills the younger one."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.word_pieces = self.tokenizer.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._encode(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encode(self, chunk: str) -> bytes:
        word = chunk.rstrip(string.punctuation)
        if not word or not PLAIN_WORD.fullmatch(word):
            return self._whole(chunk)
        if len(word) < len(chunk):
            tail = chunk[len(word) :]
            if tail not in self.tails:
                if len(self.tails) >= 10_000:
                    self.tails.clear()
                self.tails[tail] = self._whole(tail)
            return self[word] + self.tails[tail]
        word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return np.array([piece.id for piece in self.word_pieces(word)], self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of ``text``, without special tokens of its own."""
        if any(c in text for c in ODD_SPACES):
            return self._whole(text)
        if text.isascii() and "<|" not in text:
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


_LOADED: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]
