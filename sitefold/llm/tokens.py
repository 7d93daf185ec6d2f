"""Token ids of whole texts by a public tokenizer, without tokenizing a word twice.

The tokenizer never joins what white space separates, so a text's ids are those of its chunks between
white space. Chunks are kept in a bounded table; a new one that is letters, perhaps with punctuation after
them, goes to the tokenizer's model directly, any other through the whole tokenizer.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np

#: Distinct chunks a worker remembers; then they become the older half, of which only what recurs is kept.
REMEMBER = 600_000
_ODD = re.compile("[\x1c-\x1f]")  # Python's white space, not the tokenizer's
_PLAIN = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level BPE: printable Latin-1 stays, the rest follow from 256 on."""
    stay = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in stay]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Chunks and their ids; what is missing is asked of `new` and kept."""

    def __init__(self, new):
        self.new = new

    def __missing__(self, chunk: str) -> bytes:
        got = self[chunk] = self.new(chunk)
        return got


class Encoder:
    """ids(text): the little-endian unsigned 32-bit ids of `tokenizer.encode(text, add_special_tokens=False)`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known = _Known(self._new)
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one lower-cased run of letters, or one of punctuation."""
        known = self.known
        got = known.get(piece) or self.older.get(piece)
        if got is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        known[piece] = got
        return got

    def _new(self, chunk: str) -> bytes:
        return self.older.get(chunk) or self._ids(chunk)

    def _ids(self, chunk: str) -> bytes:
        if chunk.isascii():
            if chunk.isalpha():
                return self._piece(chunk.lower())
            if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha():
                return self._piece(chunk[:-1].lower()) + self._piece(chunk[-1])
        m = _PLAIN.fullmatch(chunk)
        # letters that isalpha() doesn't know, texts that normalisation changes, and the one letter whose
        # lower case depends on its neighbours take the long way
        if m and m[1].isalpha() and "Σ" not in chunk and unicodedata.is_normalized("NFC", chunk):
            low = m[1].lower()
            if low.isalpha() and unicodedata.is_normalized("NFC", low):
                return self._piece(low) + (self._piece(m[2]) if m[2] else b"")
        return self._whole(chunk)

    def forget(self) -> None:
        self.known, self.older = _Known(self._new), {}

    def ids(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._whole(text)
        if len(self.known) > REMEMBER:
            self.older, self.known = self.known, _Known(self._new)
        return b"".join(map(self.known.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The one of this process. A function sent to workers must not hold the table of them itself: each task would get a copy."""
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
