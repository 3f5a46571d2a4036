"""Encoding of whole texts through tables of pieces between white space.

The tokenizer of ``word_bpe_49k.json`` lower-cases, drops white space and encodes each
pre-token alone, so the ids of a text are the ids of its pieces between white space, one
after another.  A worker keeps the pieces it has met and asks the tokenizer's own model
for new pre-tokens only.  Texts with characters whose treatment needs the library's
normalizer (anything outside a list of plain characters) or with strings of special
tokens go through the library whole.  Any other tokenizer file is used through its library.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np

#: Pieces in a worker's table; when it is full it becomes the old table, and a new one begins.
CACHE_PIECES = 500_000

#: Characters of the longest piece that is kept, so that tables are bounded in bytes; longer ones are encoded each time.
LONGEST_PIECE = 64

_ENCODERS: dict[tuple, object] = {}

#: Fixed value: the split pattern for which pieces may be encoded one by one.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _plain_characters() -> list[str]:
    """Characters which no normal form changes and which lower-case one to one."""
    ranges = [(0x21, 0x7F), (0xA1, 0x180), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0)]
    found = []
    for low, high in ranges:
        for c in map(chr, range(low, high)):
            stable = unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1
            if stable and unicodedata.category(c)[0] in "LNPS":
                found.append(c)
    return found


def _bytes_to_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(others)}


class _Table(dict):
    """Pieces met before; a new one is made on first use, or taken over from the old table."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
            if len(piece) > LONGEST_PIECE:
                return value
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


class PieceEncoder:
    """Counts or ids of texts; exact for every text."""

    def __init__(self, path: str, width: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"  # of a little-endian machine, which Spark's hosts are
        self.by_piece = _splits_at_white_space(layout)
        self.special = [t["content"] for t in layout.get("added_tokens", [])]
        plain = _plain_characters()
        kinds = {k: "".join(map(re.escape, (c for c in plain if unicodedata.category(c)[0] == k))) for k in "LN"}
        self.odd = re.compile("[^ \t\n\r" + "".join(map(re.escape, plain)) + "]")
        self.pretokens = re.compile(
            f"[{kinds['L']}]+|[{kinds['N']}]|'(?:s|t|re|ve|m|ll|d)|[^{kinds['L']}{kinds['N']}]+"
        )
        self.letters = _bytes_to_letters()
        self.counts, self.ids = _Table(self._count), _Table(self._encode)

    def _words(self, piece: str) -> list[str]:
        """The pre-tokens of a piece in the byte-level alphabet."""
        words = [piece] if piece.isascii() and piece.isalpha() else self.pretokens.findall(piece)
        return [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]

    def _count(self, piece: str) -> int:
        return sum(len(self.tokenizer.model.tokenize(word)) for word in self._words(piece))

    def _encode(self, piece: str) -> bytes:
        words = self.pretokens.findall(piece) if not piece.isalpha() else ()
        if len(words) > 1:  # a word with a comma behind it is the word and the comma
            return b"".join(map(self.ids.__getitem__, words))
        ids = [t.id for word in self._words(piece) for t in self.tokenizer.model.tokenize(word)]
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def is_plain(self, text: str) -> bool:
        return self.by_piece and not self.odd.search(text) and not any(s in text for s in self.special)

    def count(self, text: str) -> int:
        if not self.is_plain(text):
            return len(self._whole(text))
        return sum(map(self.counts.__getitem__, text.lower().split()))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned integers of ``self.dtype``."""
        if not self.is_plain(text):
            return np.array(self._whole(text), dtype=self.dtype).tobytes()
        return b"".join(map(self.ids.__getitem__, text.lower().split()))


class LibraryEncoder:
    """A sentencepiece model, text by text."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dtype = np.dtype("<u2" if self.processor.get_piece_size() <= 65536 else "<u4")
        self.counts: dict[str, int] = {}

    def is_plain(self, text: str) -> bool:
        return False

    def count(self, text: str) -> int:
        return len(self.processor.encode(text, num_threads=1))

    def encode(self, text: str) -> bytes:
        return np.array(self.processor.encode(text, num_threads=1), dtype=self.dtype).tobytes()


def _splits_at_white_space(layout: dict) -> bool:
    steps = (layout.get("pre_tokenizer") or {}).get("pretokenizers") or []
    normal = (layout.get("normalizer") or {}).get("normalizers") or []
    return (
        [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"].get("Regex") == _SPLIT
        and steps[0]["invert"]
        and steps[0]["behavior"] == "Removed"
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and [s.get("type") for s in normal] == ["NFC", "Replace", "Lowercase"]
        and layout.get("post_processor") is None
    )


def encoder(path: str):
    """One encoder per worker process and file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path) if path.endswith(".model") else PieceEncoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return sys.intern(str(public_tokenizers.path(name)))
