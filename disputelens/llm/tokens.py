"""Encoding whole texts with a public tokenizer file, inside tasks.

``tokenizers`` spends most of its time on normalising and splitting, and words
repeat. For files whose normaliser and splitter are the ones named below, a
text may be cut at ASCII white space first: no rule of theirs reaches over it.
So each worker keeps the ids of the pieces it has met, in two tables of bounded
size (pieces between blanks; words within them). What the short way does not
cover (special tokens, letters outside Latin-1, any other tokenizer file) is
given to the library's own ``encode``. The ids are the same either way.
"""

from __future__ import annotations

import json
import re

import numpy as np

KEPT_PIECES = 200_000  # entries of each table; later pieces are encoded anew each time
KEPT_WORDS = 300_000
KEPT_CHARS = 64  # longer ones seldom repeat and are not kept

# The normaliser and splitter for which the short way holds.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_ENCODERS: dict = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable ones as they are, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def id_type(path: str) -> str:
    """The smallest unsigned little-endian type that holds every id of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    last = max([len(rules["model"]["vocab"]) - 1, *(t["id"] for t in rules["added_tokens"])])
    return "<u2" if last < 1 << 16 else "<u4"


class Encoder:
    """``encode(text)`` gives the ids of a whole text as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.dtype = id_type(path)
        self.pieces: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        pre = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        self.short = (
            rules.get("normalizer") == NORMALIZER
            and pre[0].get("pattern") == {"Regex": SPLIT}
            and pre[0].get("behavior") == "Removed"
            and pre[0].get("invert") is True
            and pre[1].get("type") == "ByteLevel"
            and not pre[1].get("add_prefix_space")
            and all("<" in t["content"] for t in rules["added_tokens"])
        )
        self.plain = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+").fullmatch  # no "<": it may open a special token
        # the splitter's rule for the characters of ``plain``
        self.split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZÀ-ÖØ-öø-ÿ]+|[0-9]|[^a-zA-Z0-9À-ÖØ-öø-ÿ]+").findall
        self.letters = {ord(bytes([b]).decode("latin-1")): c for b, c in byte_letters().items()}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def word(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], dtype=self.dtype).tobytes()
        if len(self.words) < KEPT_WORDS and len(word) <= KEPT_CHARS:
            self.words[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        if self.plain(piece):
            known = self.words
            ids = b"".join([known[w] if w in known else self.word(w) for w in self.split(piece.lower())])
        else:
            ids = self.whole(piece)
        if len(self.pieces) < KEPT_PIECES and len(piece) <= KEPT_CHARS:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.short:
            return self.whole(text)
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        for blank in "\n\t\r\x0b\x0c":
            if blank in text:
                text = text.replace(blank, " ")
        known = self.pieces
        try:
            return b"".join(map(known.__getitem__, text.split(" ")))
        except KeyError:
            return b"".join([known[p] if p in known else self.piece(p) for p in text.split(" ")])
