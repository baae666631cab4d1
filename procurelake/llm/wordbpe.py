"""Ids of texts under a `tokenizers` file that lowers text and never merges across white space."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

#: Words and pieces of words that each of two generations of a worker's memory holds; longer ones are not remembered.
REMEMBERED, LONGEST = 350_000, 64
#: Below this, normal form C and lower case are the same wherever they are computed; İ (U+0130) aside.
PLAIN = "ɐ"
_ODD = re.compile("[\x1c-\x1f]")
_FAR = re.compile(f"[{PLAIN}-\U0010ffffİ]")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models write bytes as: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes each piece of a word once and joins the ids.

    Exact, as normalising, splitting and merging stay within words. Texts of plain characters are lowered
    and split here and only merged by the library; words of others go through all of it. A lowered word
    and itself have the same ids, so one memory serves both."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
        if self.plain:
            self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}

    def _all(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        ids = self.known_before.get(piece)
        if ids is None:
            plain = piece.isascii() and piece.isprintable()  # these bytes are written as themselves
            made = self.tokenizer.model.tokenize(piece if plain else piece.encode().decode("latin-1").translate(self.letters))
            ids = array("H", [t.id for t in made]).tobytes()
        if len(piece) <= LONGEST:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian 16-bit ids."""
        if _ODD.search(text) or any(x in text for x in self.added):  # the first separate words for Python only, the others are ids wherever they stand
            return self._all([text])[0]
        if len(self.known) > REMEMBERED:
            self.known, self.known_before = {}, self.known
        known = self.known.get
        if self.plain and not _FAR.search(text):
            words = text.lower().split()
            ids = list(map(known, words))
            if None in ids:
                ids = [(known(w) or self._lowered(w)) if x is None else x for w, x in zip(words, ids)]
            return b"".join(ids)
        words = text.split()
        hard = [w for w in dict.fromkeys(words) if len(w) > LONGEST or known(w) is None]
        once = dict(zip(hard, self._all(hard), strict=True))
        self.known.update((w, x) for w, x in once.items() if len(w) <= LONGEST)
        return b"".join([once[w] if w in once else known(w) for w in words])

    def _lowered(self, low: str) -> bytes:
        """Ids of a lowered word of plain characters."""
        if low.isalpha():
            return self._piece(low)
        if low[-1] in ".," and (word := low[:-1]).isalpha():  # a piece and a mark: not worth remembering together
            return (self.known.get(word) or self._piece(word)) + (self.known.get(low[-1]) or self._piece(low[-1]))
        ids = self.known_before.get(low)
        if ids is None:
            ids = b"".join([self.known.get(p) or self._piece(p) for p in self.split(low)])
        if len(low) <= LONGEST:
            self.known[low] = ids
        return ids
