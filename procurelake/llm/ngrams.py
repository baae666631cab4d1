"""Character n-grams of Arrow text columns as hashed bins.

A text is seen as its letters, lowered; whatever lies between letters is one boundary
character, whichever it is and however many there are.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

_SPACE = 32


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: itself lowered if it is a letter, else a space; and whether it is a letter."""
    to, is_letter = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] == "L":
            is_letter[c] = True
            low = ch.lower()
            to[c] = ord(low) if len(low) == 1 else c
    return to, is_letter


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters and boundaries of all texts, the text of each, letters a text). Each text begins and ends with a boundary."""
    to, is_letter = letters()
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    n = np.concatenate([[0], np.cumsum(is_letter[codes])])
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first) + 2)
    out = np.full(len(codes) + 2 * (len(offsets) - 1), _SPACE, np.uint32)
    inner = np.ones(len(out), bool)
    start = first[:-1] + 2 * np.arange(len(offsets) - 1)
    inner[start] = False
    inner[first[1:] + 2 * np.arange(len(offsets) - 1) + 1] = False
    out[inner] = to[codes]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _SPACE) | (out[:-1] != _SPACE) | (doc[1:] != doc[:-1])
    return out[keep], doc[keep], n[first[1:]] - n[first[:-1]]


def bins(chars: np.ndarray, doc: np.ndarray, sizes: tuple[int, ...], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size (bin of each n-gram, its text). An n-gram never spans two texts."""
    h = np.zeros(len(chars), np.uint32)
    out = []
    for n in range(1, max(sizes) + 1):
        if n > len(chars):
            break
        h = h[: len(chars) - n + 1] * np.uint32(0x01000193 * 2 + 1) + chars[n - 1 :] * np.uint32(0x9E3779B1)
        if n in sizes:
            same = doc[: len(h)] == doc[n - 1 :]
            m = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
            m = ((m ^ (m >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
            out.append((m[same], doc[: len(h)][same]))
    return out
