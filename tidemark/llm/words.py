"""Words of a text as comparisons see them, and fingerprints of weighted shingles."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import xxhash

TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
LINKED = re.compile(r"\[\[[^\[\]|]*\|([^\[\]|]*)\]\]|\]\((?:[^()\s]*)\)")
ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
#: ASCII letters and digits in lower case; everything else ends a word, invisible controls do not.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_HIDDEN = bytes(b for b in [*range(0x20), 0x7F] if b not in b"\t\n\v\f\r\x1c\x1d\x1e\x1f")


class _Fold(dict):
    """What becomes of a character that is not ASCII: letters and digits stay, what stands in a word without being part of it goes, all else ends a word."""

    def __missing__(self, code: int) -> int | None:
        char = chr(code)
        hidden = unicodedata.category(char) in ("Mn", "Me", "Cf", "Cc") and char not in SPACES or code in FILLERS
        self[code] = None if hidden else code if char.isalnum() else 32
        return self[code]


#: Controls that are white space, and letters that show nothing.
SPACES, FILLERS = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85", (0x115F, 0x1160, 0x3164, 0xFFA0)
_fold = _Fold()


def words(text: str | None) -> list[bytes]:
    """Unbroken runs of letters or digits, without case, accents, markup, invisible characters and compatible forms."""
    if not text:
        return []
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text and ENTITY.search(text):
        text = html.unescape(text)
    if "](" in text or "|" in text:
        text = LINKED.sub(r" \1 ", text)
    if text.isascii():
        return text.encode().translate(_FOLD, _HIDDEN).split()
    text = unicodedata.normalize("NFKD", text).casefold()
    if not unicodedata.is_normalized("NFKD", text):
        text = unicodedata.normalize("NFKD", text)
    return text.translate(_fold).encode("utf-8", "replace").split()


class WordHashes(dict):
    """A number for each word; ``hashes`` has 64 bits of the word at its number, the same in every process. Forgotten when there are too many."""

    def __init__(self, same_numbers: bool = False) -> None:
        self.hashes = np.zeros(1 << 16, dtype=np.uint64)
        self.same_numbers = same_numbers  # all runs of digits are one word

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n >= len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros(len(self.hashes), np.uint64)))
        self.hashes[n] = xxhash.xxh64_intdigest(b"0" if self.same_numbers and word.isdigit() else word)
        return n

    def of(self, words: Iterable[bytes]) -> np.ndarray:
        if len(self) > 1_000_000:
            self.clear()
        return self.hashes[np.array(list(map(self.__getitem__, words)), dtype=np.int64)]


def mixed(values: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each integer (the finaliser of splitmix64)."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signs(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The SimHash addends of shingles: a row of 64 weights, negative where the shingle's bit is 0."""
    bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return (bits.astype(np.float32) * 2 - 1) * weights.astype(np.float32)[:, None]


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()
