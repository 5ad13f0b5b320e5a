"""Characters and words of many texts at once, as arrays.

Words are runs of letters and digits in lower case; a word is known by a 64-bit hash of its characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

OTHER, LETTER, DIGIT, SPACE, PUNCT = 0, 1, 2, 3, 4


_classes: list[np.ndarray] = []  # made once per process


def classes() -> np.ndarray:
    """The class of every code point."""
    if _classes:
        return _classes[0]
    kinds = {"L": LETTER, "N": DIGIT, "Z": SPACE, "P": PUNCT}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[[9, 10, 11, 12, 13, 0x85]] = SPACE
    _classes.append(table)
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; wraps on purpose."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str | None], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together; a longer text is a range of its own, whole."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Chars:
    """Code points of texts one after the other, each text followed by a newline."""

    codes: np.ndarray
    kind: np.ndarray
    starts: np.ndarray  # of each text
    sizes: np.ndarray  # without the newline

    @staticmethod
    def of(texts: list[str | None]) -> Chars:
        lowered = [t.lower() if t else "" for t in texts]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        codes = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        return Chars(codes, classes()[codes], np.cumsum(sizes + 1) - sizes - 1, sizes)


@dataclass
class Words:
    """Words of texts: the text's number, the first character's place, the length and the hash of each."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    hash: np.ndarray

    @staticmethod
    def of(chars: Chars) -> Words:
        inside = ((chars.kind == LETTER) | (chars.kind == DIGIT)).view(np.int8)
        step = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        size = end - start
        if len(start) == 0:
            return Words(*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.int64))
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))  # characters of words only
        place = at - np.repeat(start, size)
        powers = np.cumprod(np.full(int(size.max()) + 1, 0x2545F4914F6CDD1D, np.uint64))
        sums = np.add.reduceat(mixed(chars.codes[at].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * powers[place], np.cumsum(size) - size)
        return Words(np.searchsorted(chars.starts, start, "right") - 1, start, size, mixed(sums + size.astype(np.uint64)).view(np.int64))
