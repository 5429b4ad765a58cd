"""Texts as arrays: letters, words and their hashes for a group of texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters that are worked on at once; a longer text is cut at white space (or here, if it has none).
AT_ONCE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = AT_ONCE + 2
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))


def groups(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(texts' indices, codes, text of each code) for groups of up to AT_ONCE lower-cased characters.

    Codes are code points; a line feed follows each text. A text can go on in the next groups.
    """
    index: list[int] = []
    held: list[str] = []
    size = 0

    def flush() -> tuple[list[int], np.ndarray, np.ndarray]:
        codes = np.frombuffer("\n".join([*held, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        return list(index), codes, np.repeat(np.arange(len(held)), [len(t) + 1 for t in held])

    for i, text in enumerate(texts):
        text = (text or "").lower()
        while text:
            cut = len(text)
            if cut > AT_ONCE // 2:
                cut = max(text.rfind(" ", 0, AT_ONCE // 2), text.rfind("\n", 0, AT_ONCE // 2)) + 1 or AT_ONCE // 2
            if size + cut + 1 > AT_ONCE:
                yield flush()
                index.clear(), held.clear()
                size = 0
            index.append(i)
            held.append(text[:cut])
            size += cut + 1
            text = text[cut:]
    if held:
        yield flush()


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and running hash sums of the runs of letters."""
    letter = is_letter()[codes]
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * _powers()[0][: len(codes)], dtype=np.uint64)])
    return edge[::2], edge[1::2], total


def hashed(total: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """A hash of codes[start:end] for each pair; equal runs have equal hashes wherever they stand."""
    h = (total[end] - total[start]) * _powers()[1][start] + np.uint64(salt)
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))
