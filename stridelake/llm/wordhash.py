"""Vectorised word splitting and hashing of batches of texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20_240_801)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def multipliers(n: int) -> np.ndarray:
    """A random odd factor for each place of a run. (Powers of one base would let some pairs of different runs collide.)"""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


_FACTORS = multipliers(4096)


def segment_hashes(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each run of ``values`` (runs are adjacent, of ``lengths`` >= 1)."""
    if not len(lengths):
        return np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    longest = int(lengths.max())
    table = _FACTORS if longest <= len(_FACTORS) else multipliers(longest)
    place = np.arange(len(values)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(values * table[place], first) + lengths.astype(np.uint64) * GOLDEN)


def byte_class(separators: list[tuple[int, int]]) -> np.ndarray:
    """Table of 256 flags: the bytes outside the given inclusive ranges belong to words."""
    inside = np.ones(256, bool)
    for low, high in separators:
        inside[low : high + 1] = False
    return inside


#: Words are runs of anything but space and tab to carriage return.
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(texts: list[str | None], inside: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, and the number of words of each text (null: none)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    in_word = inside[buf]
    edges = np.flatnonzero(in_word[1:] != in_word[:-1]) + 1
    if in_word[0]:
        edges = np.concatenate(([0], edges))
    starts, stops = edges[0::2], edges[1::2]
    chars = buf[in_word]
    hashes = segment_hashes(_BYTE[chars if fold is None else fold[chars]], stops - starts)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    upto = np.searchsorted(starts, ends)
    return hashes, np.diff(upto, prepend=0)


def portions(lengths: list[int], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring texts whose lengths add up to about ``most``; a longer text stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
