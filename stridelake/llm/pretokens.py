"""Vectorised splitting of texts into the pieces that byte-level BPE merges within, and a store of encoded pieces.

The pieces are those of the usual pattern: contractions, letters, numbers or other signs with one space
before them, and white space. The boundaries depend only on neighbouring characters, so they are computed for a whole batch
at once; every distinct piece is encoded once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

from .wordhash import segment_hashes

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_QUOTE = 0x27


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    every = "".join(map(chr, range(0x110000)))
    table = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


def piece_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of texts that lie end to end."""
    n = len(points)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first = first[:n]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # white space before something: its last character stands alone, or joins what follows if it is a space
    after = np.flatnonzero((kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~first[1:]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    quotes = np.flatnonzero((points == _QUOTE) & start)
    if len(quotes):
        ahead = np.concatenate((points, np.zeros(2, points.dtype)))
        shut = np.concatenate((first, np.ones(3, bool)))
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        near, far = ~shut[quotes + 1], ~shut[quotes + 1] & ~shut[quotes + 2]
        short = near & np.isin(one, [ord(c) for c in "stmd"])
        long = far & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for which, size in ((short, 2), (long, 3)):
            at = quotes[which]
            start[at + 1] = False
            end = at + size
            start[end[end < n]] = True
    return np.flatnonzero(start)


def split_pieces(texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For all texts in order: which distinct piece each piece is, the distinct pieces, and how many pieces each text has (null: none).

    Pieces are grouped by a hash, and each is compared with the first of its group; should two differ, they are grouped letter by letter.
    """
    texts = ["" if t is None else t for t in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.int64), [], np.zeros(len(texts), np.int64)
    starts = piece_starts(points, ends - lengths)
    sizes = np.diff(starts, append=len(points))
    codes, distinct = pd.factorize(segment_hashes((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), sizes))
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    same = first[codes]
    cut = lambda which: [whole[a : a + n] for a, n in zip(starts[which].tolist(), sizes[which].tolist(), strict=True)]
    if (sizes == sizes[same]).all() and (points == points[np.arange(len(points)) + np.repeat(starts[same] - starts, sizes)]).all():
        names = cut(first)
    else:
        codes, names = pd.factorize(np.array(cut(np.arange(len(starts))), dtype=object))
        names = names.tolist()
    return codes, names, np.diff(np.searchsorted(starts, ends), prepend=0)


class PieceStore:
    """Ids of pieces: those given from the start (``seed``: pieces, all their ids, how many each has) and those met since, which are dropped when they are more than ``most``."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], seed: tuple[list[str], np.ndarray, np.ndarray] | None = None, most: int = 1_200_000):
        self.encode, self.seed, self.most = encode, seed, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.start = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int64)
        self.used = 0
        if self.seed:
            self.put(*self.seed)

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.empty(max(n, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out

    def put(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        k = len(self.known)
        self.flat = self._grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start, self.size = self._grown(self.start, k + len(pieces)), self._grown(self.size, k + len(pieces))
        self.start[k : k + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.size[k : k + len(pieces)] = sizes
        self.used += len(ids)
        self.known.update(zip(pieces, range(k, k + len(pieces)), strict=True))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many each text has (null: none)."""
        if len(self.known) > self.most + (len(self.seed[0]) if self.seed else 0):
            self.clear()
        codes, names, per_text = split_pieces(texts)
        if not len(codes):
            return np.empty(0, np.uint32), per_text
        found = np.fromiter(map(self.known.get, names, [-1] * len(names)), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            k, pieces = len(self.known), [names[i] for i in new.tolist()]
            coded = self.encode(pieces)
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            self.put(pieces, np.fromiter((x for ids in coded for x in ids), np.uint32, int(sizes.sum())), sizes)
            found[new] = np.arange(k, k + len(new))
        piece = found[codes]
        size = self.size[piece]
        before = np.cumsum(size) - size
        ids = self.flat[np.arange(int(size.sum())) + np.repeat(self.start[piece] - before, size)]
        upto = np.append(before, len(ids))[np.cumsum(per_text)]
        return ids, np.diff(upto, prepend=0)
