"""Operator 12: periodic runs of words, found on a Re-Pair grammar.

A run lies across the boundary of the two parts of some nonterminal of the grammar of its text. So the runs across each boundary are
computed once, where the nonterminal first stands, carried to all places that it derives, and overlapping ones of equal period merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and at least so many times its period. The filter of ``stretches`` rests on these two numbers.
LEAST, TIMES = 6, 4
#: Candidate periods that are tested at a time.
_AT_ONCE = 1 << 21


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can be: every three neighbours in a run occur three times in the text, and a run holds four such triples or more."""
    n = len(ids)
    if n < LEAST:
        return []
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    _, triples, count = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    often = np.concatenate(([False], count[triples] >= TIMES - 1, [False]))
    turns = np.flatnonzero(often[1:] != often[:-1])
    return [(a, b + 2) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()) if b - a >= LEAST - 2]


def re_pair(symbols: list[int]) -> list[tuple[list[int], int, int]]:
    """Every nonterminal of a Re-Pair grammar: the places that derive it, and the lengths of its two parts. Negative symbols are
    different from all others and stay alone. What no rule covers is halved again and again, so that all else is under some nonterminal, too."""
    size, n = [1] * len(symbols), len(symbols)
    sym, after, back = symbols[:], list(range(1, n + 1)), list(range(-1, n - 1))
    at = defaultdict(list)
    for i in range(n - 1):
        if sym[i] >= 0 and sym[i + 1] >= 0:
            at[sym[i], sym[i + 1]].append(i)
    queue = [(-len(places), places[0], pair) for pair, places in at.items() if len(places) > 1]
    heapify(queue)
    fresh, rules = max(symbols, default=0) + 1, []
    while queue:
        claimed, order, (a, b) = heappop(queue)
        valid, end = [], -1
        for i in at.pop((a, b), ()):
            if i >= end and sym[i] == a and after[i] < n and sym[after[i]] == b:
                valid.append(i)
                end = after[i] + 1
        if len(valid) < 2:
            continue
        if len(valid) < -claimed:  # other rules took some since
            at[a, b] = valid
            heappush(queue, (-len(valid), order, (a, b)))
            continue
        rules.append((valid, size[valid[0]], size[after[valid[0]]]))
        both = rules[-1][1] + rules[-1][2]
        for i in valid:
            j = after[i]
            k = after[j]
            sym[i], sym[j], size[i], after[i] = fresh, -2, both, k
            if k < n:
                back[k] = i
        new = defaultdict(list)
        for i in valid:
            h, k = back[i], after[i]
            if h >= 0 and sym[h] >= 0 and sym[h] != fresh:
                new[sym[h], fresh].append(h)
            if k < n and sym[k] >= 0:
                new[fresh, sym[k]].append(i)
        for pair, places in new.items():
            if len(places) > 1:
                at[pair] = places
                heappush(queue, (-len(places), places[0], pair))
        fresh += 1
    rest, i = [[]], 0
    while i < n:
        if sym[i] < 0:
            rest.append([])
        else:
            rest[-1].append((i, size[i]))
        i = after[i]
    for level in rest:
        while len(level) > 1:
            rules += [([p], a, b) for (p, a), (_, b) in zip(level[::2], level[1::2])]
            level = [(p, a + b) for (p, a), (_, b) in zip(level[::2], level[1::2])] + level[len(level) // 2 * 2 :]
    return rules


def _squares(x: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For nodes (start, boundary, end): the number of a node, and the periods q for which the 2q symbols before its boundary, or those after it,
    probably repeat with q. A run of four periods across the boundary has two on one side. No such period is left out."""
    rng = np.random.default_rng(len(x))
    base = rng.integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(x), base, np.uint64))), dtype=np.uint64)
    value = rng.integers(1 << 63, size=int(x.max()) + 2, dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[x] * power[:-1], dtype=np.uint64)))
    lo, mid, hi = nodes.T
    most = (hi - lo) // TIMES
    begun = 0
    bounds = np.cumsum(most)
    while begun < len(nodes):
        upto = max(begun + 1, int(np.searchsorted(bounds, (bounds[begun - 1] if begun else 0) + _AT_ONCE, "right")))
        m = most[begun:upto]
        node = np.repeat(np.arange(begun, upto), m)
        q = np.arange(1, len(node) + 1) - np.repeat(np.cumsum(m) - m, m)
        found = np.zeros(len(q), bool)
        left = np.flatnonzero(2 * q <= (mid - lo)[node])
        c, r = mid[node[left]], q[left]
        found[left] = (total[c - r] - total[c - 2 * r]) * power[r] == total[c] - total[c - r]
        right = np.flatnonzero(2 * q <= (hi - mid)[node])
        c, r = mid[node[right]], q[right]
        found[right] |= (total[c + r] - total[c]) * power[r] == total[c + 2 * r] - total[c + r]
        node, q = node[found], q[found]
        cuts = np.flatnonzero(np.diff(node)) + 1
        for part in np.split(np.arange(len(node)), cuts):
            if len(part):
                yield int(node[part[0]]), q[part]
        begun = upto


def _across(x: np.ndarray, lo: int, mid: int, hi: int, periods: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs in ``x[lo:hi]`` that reach over two periods on one side of ``mid``; of several periods of a run the smallest."""
    out = []
    while len(periods):
        q, periods = int(periods[0]), periods[1:]
        differ = np.flatnonzero(x[lo : hi - q] != x[lo + q : hi]) + lo
        for a in (mid - 2 * q, mid):
            if a < lo or a + 2 * q > hi:
                continue
            k = int(np.searchsorted(differ, a))
            if k < len(differ) and differ[k] < a + q:  # only equal in hash
                continue
            s = int(differ[k - 1]) + 1 if k else lo
            e = int(differ[k]) + q if k < len(differ) else hi
            if e - s >= TIMES * q:
                out.append((s, e, q))
                inside = (periods % q == 0) & ((mid - 2 * periods >= s) & (mid <= e) | (mid >= s) & (mid + 2 * periods <= e))
                periods = periods[~inside]
    return [(s, e, q) for s, e, q in out if e - s >= LEAST]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start, then period."""
    places = stretches(ids)
    if not places:
        return []
    parts = [np.concatenate((np.arange(a, b), [-1])) for a, b in places]
    at = np.concatenate(parts)
    _, x = np.unique(np.where(at < 0, -1, ids[at]), return_inverse=True)
    x = np.where(at < 0, -1, x)
    rules = [r for r in re_pair(x.tolist()) if r[1] + r[2] >= LEAST]
    if not rules:
        return []
    nodes = np.array([(p[0], p[0] + a, p[0] + a + b) for p, a, b in rules])
    met = set()
    for k, periods in _squares(x, nodes):
        lo, mid, hi = nodes[k].tolist()
        for s, e, q in _across(x, lo, mid, hi, periods):
            for p in rules[k][0]:
                begin = int(at[p + s - lo])
                met.add((q, begin, begin + e - s))
    out = {}
    merged: list[tuple[int, int, int]] = []
    for q, s, e in sorted(met):
        if merged and merged[-1][0] == q and s <= merged[-1][2] - q:
            merged[-1] = (q, merged[-1][1], max(e, merged[-1][2]))
        else:
            merged.append((q, s, e))
    for q, s, e in merged:  # by period: the smallest stays
        out.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def text_runs(text: bytes | None) -> tuple[list[tuple[int, int, int]], bytes]:
    """Runs of a text's words, and the words that are left when each run keeps its first period, joined by one space."""
    words = text.split() if text else []  # of bytes: white space of ASCII
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    runs = find_runs(ids)
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            gone[s + q] += 1
            gone[s + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return runs, b" ".join(words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row: ``doc_id``, ``runs`` (all, by start, then period), ``best`` (greatest exact length/period, then smallest start, then period; null
    without runs) and ``collapsed``, the text whose runs keep their first period only, words joined by one space.

    A run is a stretch of at least 6 words and 4 times its smallest period that cannot be extended; words are runs of other
    characters than ASCII white space and start at 0. Null, empty and blank texts have no runs and an empty ``collapsed``. Very long texts are read whole,
    each row is looked at alone, so repeated or null ids do not matter; other columns are not looked at, and an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_runs(t.as_py()) for t in batch.column(1)]
            as_dicts = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs, _ in found]
            best = [max(runs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None) for runs in as_dicts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_dicts, pa.list_(RUN)), pa.array(best, RUN), pa.array([c for _, c in found], pa.binary())], ["doc_id", "runs", "best", "collapsed"])

    run = "struct<start:long,length:long,period:long>"
    out = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, runs array<{run}>, best {run}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
