"""Operator 12 against a search of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from stridelake.llm import queries, runs


def plain(ids):
    """Every stretch of equal words q apart that cannot be extended, with its smallest period."""
    n, found = len(ids), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def cases():
    rng = random.Random(5)
    for _ in range(400):  # few different words: many runs by chance
        yield rng.choices(range(rng.randint(1, 3)), k=rng.randrange(60))
    for _ in range(150):  # nested and adjoining repeats
        out = []
        for _ in range(rng.randrange(1, 6)):
            block = rng.choices(range(6), k=rng.randrange(1, 9))
            if rng.random() < 0.4:
                block = block * rng.randrange(1, 7)
            out += (block + rng.choices(range(9), k=rng.randrange(3))) * rng.randrange(1, 8)
        yield out
    for k in range(1, 12):
        yield [0] * k
        yield list(range(k)) * 4
        yield list(range(k)) * 4 + [0, 99] + list(range(k)) * 5
    word = [0]
    for _ in range(9):  # strings that ordinary polynomial hashes modulo 2**64 confuse, and Fibonacci words
        word = word + [1 - w for w in word]
    yield word * 4 + word
    a, b = [0], [0, 1]
    for _ in range(10):
        a, b = b, b + a
    yield b * 5


def test_runs_equal_a_search_of_every_period():
    for ids in cases():
        assert runs.find_runs(np.array(ids, np.int64)) == plain(ids), ids


@pytest.mark.parametrize("times", [1, 3])
def test_grammar_derives_the_text(times):
    """Every nonterminal stands for the same words wherever it stands, and the longest ones cover the text."""
    rng = random.Random(times)
    ids = rng.choices(range(4), k=300) * times
    rules = runs.re_pair([*ids, -1, *ids[:50]])
    whole = [*ids, -1, *ids[:50]]
    for places, a, b in rules:
        assert len({tuple(whole[p : p + a + b]) for p in places}) == 1 and -1 not in whole[places[0] : places[0] + a + b]
    assert (max(a + b for p, a, b in rules if 0 in p), max(a + b for p, a, b in rules if len(ids) + 1 in p)) == (len(ids), 50)


def test_long_texts():
    """A hundred thousand words each: one word, one long period, and a passage that recurs without a period."""
    rng = random.Random(1)
    passage = rng.choices(range(5000), k=20_000)
    assert runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert runs.find_runs(np.array(passage * 5)) == [(0, 100_000, 20_000)]
    apart = [w for i in range(5) for w in [*passage, 6000 + i]]
    assert runs.find_runs(np.array(apart)) == plain_short(apart)


def plain_short(ids):
    """``plain`` for periods up to 50."""
    x, found = np.array(ids), {}
    for q in range(1, 51):
        same = np.concatenate(([False], x[:-q] == x[q:], [False]))
        turns = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if e + q - s >= max(6, 4 * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    found = plain([number[w] for w in words])
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


FIELDS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_the_search(spark):
    folder = "/root/testdata/sf0.001"
    want = [expected(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [tuple(r[f] for f in FIELDS) for r in queries.op12_periodic_runs(spark, folder).collect()]
    assert sorted(got) == sorted(want) and any(r[1] for r in want)


def test_awkward_rows(spark, tmp_path):
    texts = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "A a " * 8, "é\x1cü é\x85ü " * 9, "x y z " * 30_000]
    rows = [(i, t) for i in [None, 1, *range(40, 60)] for t in texts]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, best string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r[f] for f in FIELDS) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    short = [r for r in rows if len(r[1] or "") < 1000]
    want = sorted(map(str, (expected(*r) for r in short)))
    assert len(got) == len(rows) and not set(want) - set(map(str, got))
    whole = runs.periodic_runs(df.filter("doc_id is null and length(text) > 1000")).first()
    assert [tuple(r) for r in whole.runs] == [(0, 90_000, 3)] and whole.collapsed == "x y z" and tuple(whole.best) == (0, 90_000, 3)
    assert runs.periodic_runs(df.limit(0)).count() == 0
