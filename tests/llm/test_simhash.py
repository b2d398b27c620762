"""Operator 11 against all pairs and a fingerprint computed bit by bit."""

import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from stridelake.llm import queries, simhash
from stridelake.llm.minhash import labels, stars


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    """Least member of every value's component, over all pairs."""
    head = {v: v for v in values}

    def find(v):
        while head[v] != v:
            v = head[v]
        return v

    for a, b in itertools.combinations(sorted(values), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            head[y] = x
    return {v: find(v) for v in values}


TEXTS = [None, "", " \n\t", "one", "two words", "ÜBER İ ſ K Straße", "a\x1cb c\x85d e\xa0f g", "Same SHINGLES here same shingles here same shingles here", "x " * 200_000]


@pytest.mark.parametrize("text", TEXTS + [" ".join(random.Random(i).choices(["ab", "Cd", "é", "中文", "😀"], k=i)) for i in range(1, 40, 3)])
def test_fingerprint_bit_by_bit(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain(text)


def test_jvm_hash_is_the_same(spark):
    word = "one three-word shingle"
    assert spark.range(1).select(F.xxhash64(F.lit(word))).first()[0] % 2**64 == xxhash.xxh64_intdigest(word.encode(), 42)


@pytest.mark.parametrize(("blocks", "small"), [(3, 1), (5, 2), (5, 32), (4, 1000)])
def test_components_equal_all_pairs(spark, blocks, small):
    """Chains, clouds that share most keys, and strangers; with points for nearly all keys, and for none."""
    rng = random.Random(blocks * small)
    values = {rng.getrandbits(64) for _ in range(200)}
    for centre in [rng.getrandbits(64) for _ in range(3)] + [0]:
        for _ in range(150):
            v = centre
            for b in rng.sample(range(64), rng.randrange(5)):
                v ^= 1 << b
            values.add(v)
    v = rng.getrandbits(64)
    for _ in range(60):  # a long chain
        values.add(v)
        v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    pairs = simhash.links(spark.createDataFrame([(v,) for v in signed], "__fp long"), blocks, small)
    for a, b in pairs.collect():
        assert a < b and ((a ^ b) % 2**64).bit_count() <= 2
    got = {r["__id"] % 2**64: r["__class"] % 2**64 for r in labels(stars(pairs)).collect()}
    want, groups = components(values), {}
    for v in values:
        groups.setdefault(got.get(v, v), set()).add(want[v])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    prints = {r.doc_id: plain(r.text) for r in rows}
    classes = components(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[classes[p]] = min(i, least.get(classes[p], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op11_simhash(spark, folder).collect()}
    assert got == {i: (f"{p:016x}", least[classes[p]]) for i, p in prints.items()}


def test_awkward_rows(spark):
    rows = [(None, "lone text of no id"), (5, None), (4, ""), (None, " "), (7, "a b c d"), (7, "a b c d"), (9, "A B C D"), (2, "q")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, __fp string, __first int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_components(df).collect()), key=str)
    assert got == sorted([(None, None), (5, 4), (4, 4), (None, 4), (7, 7), (7, 7), (9, 7), (2, 2)], key=str)
    assert simhash.near_components(df.limit(0)).count() == 0
