"""Recall and false positives of the secret model by length and alphabet, on strings and identifiers it has not seen."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from stridelake.llm import secret_scan


@pytest.fixture(scope="module")
def fitted():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()[:500]
    words = {w for t in texts if t for w in re.findall(r"[A-Za-z0-9+/_=-]{3,}", t) if len(w) < secret_scan.SHORTEST_LABELLED}
    return secret_scan.fit(sorted(words))


@pytest.mark.parametrize("alphabet", secret_scan.ALPHABETS)
def test_recall_by_length(fitted, alphabet):
    scorer, rng = secret_scan.Scorer(*fitted), random.Random(5)
    for n in (16, 19, 20, 24, 32, 40):
        keys = ["".join(rng.choices(alphabet, k=n)) for _ in range(200)]
        found = [any(k != "assign" for _, k, _ in secret_scan.spans_of(f"the key ({key}) stands here", scorer)[1]) for key in keys]
        assert np.mean(found) >= 0.95, n


def test_ordinary_identifiers(fitted):
    scorer = secret_scan.Scorer(*fitted)
    names = """getCustomerAccountBalanceHistory AbstractSingletonProxyFactoryBean path/to/some/directory/file1 internationalization MAX_CONNECTIONS_PER_HOST
    com/example/service/impl 2024-01-31-my-first-post Donaudampfschifffahrtsgesellschaft responsibilities_of_the_user usr/local/lib/python3
    requestAnimationFrame WeakReferenceQueueThread Content-Security-Policy application/octet-stream 1234567890123456 2024-01-31/2025-02-28 ================"""
    assert not secret_scan.spans_of(names, scorer)[1]
    rng = random.Random(8)
    others = secret_scan.made_identifiers(["".join(rng.choice(["ba", "ter", "mon", "li", "sec", "ra", "tion", "ver", "den", "so", "in", "est"]) for _ in range(rng.randint(2, 4))) for _ in range(400)], 3000, seed=23)
    assert np.mean([bool(secret_scan.spans_of(x, scorer)[1]) for x in others]) < 0.02


def test_least_run_is_a_parameter(fitted, spark):
    key = "q7Xz9Lw2Vb8R"
    assert not secret_scan.spans_of(key, secret_scan.Scorer(*fitted))[1]
    assert secret_scan.spans_of(key, secret_scan.Scorer(*fitted, least_run=12))[1] == [(0, "markov", 12)]
    table = spark.createDataFrame([(1, f"see {key} or {key * 2}"), (2, None), (None, ""), (2, "x" * 1_000_000)], "doc_id long, text string")
    for least, want in ((12, 2), (16, 1)):
        got = secret_scan.scan_secrets(table, least_run=least).collect()
        assert len(got) == 4 and [r.n_markov for r in got if r.doc_id == 1] == [want]


def test_nothing_to_learn_from():
    table, limits = secret_scan.fit([])
    scorer = secret_scan.Scorer(table, limits)
    assert scorer.random_like("q7Xz9Lw2Vb8Rt4Kp6Ny1") and not scorer.random_like("getCustomerAccountBalanceHistory")
