"""Secret scan: fixed patterns, plus spans that a character Markov model takes for random strings.

Character bigram models are trained from labelled samples: random strings (drawn by a seeded generator, one model per alphabet of
keys) and ordinary identifiers (words of a bounded, hash-chosen sample of the corpus that no pattern flags, and such words put together as
names, paths, slugs and dates are). A candidate run of key characters is judged by the model of the smallest alphabet that holds it. It is
reported if its log-likelihood ratio per character is above a threshold of its length, which is set on identifiers kept apart from training.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns and least lengths, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: The same matches, found without visiting the runs that are too short.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Runs of key characters from this length on are judged, if they hold a letter.
LEAST_RUN = 16
_LETTER = re.compile("[A-Za-z]")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_LOWER, _UPPER, _DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
#: Alphabets of keys, small ones first. A run belongs to the first that holds it.
ALPHABETS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _LOWER + _DIGITS, _UPPER + _DIGITS, _LOWER + _UPPER, ALPHABET[:62], ALPHABET)
_PLACE = {c: i for i, c in enumerate(ALPHABET)}
_SETS = tuple(map(frozenset, ALPHABETS))
SAMPLE_DOCS = 500
RANDOM_STRINGS = 1_000
#: Identifiers made of sampled words, for training and again for the thresholds.
MADE_IDENTIFIERS = 10_000
#: Least threshold, and the share of ordinary identifiers of a length that may be above it.
THRESHOLD, FALSE_SHARE = 0.25, 0.002
#: Lengths from which on a threshold of their own holds.
LENGTHS = (1, 14, 16, 18, 20, 24, 28, 32, 40)
#: Common words of identifiers (fixed values), beside those of the corpus.
NAME_WORDS = """abstract access account action active add admin after all api app array async auth average balance base batch before begin bean binary block body
buffer build button bytes cache call change channel char check child class clear client clone close cluster code collection column command compare complete component
config connect connection container content context control convert copy count create current customer data date debug default delete detail dictionary directory document
download element enable encode end entry error event exception execute export factory field file filter find first flag folder format frame function
get global graph group handle handler hash header height history html image import index info init input insert instance integer interface item
iterator job key label language last layout length level library limit line link list listener load local lock log machine main manager map
master match max memory menu message method model module name network node number object option order output package page parameter parent parse
password path pattern process product profile property provider proxy query queue random read record reference register remove replace report request
""".split()


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what the fixed patterns find, by start and kind."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), "hex", m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def _counts(strings: list[str]) -> np.ndarray:
    """How often each pair of characters stands together in the strings."""
    size = len(ALPHABET)
    place = np.full(129, -1)
    place[[ord(c) for c in ALPHABET]] = range(size)
    codes = place[np.minimum(np.frombuffer("\n".join(strings).encode("utf-32-le"), np.uint32), 128)]
    held = (codes[:-1] >= 0) & (codes[1:] >= 0)
    return np.bincount(codes[:-1][held] * size + codes[1:][held], minlength=size * size).reshape(size, size).astype(float)


def _log_model(table: np.ndarray, backing: float = 10.0) -> np.ndarray:
    """Log probability of each next character; pairs that were rarely seen lean on how common the character is."""
    common = table.sum(0) + 0.5
    common /= common.sum()
    return np.log((table + backing * common) / (table.sum(1, keepdims=True) + backing))


def alphabet_of(run: str) -> int:
    """The smallest alphabet that holds the run."""
    held = frozenset(run)
    return next((k for k, letters in enumerate(_SETS) if held <= letters), len(_SETS) - 1)


def log_ratio(random_strings: list[str], identifiers: list[str]) -> np.ndarray:
    """Log-likelihood ratio of each character pair, for each alphabet of random strings."""
    ordinary = _log_model(_counts(identifiers))
    by_alphabet: list[list[str]] = [[] for _ in ALPHABETS]
    for s in random_strings:
        by_alphabet[alphabet_of(s)].append(s)
    return np.stack([_log_model(_counts(strings)) - ordinary for strings in by_alphabet])


def random_sample(n: int = RANDOM_STRINGS, seed: int = 7) -> list[str]:
    """Labelled examples of random strings: ``n`` over each alphabet of keys."""
    rng = random.Random(seed)
    return ["".join(rng.choices(keys, k=rng.randint(20, 48))) for keys in ALPHABETS for _ in range(n)]


def made_identifiers(words: list[str], n: int = MADE_IDENTIFIERS, seed: int = 11) -> list[str]:
    """Labelled examples of ordinary identifiers: words put together as in names, constants, slugs, paths and dated titles."""
    rng = random.Random(seed)
    words = sorted({w.lower() for w in words if re.fullmatch("[A-Za-z]{2,14}", w)})
    if not words:
        return []

    def one(form: int) -> str:
        w = rng.choices(words, k=rng.randint(2, 7))
        number = str(rng.randrange(10 ** rng.randint(1, 4))) if rng.random() < 0.2 else ""
        date = f"{rng.randint(1980, 2035)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        return [
            lambda: w[0] + "".join(map(str.capitalize, w[1:])) + number,
            lambda: "".join(map(str.capitalize, w)) + number,
            lambda: "_".join(w) + number,
            lambda: "_".join(w).upper() + number,
            lambda: "-".join(w) + (f"-{number}" if number else ""),
            lambda: "-".join(map(str.capitalize, w)),
            lambda: "/".join(w) + number,
            lambda: "/" + "/".join(rng.choice((x, x.capitalize(), x + str(rng.randrange(100)))) for x in w),
            lambda: f"{date}-{'-'.join(w)}",
            lambda: f"{date.replace('-', '/')}/{'-'.join(w)}",
            lambda: "".join(w[:4]),
            lambda: "".join(w[:4]).upper(),
        ][form]()

    return [one(k % 12) for k in range(n)]


def mean_score(run: str, table: np.ndarray) -> float:
    """Log-likelihood ratio per character pair of one run of two characters or more."""
    places = [_PLACE[c] for c in run]
    return float(table[alphabet_of(run), places[:-1], places[1:]].mean())


def thresholds(table: np.ndarray, identifiers: list[str], least: float = THRESHOLD, false_share: float = FALSE_SHARE) -> list[float]:
    """For each of LENGTHS, the score that at most ``false_share`` of the identifiers are above, when cut to that length; never under ``least``."""
    out = []
    for n in LENGTHS:
        scores = [mean_score(x[:n], table) for x in identifiers if len(x) >= n > 1]
        out.append(max(least, float(np.quantile(scores, 1 - false_share))) if scores else least)
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, list[float]]:
    """The pair scores and the thresholds by length. Ordinary identifiers come from the words of the ``sample_docs`` documents with the smallest hash.

    Only rows below a hash bound, about four times the sample, are sorted, so that no task meets rows of every partition.
    The sample's texts, at most ``sample_docs``, are read one partition at a time by the driver.
    """
    texts = docs.filter("text is not null").select("text", F.xxhash64("doc_id", "text").alias("__order"))
    share = min(1.0, 4 * sample_docs / max(1, texts.count()))
    bound = min(int(share * 2.0**64) - 2**63, 2**63 - 1)
    sample = texts.filter(F.col("__order") <= bound).orderBy("__order").limit(sample_docs).select("text")
    words: set[str] = set()
    for (text,) in sample.toLocalIterator():
        flagged = [(a, b) for a, _, b in base_spans(text)]
        found = (m for m in re.finditer(r"[A-Za-z0-9+/_=-]{3,}", text) if not any(a < m.end() and m.start() < b for a, b in flagged))
        words.update(m[0] for m in found if len(m[0]) < SHORTEST_LABELLED)
    return fit(sorted(words))


#: Words of this length or longer may be keys, so they are no examples of ordinary ones.
SHORTEST_LABELLED = 14


def fit(words: list[str]) -> tuple[np.ndarray, list[float]]:
    """The pair scores from every other word, the thresholds from the rest; common words of identifiers are dealt likewise."""
    learnt, kept = [*words[::2], *NAME_WORDS[::2]], [*words[1::2], *NAME_WORDS[1::2]]
    table = log_ratio(random_sample(), learnt + made_identifiers(learnt) + made_identifiers(NAME_WORDS[::2], seed=13))
    return table, thresholds(table, made_identifiers(kept, seed=17) + made_identifiers(NAME_WORDS[1::2], MADE_IDENTIFIERS // 4, seed=19))


class Scorer:
    def __init__(self, table: np.ndarray, threshold: float | list[float] = THRESHOLD, least_run: int = LEAST_RUN):
        self.table = table
        self.limits = threshold if isinstance(threshold, list) else [threshold] * len(LENGTHS)
        self.candidate = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{max(2, least_run)},}}")

    def random_like(self, run: str) -> bool:
        return bool(_LETTER.search(run)) and mean_score(run, self.table) > self.limits[bisect_right(LENGTHS, len(run)) - 1]


def spans_of(text: str, scorer: Scorer) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The base spans, and all spans with those of the model that no base span covers."""
    base = base_spans(text)
    more, at, reach = [], 0, -1  # reach: the furthest end of the base spans that start no later
    for m in scorer.candidate.finditer(text):
        while at < len(base) and base[at][0] <= m.start():
            reach = max(reach, base[at][2])
            at += 1
        if reach < m.end() and scorer.random_like(m[0]):
            more.append((m.start(), "markov", m.end()))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))


def _line(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan_secrets(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float | None = None, least_run: int = LEAST_RUN) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind. The model judges runs of ``least_run`` key characters or more
    that hold a letter, by ``threshold`` or else by thresholds of their lengths. Null and empty texts have none. Rows are independent: null and repeated ids and other columns do no harm; an empty table gives no rows; very long texts are read whole. If the corpus has no words to train on, the fixed words of identifiers are all the model learns from.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(train(docs, sample_docs))
    kinds = [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_markov", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, limits = fitted.value
        scorer = Scorer(table, limits if threshold is None else threshold, least_run)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = spans_of(text or "", scorer)
                n = [sum(k == kind for _, k, _ in every) for kind in KINDS]
                rows.append((*n, hashlib.sha256(_line(base).encode()).hexdigest(), _line(every)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, (_, k) in zip(columns, kinds[1:], strict=True)]], schema=pa.schema(kinds))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")

