"""Each operator against the libraries, brute force or a round trip, and on awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stridelake.llm import byte_bpe, decontaminate, html_text, licences, line_dedup, minhash, quality_rules, queries, secret_scan, sharding, token_files
from stridelake.llm.pretokens import piece_starts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, __other string"
LONG = "\n".join(hashlib.md5(str(i).encode()).hexdigest() + " ends a line of a very long text" for i in range(3000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "w", "o") for i, t, s in rows], SCHEMA)


AWKWARD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "b"), (5, "same text of a line that is long enough", "a"), (6, "same text of a line that is long enough", "a"),
    (7, "Ünïcödé 中文 😀 it's 'really' <|endoftext|>", "b"), (8, "same text of a line that is long enough", None), (8, "same text of a line that is long enough", None), (9, "a\x00b\x1c c\x85d", "b"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, AWKWARD)


REPORTS = {
    "lines": line_dedup.line_report,
    "quality": quality_rules.quality_report,
    "bpe": lambda d: byte_bpe.encode_documents(d, queries.RANKS),
    "files": lambda d: token_files.read_tokens(token_files.write_tokens(d, queries.LIBRARY_VOCABULARY)),
    "secrets": secret_scan.scan_secrets,
    "near": minhash.near_report,
    "licences": licences.scan_licences,
    "shards": sharding.shard,
    "hits": lambda d: decontaminate.contamination_report(d, d.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id > 4")),
}


@pytest.mark.parametrize("name", REPORTS)
def test_awkward_rows_and_empty_tables(spark, awkward, name):
    got = Counter(r.doc_id for r in REPORTS[name](awkward).collect())
    assert set(got) == {r[0] for r in AWKWARD} and all(n == 1 for i, n in got.items() if i != 8)
    assert REPORTS[name](awkward.limit(0)).count() == 0
    lost = docs(spark, [(None, "text of a row without a number", "a"), (1, "x", "a")])
    assert Counter(r.doc_id for r in REPORTS[name](lost).collect()) == {None: 1, 1: 1}


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_the_columns_and_take_awkward_rows(spark, awkward, tmp_path, k):
    spark.createDataFrame([(1, "a benchmark text that nobody ever repeats in any document of this little test")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.STAGES[k][1](spark, awkward, str(tmp_path))
    assert out.count() <= len(AWKWARD)
    if k < 4:
        assert out.columns == awkward.columns
    assert corpus_pipeline.STAGES[k][1](spark, awkward.limit(0), str(tmp_path)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize(("threshold", "small"), [(1, 32), (1, 4), (2, 32)])
def test_lines_equal_brute_force(spark, threshold, small):
    rng = random.Random(threshold)
    base = ["".join(rng.choices("abcé ", k=rng.randint(20, 30))) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(3):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
            lines.append("".join(line))
        rows.append((i, "\n".join(lines), "a"))
    seen, want = [], {}
    for i, text, _ in rows:
        kept, near, exact = [], 0, 0
        for line in text.split("\n"):
            if len(line) < 20:
                kept.append(line)
                continue
            if line in seen:
                exact += 1
            elif any(distance(line, s) <= threshold for s in set(seen)):
                near += 1
            else:
                kept.append(line)
            seen.append(line)
        want[i] = ("\n".join(kept), near, exact)
    got = {r.doc_id: (r.text, r.n_near, r.n_exact) for r in line_dedup.line_report(docs(spark, rows), threshold=threshold, small=small).collect()}
    assert got == want


def test_boilerplate_lines_and_depleted_documents(spark):
    boiler = "subscribe to our letter and follow us on every channel there is today"
    rows = [(i, f"{boiler}\n" + " ".join(f"{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60)), "h") for i in range(15)]
    rows += [(99, f"{boiler}\n" * 3 + " ".join(f"u{j}" for j in range(30)), "h"), (100, f"{boiler}\n" + " ".join(f"v{j}" for j in range(60)), "other")]
    got = {r.doc_id: r for r in quality_rules.quality_report(docs(spark, rows)).collect()}
    assert got[0].kept and got[0].n_removed_words == 13 and not got[99].kept and got[100].n_removed_words == 0
    stage = {r.doc_id: r.text for r in quality_rules.quality_stage(docs(spark, rows)).collect()}
    assert 99 not in stage and boiler not in stage[3] and boiler in stage[100]


def test_repeated_windows(spark):
    text = "a b c a b c d a b c x a b"
    r = quality_rules.quality_report(docs(spark, [(1, text, "a")])).first()
    words = text.split()
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    assert (r.n_words, r.word_chars, r.n_repeat_words) == (13, 13, len(hit))


NASTY = "".join(map(chr, [*range(0x20, 0x7F), 9, 10, 13, 0x85, 0xA0, 0xE9, 0x2167, 0x200B, 0x4E2D, 0x1F600, 0x1C])) + "  ''''stmdrevl   "


def nasty(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(NASTY, k=rng.randint(0, 60))) for _ in range(n)]


def test_piece_boundaries_equal_the_pattern():
    import regex

    texts = nasty(4000, 1)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    found = set(piece_starts(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), begin).tolist())
    want = {b + m.start() for t, b in zip(texts, begin.tolist(), strict=True) for m in regex.finditer(public_tokenizers.PATTERN, t)}
    assert found == want


def test_bpe_equals_the_library_and_decodes(spark):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.RANKS), special_tokens={})
    texts = [*nasty(300, 2), "aaaaaaaaaaaaaaaaaaa" * 9, "".join(random.Random(4).choices("abcdefgh", k=2000)), LONG]
    coded = byte_bpe.encode_documents(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), queries.RANKS, with_ids=True)
    for r in coded.collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.text for r in byte_bpe.decode_ids(coded, queries.RANKS).collect()} == dict(enumerate(texts))


def _thue_morse(n=10):
    one = "a"
    for _ in range(n):
        one += one.translate({97: 98, 98: 97})
    return one, one.translate({97: 98, 98: 97})


#: Two words of 1,024 letters that a polynomial hash takes for equal.
THUE_MORSE = _thue_morse()


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.LIBRARY_VOCABULARY)
    texts = [*nasty(200, 3), *THUE_MORSE]
    rows = [(i * 37 % 401, t, "a") for i, t in enumerate(texts)]
    manifest = token_files.write_tokens(docs(spark, rows), queries.LIBRARY_VOCABULARY)
    got = {r.doc_id: r for r in token_files.read_tokens(manifest).collect()}
    at = 0
    for i, text in sorted((i, t) for i, t, _ in rows):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    stem = manifest.first().path
    assert token_files.open_mapped(f"{stem}.bin", "<u2").dtype == np.uint16 and token_files.open_mapped(f"{stem}.idx", "<u8")[0] == 0


def test_words_that_look_alike_to_a_polynomial():
    from stridelake.llm.pretokens import split_pieces
    from stridelake.llm.wordhash import SPACED, word_hashes

    codes, names, _ = split_pieces([*THUE_MORSE, THUE_MORSE[0]])
    assert codes.tolist() == [0, 1, 0] and tuple(names) == THUE_MORSE
    assert len(set(word_hashes([" ".join(THUE_MORSE)], SPACED)[0].tolist())) == 2


def test_pieces_with_equal_hashes_are_told_apart(monkeypatch):
    from stridelake.llm import pretokens

    monkeypatch.setattr(pretokens, "segment_hashes", lambda values, lengths: np.zeros(len(lengths), np.uint64))
    codes, names, per_text = pretokens.split_pieces(["one two", None, "two one"])
    assert [names[c] for c in codes] == ["one", " two", "two", " one"] and per_text.tolist() == [2, 0, 2]


@pytest.mark.parametrize("most", [0, 40])
def test_rare_pieces_are_encoded_alike(spark, most):
    texts = [*nasty(60, 12), *THUE_MORSE, "common words " * 50]
    table = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    same = [sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode_documents(table, queries.RANKS, most=n).collect()) for n in (most, byte_bpe.COMMON_PIECES)]
    assert same[0] == same[1] and {r[0]: r[2] for r in same[0]} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [0, 10])
def test_every_distinct_piece_is_replayed_once(spark, monkeypatch, tmp_path, most):
    """Rows repeat, lack ids or texts, a long piece stands in all of them. The replay of the corpus writes down each call, and so does each task that puts texts together."""
    from stridelake.llm.pretokens import split_pieces

    texts = [None, "", "-" * 100, *["-" * 100 + f" word{i % 7} Xq{i} {'z' * i}" for i in range(120)]]
    path = str(tmp_path / "d")
    docs(spark, [(None if i % 5 == 0 else i % 50, t, "a") for i, t in enumerate([*texts, *texts])]).repartition(7).write.parquet(path)
    want = sorted((str(None if i % 5 == 0 else i % 50), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate([*texts, *texts]))
    log = str(tmp_path / "log")
    real = byte_bpe.MergeReplay

    class Noted(real):
        def encode(self, pieces):
            with open(log, "a", encoding="utf-8") as f:
                f.write("".join(p + "\x01" for p in pieces))
            return super().encode(pieces)

    def pieces_noted(pieces, ranks_path):
        ranks = pieces.sparkSession.sparkContext.broadcast(byte_bpe.read_ranks(ranks_path))

        def replay(batches):
            import pyarrow as pa

            engine = Noted(ranks.value)
            for batch in batches:
                ids = [np.array(x, "<u4").tobytes() for x in engine.encode(batch.column("piece").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(ids, pa.binary())], names=["piece", "n", "ids"])

        return pieces.mapInArrow(replay, "piece string, n long, ids binary")

    def store_noted(key, ranks, seed=None):
        if key not in byte_bpe._stores:
            byte_bpe._stores.clear()
            engine = Noted(ranks)
            byte_bpe._stores[key] = engine, byte_bpe.PieceStore(engine.encode, seed)
        return byte_bpe._stores[key]

    from pyspark import cloudpickle

    monkeypatch.setattr(byte_bpe, "encoded_pieces", pieces_noted)
    monkeypatch.setattr(byte_bpe, "_store", store_noted)
    cloudpickle.register_pickle_by_value(byte_bpe)
    try:
        got = byte_bpe.encode_documents(spark.read.parquet(path), queries.RANKS, most=most).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(byte_bpe)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == want
    with open(log, encoding="utf-8") as f:
        calls = f.read().split("\x01")[:-1]
    assert sorted(calls) == sorted(set(split_pieces(texts)[1]))


def slow_base(text):
    """The fixed patterns read to the letter."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark):
    rng = random.Random(5)
    bits = ["token = ", "PassWord:'", "api_key=", "apikey = \"", "ſecret=", "AKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "deadbeef", "é", " ", "secret", "=", "xY9_", "words"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(300)]
    key = "q7Xz9Lw2Vb8Rt4Kp6Ny1Jd3Hf5Gs0Mc"
    texts.append(f"the ordinary words of this line hide {key} here")
    texts += ["ordinary words about running and cycling in the autumn hills"] * 3
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = slow_base(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    assert got[300].n_markov == 1 and got[301].spans == ""


def test_markov_model_on_held_out_strings():
    words = [w for w in re.findall(r"[a-z_]{4,}", open(line_dedup.__file__).read() + open(minhash.__file__).read())]
    table = secret_scan.log_ratio(secret_scan.random_sample(2000), words[::2])
    held = ["_".join(words[i : i + 3]) for i in range(1, len(words) - 3, 7)]
    plain = [secret_scan.mean_score(w, table) > secret_scan.THRESHOLD for w in held]
    keys = [secret_scan.mean_score(w, table) > secret_scan.THRESHOLD for w in secret_scan.random_sample(200, seed=99)]
    assert np.mean(plain) < 0.02 and np.mean(keys) > 0.9


def similarity(a, b):
    grams = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a.split(), b.split())]
    return sum((grams[0] & grams[1]).values()) / sum((grams[0] | grams[1]).values())


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(40)}" for _ in range(rng.choice([6, 60, 200]))]
        for _ in range(12):
            words = base.copy()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(9)}"
            texts.append(" ".join(words))
    parent = list(range(len(texts)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i, j in itertools.combinations(range(len(texts)), 2):
        if similarity(texts[i], texts[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    got = {r.doc_id: r.class_id for r in minhash.near_report(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("seed", [1, 2])
def test_large_buckets_equal_brute_force(spark, seed):
    """Copies of a base with up to many edits, of which most are not similar to it; every bucket of more than two is a large one."""
    rng = random.Random(seed)
    texts = []
    for g in range(2):
        base = [f"g{g}w{k}" for k in range(70)]
        other = base[:50] + [f"g{g}v{k}" for k in range(20)]
        for k in range(45):
            words = (base if k % 3 else other).copy()
            for _ in range(rng.randint(0, 7)):
                at = rng.randrange(60)
                words[at : at + rng.choice([0, 1, 1])] = [f"n{rng.randrange(2)}"] * rng.choice([0, 1, 1])
            texts.append(" ".join(words))
    parent = list(range(len(texts)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i, j in itertools.combinations(range(len(texts)), 2):
        if similarity(texts[i], texts[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    got = {r.doc_id: r.class_id for r in minhash.near_report(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), small=2).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 2**62, 300, dtype=np.uint64)
    one, two = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    both = minhash.bag_signatures(np.tile(words, 2), np.repeat([0, 1], 300), np.concatenate((one, two)), 2, 4096)
    assert abs(np.mean(both[0] == both[1]) - np.minimum(one, two).sum() / np.maximum(one, two).sum()) < 0.03


def test_licences(spark):
    mit = licences.TEXTS["MIT"]
    texts = ["MIT License\n\nCopyright (c) 2024 Ada Runner\n\n" + mit.upper(), "words\nReleased under the MIT Licence.", "# Licensed  under the Apache License,   Version 2.0!", mit[:-5], "nothing"]
    got = {r.doc_id: (r.licence, r.n_lines, r.licences) for r in licences.scan_licences(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got[0][0] == "MIT" and got[1] == (None, 1, "MIT") and got[2][0] == "Apache-2.0" and got[3][0] is None and got[4] == (None, 0, "")
    for t in [*texts, *licences.TEXTS.values(), *nasty(50, 6)]:
        assert spark.createDataFrame([(t,)], "t string").select(licences.canonical(F.col("t"))).first()[0] == licences.canonical_text(t)


def test_differencing_beats_greedy():
    assert sharding.differencing({}, 3) == {}
    rng = random.Random(9)
    sizes = {i: rng.randint(1, 1000) for i in range(400)}
    where = sharding.differencing(sizes, 40)
    total = Counter()
    for i, s in where.items():
        total[s] += sizes[i]
    greedy = [0] * 40
    for s in sorted(sizes.values(), reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert set(where) == set(sizes) and max(total.values()) - min(total.values()) <= max(greedy) - min(greedy)


def test_shards(spark):
    rows = [(i, "x" * (i * 37 % 900) if i % 3 else "the same copy in a third of all rows", "a") for i in range(3000)]
    got = sharding.shard(docs(spark, rows)).collect()
    assert {r.doc_id: r["size"] for r in got} == {i: len(t.encode()) + 16 for i, t, _ in rows}
    by_text, slots, total = {}, {}, Counter()
    for r in got:
        by_text.setdefault(rows[r.doc_id][1], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        total[r.shard] += r["size"]
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = sorted(total.values())[:-1]
    assert rest[-1] - rest[0] <= 0.01 * rest[0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- x --><div class="ad">buy this now.</div><article><header>by Ada</header><h1>Head &amp; line</h1>
<p><b>First para&shy;graph,   with <i>in</i>line tags.<br><p>Second &lt;one&gt;, with a list.<ul><li>one item<li>two items</ul><div class="comments"><p>I disagree, strongly.</div>
<form>name <input></form><p>Third.</p></article><aside>see also, more, and more.</aside><footer>&copy; host</footer></body></html>"""


def test_main_text(spark):
    want = "Head & line\n\nFirst para\xadgraph, with inline tags.\n\nSecond <one>, with a list.\n\none item\n\ntwo items\n\nThird."
    bare = "<div><div id=menu><a>a</a> <a>b</a></div><div><p>Long text, of many words.</p><p>More of it, and more.</p></div><div>tiny</div></div>"
    table = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", bare, 5), (5, "u", "<p", 5), (6, "u", "plain  text", 5)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.extract_text(table).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == "" and got[2].url is None and got[3].text == "" and got[6].text == "plain text"
    assert got[4].text == "Long text, of many words.\n\nMore of it, and more."
    assert html_text.main_text('<body class="has-sidebar"><div id=sidebar>more, and more</div><article class="no-comments"><p>The text, in full.</p></article></body>') == "The text, in full."
    assert html_text.extract_text(table.limit(0)).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_contamination_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["é", "A", "b", "c9", "D"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 5, 12, 13, 14, 30])))) for i in range(25)] + [(99, None), (7, "repeated id of an item")]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, 5)
            parts.append(", ".join(w[a : a + rng.randint(8, 25)]))
        rows.append((i, " - ".join(parts), "a"))
    got = {r.doc_id: r for r in decontaminate.contamination_report(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text, _ in rows:
        w, hit, met = words_of(text), set(), set()
        for item, t in items:
            x = words_of(t)
            n = min(13, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    met.add(str(item))
        want = (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == want


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert ids and len(ids) == len(set(ids))


@pytest.mark.parametrize(("classes", "small"), [(line_dedup.WORD_CLASSES, 32), (line_dedup.WORD_CLASSES, 3), (((4, 7, 1), (7, 99, 2)), 3)])
def test_long_lines_by_words_equal_brute_force(spark, classes, small):
    rng = random.Random(small)
    sizes = [5, 6, 7, 9] if classes[0][0] == 4 else [20, 30, 59, 60, 70]
    base = [[rng.choice(["alpha", "beta", "gamma", "delta7", "é"]) for _ in range(rng.choice(sizes))] for _ in range(8)]
    lines = []
    for _ in range(120):
        words = rng.choice(base).copy()
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choice([[], ["changed"], [f"n{rng.randint(0, 99)}"]])
        lines.append(" ".join(words))

    def near(a, b):
        x, y = a.split(" "), b.split(" ")
        most = [t for low, high, t in classes if low <= min(len(x), len(y)) < high]
        return distance(a, b) <= 1 or bool(most) and distance(x, y) <= most[0]

    seen, want = [], {}
    for i, line in enumerate(lines):
        if len(line) >= 20 and line not in seen:
            want[i] = (0, int(any(near(line, s) for s in seen)))
        else:
            want[i] = (int(len(line) >= 20), 0)
        seen += [line] if len(line) >= 20 else []
    got = {r.doc_id: (r.n_exact, r.n_near) for r in line_dedup.line_report(docs(spark, list(zip(range(len(lines)), lines, ["a"] * len(lines)))), small=small, word_classes=classes).collect()}
    assert got == want


def test_line_stage_removes_a_long_line_with_one_changed_word(spark):
    words = [f"word{k}" for k in range(80)]
    other = [*words[:40], "replacement", *words[41:79], "42"]
    rows = [(1, " ".join(words), "a"), (2, " ".join(other) + "\nanother line of this document that nobody repeats", "a")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_stage(docs(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "another line of this document that nobody repeats"


def test_stage_limit_does_not_rise_with_the_host_and_one_near_copy_stays(spark):
    letters = lambda n: chr(97 + n // 26) + chr(97 + n % 26)
    own = lambda i: " ".join(letters(i) + letters(j) for j in range(60))
    boiler = "all rights of this page are with the host that shows it to you here"
    rows = [(i, f"{boiler}\n{own(i)}" if i < 12 else own(i), "h") for i in range(300)]
    shared = [" ".join(f"shared{letters(20 * k + j)}" for j in range(20)) for k in range(5)]
    rows += [(1000 + i, "\n".join([*shared, f"the copy that has the mark m{chr(97 + i)}"]), "h") for i in range(15)]
    got = {r.doc_id: r.text for r in quality_rules.quality_stage(docs(spark, rows)).collect()}
    assert all(got[i] == own(i) for i in range(300))
    assert [i for i in got if i >= 1000] == [1000] and got[1000] == rows[300][1]


@pytest.mark.parametrize("big", ["<ul>{}</ul>", "<ol>{}</ol>", "<table>{}</table>", "<dl>{}</dl>", "<pre>{}</pre>", "<section>{}</section>", "<div>{}</div>"])
def test_main_text_keeps_what_stands_around_a_large_part(big):
    rows = {"<ul>": "<li>", "<ol>": "<li>", "<dl>": "<dd>", "<table>": "<tr><td>"}
    inner = "".join(f"{rows.get(big.split('{')[0], '<p>' if big[1] in 'sd' else '')}Entry {k}, which has quite a few words, and more of them." for k in range(12))
    page = f"<body><nav>menu</nav><div><h1>Title</h1><p>The intro, of some words.</p>{big.format(inner)}<p>The closing words, at the end.</p></div><footer>foot</footer></body>"
    got = html_text.main_text(page)
    assert got.startswith("Title\n\nThe intro, of some words.") and got.endswith("The closing words, at the end.") and "Entry 11" in got and "menu" not in got and "foot" not in got


def test_marks_do_not_drop_content():
    text = "<p>Some text of the page, in full.</p>"
    for wrapper in ('<div id=page class="has-sidebar">{}</div>', '<div class="navigation">{}</div>', '<div class=banner><article>{}</article></div>', '<div class="page-header">{}</div>', '<section id="search">{}</section>'):
        assert "Some text of the page, in full." in html_text.main_text(f"<body>{wrapper.format(text)}<div>tiny</div></body>"), wrapper
    page = '<body><div><h2 id="related-work">Related work</h2><p>One text, with words.</p><section id="search"><h2>Search</h2><p>Second text, with words.</p></section><div class="page-header"><p>Third text, with words.</p></div><div class="nav-menu ad"><p>Buy this, and that.</p></div></div></body>'
    assert html_text.main_text(page) == "Related work\n\nOne text, with words.\n\nSearch\n\nSecond text, with words.\n\nThird text, with words."


def test_op3_equals_the_library_at_its_default_settings(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.LIBRARY_VOCABULARY)
    end = "<|endoftext|>"
    assert library.encode(f"a {end} b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rng = random.Random(7)
    texts = [f"a {end} b", end, end * 3, f" {end}", f"{end} it's", "", "plain", "<|endoftext|", *(end.join(nasty(rng.randint(1, 4), k)) for k in range(50))]
    docs(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(len(texts), None, "a")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op3_token_files(spark, str(tmp_path)).collect()}
    at = 0
    for i, text in enumerate([*texts, ""]):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


NO_ID = [(None, "a line that stands in three rows of this table\nthe first row has this line of its own"), (None, "a line that stands in three rows of this table\nthe second row has another line of its own"), (1, "a line that stands in three rows of this table"), (1, "this row repeats an id with a text that nobody else has")]


def test_rows_without_an_id_lose_nothing_of_their_own(spark):
    table = docs(spark, [(i, t, "a") for i, t in NO_ID])
    got = sorted((str(r.doc_id), r.n_exact, r.text) for r in line_dedup.line_report(table).collect())
    assert got == [("1", 0, NO_ID[2][1]), ("1", 0, NO_ID[3][1]), ("None", 1, NO_ID[0][1].split("\n")[1]), ("None", 1, NO_ID[1][1].split("\n")[1])]
    assert sorted(r.text for r in line_dedup.dedup_stage(table).collect()) == sorted(g[2] for g in got)


def test_rows_without_an_id_have_hits_and_classes_of_their_own(spark):
    item = " ".join(f"w{k}" for k in range(20))
    clean = " ".join(f"c{k}" for k in range(30))
    table = docs(spark, [(None, item, "a"), (None, clean, "a"), (3, item + " x", "a"), (3, clean + " y z", "a")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted((r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination_report(table, bench).collect())
    assert got == [(20, 20, True), (21, 20, True), (30, 0, False), (32, 0, False)]
    kept = decontaminate.decontamination_stage(table.withColumn("__h1", F.lit("clash")), bench)
    assert sorted(r.text for r in kept.collect()) == [clean, clean + " y z"] and "__h1" in kept.columns
    near = {r.text: r for r in minhash.near_stage(table.withColumn("__id", F.lit("clash"))).collect()}
    assert set(near) == {item + " x", clean + " y z"}  # of each pair the row with an id
    found = licences.scan_licences(docs(spark, [(None, "MIT License", "a"), (None, "no licence", "a"), (5, "MIT License", "a"), (5, "other", "a")])).collect()
    assert sorted((str(r.doc_id), r.licences) for r in found) == [("5", ""), ("5", "MIT"), ("None", ""), ("None", "MIT")]
    boiler = "subscribe to our letter and follow us on every channel there is today"
    own = lambda i: " ".join(f"{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60))
    judged = quality_rules.quality_report(docs(spark, [(None, f"{boiler}\n{own(i)}", "h") for i in range(12)] + [(None, own(20), "h")])).collect()
    assert sorted(r.n_removed_words for r in judged) == [0] + [13] * 12


@pytest.mark.parametrize(("inside", "want"), [
    ("<p title='it's'>One text, of words.</p><p>Two.</p>", "One text, of words.\n\nTwo."),
    ('<p title="a"b">One text, of words.</p><p>Two.</p>', "One text, of words.\n\nTwo."),
    ('<p>One text, <span class="ad">BUY NOW</span>of words.</p>', "One text, of words."),
    ('<p>One text, <span class="ad">BUY <b>NOW</b> of words.</p><p>Two.</p>', "One text,\n\nTwo."),
    ('<div class="post-header"><h1>Head</h1></div><p>One text, 3 < 4 of words.</p>', "Head\n\nOne text, 3 < 4 of words."),
    ("<div><p>One text, of words.</p></div><div class=search-result-social-story><p>Two texts, of words.</p></div>", "One text, of words.\n\nTwo texts, of words."),
])
def test_odd_markup(inside, want):
    assert html_text.main_text(f"<body><nav>menu</nav><article>{inside}</article><footer>foot</footer></body>") == want


def test_content_in_two_articles_and_linear_time():
    import time

    long, short = "A sentence of the first section, which is longer. " * 16, "A sentence of the second section, shorter. " * 10
    page = f"<body><main><p>{long}</p></main><nav>menu</nav><article><p>{short}</p></article></body>"
    assert html_text.main_text(page) == f"{long.strip()}\n\n{short.strip()}"
    for odd in ("<a ", "<a b='", '<a b="', "<!-", "</", "<p>", "<script>", "<b x=1>"):
        begun = time.time()
        html_text.main_text("<p>Text.</p>" + odd * (200_000 // len(odd)))
        assert time.time() - begun < 4, odd


def test_full_texts_and_endings(spark):
    known = licences.known_digests()
    sum_of = lambda t: hashlib.sha256(licences.canonical_text(t).encode()).hexdigest()
    assert known[sum_of("Copyright 2020 Ada\n\n" + licences.TEXTS["BSD-3-Clause"])] == "BSD-3-Clause" and known[sum_of("SPDX-License-Identifier: GPL-3.0-or-later")] == "GPL-3.0"
    assert {"Apache-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0"} <= {known[d] for d in licences.FULL_DIGESTS.values()}


def test_mixed_case_keys_without_a_digit():
    words = [w for w in re.findall(r"[A-Za-z_]{4,}", open(line_dedup.__file__).read() + open(minhash.__file__).read())]
    scorer = secret_scan.Scorer(secret_scan.log_ratio(secret_scan.random_sample(2000), words), secret_scan.THRESHOLD)
    rng = random.Random(21)
    keys = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=32)) for _ in range(200)]
    assert np.mean([any(k == "markov" for _, k, _ in secret_scan.spans_of(f"the key {key} stands here", scorer)[1]) for key in keys]) > 0.9
    assert not secret_scan.spans_of("see TheOrdinaryDocumentNamesOfThisCorpus for more", scorer)[1]


def test_lines_of_words_with_equal_marks_stay(spark):
    """60 lines of 24 words, any two at least 4 words apart, whose words would be equal if each were cut to one of 45,056 characters."""
    import xxhash

    seen, pairs = {}, []
    for i in range(20_000):
        word = f"w{i}"
        other = seen.setdefault(xxhash.xxh64_intdigest(word, 42) % 45056 if xxhash.xxh64_intdigest(word, 42) < 2**63 else (xxhash.xxh64_intdigest(word, 42) - 2**64) % 45056, word)
        if other != word and len(pairs) < 24:
            pairs.append((other, word))
    rng, codes = random.Random(4), []
    while len(codes) < 60:
        code = rng.getrandbits(24)
        if all((code ^ c).bit_count() >= 4 for c in codes):
            codes.append(code)
    lines = [" ".join(pairs[j][c >> j & 1] for j in range(24)) for c in codes]
    table = docs(spark, [(i, line, "a") for i, line in enumerate(lines)])
    for small in (3, 32):
        assert line_dedup.dedup_stage(table, small=small).count() == 60


def test_near_lines_are_joined_without_broadcasts(spark, monkeypatch):
    """Near copies make small files of what is large in memory, so no join of line dedup may go by the size of files."""
    plans = []

    def stored(df, label, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label, **options)

    keep = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", stored)
    rng = random.Random(8)
    words, lines = [f"word{i}" for i in range(70)], []
    for _ in range(40):
        line = list(words)
        for at in rng.sample(range(70), rng.randint(0, 5)):
            line[at] = f"other{rng.randrange(1000)}"
        lines.append(" ".join(line))
    out = line_dedup.dedup_stage(docs(spark, [(i, line, "a") for i, line in enumerate(lines)]), small=4)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 8 and not any("Broadcast" in p for p in plans)
    far = lambda a, b: sum(x != y for x, y in zip(a.split(" "), b.split(" "), strict=True)) > 2  # noqa: E731  words are only replaced
    assert {r.doc_id for r in out.collect()} == {i for i, line in enumerate(lines) if all(far(line, other) for other in lines[:i])}
