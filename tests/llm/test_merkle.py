"""Operator 13 against trees built one by one."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stridelake.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, fanout):
    """Root, and of each leaf the siblings left and right of its way up."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // fanout * fanout : i // fanout * fanout + fanout]
            paths[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            at[k] = i // fanout
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


@pytest.mark.parametrize(("fanout", "depth", "sizes"), [(2, 1, [1, 2, 3, 37]), (3, 1, [50, 0, 1]), (2, 2, [64, 65, 5, 4]), (8, 4, [70, 10])])
def test_proofs_equal_those_of_single_trees(spark, fanout, depth, sizes):
    """Blocks of two to 4,096 leaves, whole and cut-off last parts, repeated and null ids, equal leaves, a null tree."""
    random.seed(fanout)
    rows = [(random.choice([None, i, i]), None if t == 0 else f"l{t}", sha(str(random.random())) if i % 7 else sha("x")) for t, n in enumerate(sizes) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, lang string, leaf string"), "lang", ["doc_id"], fanout=fanout, depth=depth).collect()
    names = sorted({r[1] for r in rows}, key=lambda x: (x is not None, x or ""))
    want, subroots = {}, []
    for name in names:
        mine = sorted((r for r in rows if r[1] == name), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        root, paths = tree([r[2] for r in mine], fanout)
        subroots.append(root)
        want |= {(name, i): (r, p) for i, (r, p) in enumerate(zip(mine, paths))}
    root, upper = tree(subroots, fanout)
    assert len(got) == len(want)
    for g in got:
        row, path = want[(g.lang, g.place)]
        k = names.index(g.lang)
        assert (g.doc_id, g.lang, g.leaf, g.subroot, g.root) == (*row, subroots[k], root)
        assert [tuple(s) for s in g.proof] == path + upper[k]


def test_a_changed_row_does_not_fold_to_the_root(spark):
    df = spark.createDataFrame([(i, "en", f"Text {i}") for i in range(100)] + [(None, None, None), (3, "en", "Text 3")], "doc_id long, lang string, text string")
    rows = df.withColumn("leaf", merkle.row_digest(F.col("doc_id"), F.col("lang"), F.col("text"))).withColumn("root", F.lit("clash"))
    out = merkle.manifest(rows, "lang", ["doc_id"], fanout=4, depth=1)
    other = merkle.row_digest(F.col("doc_id"), F.col("lang"), F.lower("text"))
    got = out.select("doc_id", (merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("same"), (merkle.folded(other, F.col("proof")) == F.col("root")).alias("other")).collect()
    assert len(got) == 102 and all(r.same for r in got)
    assert [r.doc_id for r in got if r.other] == [None]
    assert merkle.manifest(rows.limit(0), "lang", ["doc_id"]).count() == 0


def test_the_digest_of_a_row_names_lengths_and_nulls(spark):
    df = spark.createDataFrame([("é", None, 12), ("", "-", None)], "a string, b string, c long")
    got = [r[0] for r in df.select(merkle.row_digest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [sha("2:é-2:12"), sha("0:1:--")]


def test_query_on_null_and_repeated_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "A b", "en", "s", 3), (2, "a b", "", "s", 3), (6, "\x00Ü" * 40_000, "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == 5 and len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 3
