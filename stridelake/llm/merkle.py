"""Operator 13: a Merkle tree over the rows of a dataset, with a proof for every row, built by a butterfly exchange.

The leaves of a tree stand in order and are cut into aligned blocks of ``fanout ** depth``, each of which hashes its own part. In round r
every block swaps the root of its part with the blocks that differ from it in the r-th digit (base ``fanout``) of the block number
only, and hashes their common ancestor itself. After the last round each block holds its tree's root and all digests that the
proofs of its leaves need above it; nothing is sent back down.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import with_rank, with_serial
from .shared import discard, stored

#: Children of a node.
FANOUT = 8
#: Levels that a block hashes alone: 4,096 leaves of fanout 8.
DEPTH = 4

PATH = "array<struct<left:string,right:string>>"


def row_digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the values in order: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(leaves: list[str], alone: bool, fanout: int, depth: int) -> list[list[str]]:
    """The digests of a block, level by level: all ``depth`` levels, but no more than needed if the block is a tree ``alone``."""
    out = [leaves]
    while len(out[-1]) > 1 if alone else len(out) <= depth:
        below = out[-1]
        out.append([_sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def _block(table: pa.Table, fanout: int, depth: int) -> tuple[pa.Table, list[list[str]]]:
    """The rows of a block in order, and its digests. Only a tree's first block can be shorter than the tree's other blocks and yet be all of it."""
    table = table.sort_by("__at")
    leaves = table.column("__leaf").to_pylist()
    alone = table.column("__block")[0].as_py() == 0 and len(leaves) < fanout**depth
    return table, _levels(leaves, alone, fanout, depth)


def _swap(state: DataFrame, fanout: int, stride: int) -> DataFrame:
    """A round of the exchange: nodes whose numbers agree but for the digit of value ``stride`` learn each other's digest.

    A last part may have fewer nodes than its siblings; theirs are then served by its nodes in turn. Each node is sent one digest per
    sibling, whoever sends it.
    """
    place, n = F.col("__place"), F.col("__n")
    child = lambda c: F.floor(c / stride)
    size = lambda c: F.least(F.lit(stride), n - c * stride)
    low = place % stride
    own = child(place)
    first = F.floor(own / fanout) * fanout
    sent = state.withColumn("__from", own).withColumn("__c", F.explode(F.sequence(first, F.least(first + (fanout - 1), child(n - 1)))))
    to = F.when(F.col("__c") == F.col("__from"), F.array(place)).when(low < size(F.col("__c")), F.transform(F.sequence(low, size(F.col("__c")) - 1, size(F.col("__from"))), lambda x: F.col("__c") * stride + x))
    sent = sent.select("__tree", "__n", "__from", "__digest", F.when(F.col("__c") == F.col("__from"), F.col("__path")).alias("__path"), F.explode(to).alias("__place"))
    met = sent.groupBy("__tree", "__place").agg(F.max("__n").alias("__n"), F.sort_array(F.collect_list(F.struct(F.col("__from").alias("c"), F.col("__digest").alias("d")))).alias("__run"), F.any_value("__path", True).alias("__path"))
    side = lambda keep: F.array_join(F.transform(F.filter("__run", lambda r: keep(r["c"])), lambda r: r["d"]), "")
    met = met.withColumn("__step", F.struct(side(lambda c: c < child(place)).alias("left"), side(lambda c: c > child(place)).alias("right")))
    higher = n > stride
    digest = F.when(higher, F.sha2(side(lambda c: F.lit(True)), 256)).otherwise(F.element_at("__run", 1)["d"])
    return met.select("__tree", "__place", "__n", digest.alias("__digest"), F.when(higher, F.concat("__path", F.array("__step"))).otherwise(F.col("__path")).alias("__path"))


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``nodes`` (``__tree``, ``__place`` from 0 without gaps, ``__digest``): every node with the root of its tree as ``__digest`` and the siblings on its way there as ``__path``."""
    sizes = nodes.groupBy("__tree").agg(F.count(F.lit(1)).alias("__n"))
    state = stored(nodes.join(sizes, "__tree").select("__tree", "__place", "__n", "__digest", F.array().cast(PATH).alias("__path")), "nodes")
    most, stride, first = state.agg(F.max("__n")).first()[0] or 0, 1, state
    while stride < most:
        state = _swap(state, fanout, stride)
        stride *= fanout
    if state is first:
        return state
    out = stored(state, "exchanged")
    discard(first)
    return out


def manifest(rows: DataFrame, by: str, order: list[str], leaf: str = "leaf", fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Every row with ``place`` (its leaf's number in its tree, from 0), ``subroot``, ``root`` and ``proof``: the digests left and right of it, level by level up to the root.

    ``rows`` have a digest in ``leaf``. There is a tree for each value of ``by`` (null is a value of its own), whose leaves ascend by
    ``order`` (nulls first, then by digest); the trees' roots, ascending bytewise by ``by`` with null first, are the leaves of the last tree. While a level has several nodes,
    every ``fanout`` consecutive ones (fewer at the end, even one) are hashed into one. A lone leaf is the root of its tree and has an
    empty proof in it. Rows that repeat a row are leaves of their own. An empty table gives no rows. Columns named like one of the four new ones
    give way to them.
    """
    size = fanout**depth
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    keys = [f"__o{i}" for i in range(len(order))]
    leaves = stored(rows.select(F.struct("*").alias("__row"), tree.alias("__tree"), F.col(leaf).alias("__leaf"), *[F.col(c).alias(k) for c, k in zip(order, keys)]), "leaves")
    # the last key splits groups of equal rows; their leaves are the same in any order
    ranked = with_rank(leaves.withColumn("__tie", F.monotonically_increasing_id()), ["__tree"], [*[F.asc_nulls_first(k) for k in keys], "__leaf", "__tie"], "__rank")
    ranked = ranked.select("__row", "__tree", "__leaf", F.floor((F.col("__rank") - 1) / size).alias("__block"), ((F.col("__rank") - 1) % size).alias("__at"))

    def top(table: pa.Table) -> pa.Table:
        table, levels = _block(table, fanout, depth)
        return pa.table({"__tree": table.column("__tree").slice(0, 1), "__place": table.column("__block").slice(0, 1), "__digest": pa.array(levels[-1], pa.string())})

    tops = ranked.select("__tree", "__leaf", "__block", "__at").groupBy("__tree", "__block").applyInArrow(top, "__tree string, __place long, __digest string")
    blocks = butterfly(tops, fanout)
    trees = with_serial(blocks.filter("__place = 0").select(F.col("__tree").alias("__name"), "__digest"), ["__name"], -1, "__at")
    trees = stored(trees.select(F.lit(0).alias("__tree"), F.col("__at").alias("__place"), "__name", "__digest"), "trees")
    forest = butterfly(trees.select("__tree", "__place", "__digest"), fanout)
    above = forest.select("__place", F.col("__digest").alias("__root"), F.col("__path").alias("__upper")).join(trees.select("__place", F.col("__name").alias("__tree")), "__place").drop("__place")
    blocks = blocks.join(above, "__tree").select("__tree", F.col("__place").alias("__block"), F.col("__digest").alias("__subroot"), "__root", F.concat("__path", "__upper").alias("__path"))
    kind = dict(ranked.dtypes)["__row"]

    def prove(leaves: pa.Table, block: pa.Table) -> pa.Table:
        table, levels = _block(leaves, fanout, depth)
        joined = [["".join(level[i : i + fanout]) for i in range(0, len(level), fanout)] for level in levels[:-1]]
        upper = block.column("__path")[0].as_py()
        proofs = []
        for i in range(table.num_rows):
            path = []
            for runs in joined:
                run, at = runs[i // fanout], i % fanout * 64
                path.append({"left": run[:at], "right": run[at + 64 :]})
                i //= fanout
            proofs.append(path + upper)
        same = lambda name: pa.array([block.column(name)[0].as_py()] * table.num_rows, pa.string())
        proof = pa.array(proofs, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        first = table.column("__block")[0].as_py() * size
        return pa.table({"__row": table.column("__row"), "place": pa.array([first + a for a in table.column("__at").to_pylist()], pa.int64()), "subroot": same("__subroot"), "root": same("__root"), "proof": proof})

    out = ranked.groupBy("__tree", "__block").cogroup(blocks.groupBy("__tree", "__block")).applyInArrow(prove, f"__row {kind}, place long, subroot string, root string, proof {PATH}")
    new = ["place", "subroot", "root", "proof"]
    return out.select(*[F.col("__row")[c].alias(c) for c in rows.columns if c not in new], *new)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all digests of a proof, left to right, level by level; that of nothing for an empty proof."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to: equal to the dataset's root if the leaf is the one that was proven."""
    return F.aggregate(proof, leaf, lambda got, s: F.sha2(F.concat(s["left"], got, s["right"]), 256))
