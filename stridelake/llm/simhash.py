"""Operator 11: SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into ``BLOCKS`` blocks. Two fingerprints that differ in at most two bits agree in all blocks but two, so
they share the key of some choice of ``BLOCKS - 2`` blocks; distinct fingerprints are joined on these keys and verified by their Hamming distance.
A key that more than ``SMALL`` fingerprints hold is not paired: each of its fingerprints goes to the 65 points at most one
bit away, and fingerprints that meet in a point are within two bits of each other, while any two within two bits meet in one. No more than 65 can meet.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import labels, stars
from .shared import discard, stored

BITS = 64
#: Bits in which linked fingerprints may differ; the points of large keys rest on this number.
DISTANCE = 2
#: Five blocks give ten keys of 38 or 39 bits, enough for 10 to the 10 documents to share them by chance about once each.
BLOCKS = 5
SHINGLE = 3
#: Fingerprints of a key that are paired at most.
SMALL = 32
SEED = 42
_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Of the XXH64 of all shingles of ``width`` words, repeats included: a bit is set if it is in over half of them. Zero without words."""
    words = text.lower().split() if text else []  # of bytes: A-Z, and white space of ASCII
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(width, len(words))
    first, last = (ends - sizes)[: len(words) - width + 1], ends[width - 1 :]
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(first), _AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[i : i + _AT_ONCE].tolist(), last[i : i + _AT_ONCE].tolist())], np.dtype("<u8"))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(first), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``__fp``, the fingerprint as a signed number, of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "__fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(work, f"doc_id {kind}, __fp long")


def block_masks(blocks: int = BLOCKS) -> list[int]:
    """The bits of every choice of all blocks but ``DISTANCE``, as signed numbers."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    wide = [sum(chosen) for chosen in itertools.combinations(parts, blocks - DISTANCE)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in wide]


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def links(points: DataFrame, blocks: int = BLOCKS, small: int = SMALL) -> DataFrame:
    """Pairs ``__a < __b`` of the distinct fingerprints ``__fp`` whose connected components are those of all pairs within ``DISTANCE`` bits."""
    masks = block_masks(blocks)
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("__fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    spread = points.select("__fp", F.explode(keys).alias("__key"))
    sizes = spread.groupBy("__key").agg(F.count(F.lit(1)).alias("__size"), F.min("__fp").alias("__a"), F.max("__fp").alias("__b"))
    sizes = stored(sizes.filter("__size > 1"), "sizes")
    two = sizes.filter("__size = 2").select("__a", "__b").filter(_near(F.col("__a"), F.col("__b")))
    members = stored(spread.join(sizes.filter("__size > 2").select(F.col("__key").alias("__k"), "__size"), F.col("__key") == F.col("__k")).drop("__k"), "members")
    few = members.filter(F.col("__size") <= small)
    other = few.select(F.col("__key").alias("__k"), F.col("__fp").alias("__b"))
    few = few.withColumnRenamed("__fp", "__a").join(other, (F.col("__key") == F.col("__k")) & (F.col("__a") < F.col("__b")) & _near(F.col("__a"), F.col("__b"))).select("__a", "__b")
    many = members.filter(F.col("__size") > small).select("__fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << BITS) if b == BITS - 1 else 1 << b) for b in range(BITS)])
    met = many.select("__fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("__fp")))).alias("__point")).groupBy("__point").agg(F.min("__fp").alias("__a"), F.collect_list("__fp").alias("__all"))
    met = met.filter(F.size("__all") > 1).select("__a", F.explode("__all").alias("__b")).filter((F.col("__a") < F.col("__b")) & _near(F.col("__a"), F.col("__b")))
    out = stored(two.union(few).union(met).distinct(), "links")
    discard(sizes, members)
    return out


def near_components(docs: DataFrame, width: int = SHINGLE, blocks: int = BLOCKS, small: int = SMALL) -> DataFrame:
    """One row per row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (least id that a chain of links reaches, its own included) and ``n_links``.

    Fingerprints of at most two differing bits are linked; ``n_links`` counts the other distinct fingerprints next to the row's own in the
    chosen links, which join the same components as all links. Words are runs of other characters than ASCII white space, A-Z
    in lower case; a shorter text is one shingle; null, empty and blank texts have fingerprint zero and are linked like any other. Null ids are passed
    over, and ``component_id`` is null where there is no other. Very long texts are read whole, repeated rows and ids each give a row, other
    columns are not looked at, and an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, width), "fingerprints")
    points = stored(rows.groupBy("__fp").agg(F.min("doc_id").alias("__first")), "points")
    pairs = links(points, blocks, small)
    star = stars(pairs)
    classes = stored(labels(star), "classes")
    degree = pairs.select("__a").union(pairs.select("__b")).groupBy(F.col("__a").alias("__id")).agg(F.count(F.lit(1)).alias("n_links"))
    linked = classes.join(points, F.col("__id") == F.col("__fp")).select("__fp", "__class", "__first")
    least = linked.groupBy("__class").agg(F.min("__first").alias("component_id")).withColumnRenamed("__class", "__c")
    # stored before it meets the rows, so that the rows of a fingerprint with very many can be split
    named = linked.join(least, F.col("__class") == F.col("__c")).join(degree, F.col("__fp") == F.col("__id")).select(F.col("__fp").alias("__g"), "component_id", "n_links")
    known = points.join(named, F.col("__fp") == F.col("__g"), "left").select(F.col("__fp").alias("__g"), F.when(F.col("__g").isNull(), F.col("__first")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = stored(known, "known")
    discard(points, pairs, star, classes)
    return rows.join(known, F.col("__fp") == F.col("__g")).select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
