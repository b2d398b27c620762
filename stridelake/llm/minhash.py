"""Near-duplicate documents by BagMinHash signatures, banding, and verified multiset overlap.

A document is the multiset of its five-word shingles. Every (shingle, weight range) is a Poisson process over time, signature position
and weight: weights are split into the ranges [0,1), [1,2), [2,4), ..., each with a process of its own rate, and the
points of the last range count only if their weight lies below the shingle's. A signature position keeps the earliest point,
and a process stops once its time passes the latest of these, so a signature costs little more than one draw per shingle.
Two signatures agree at a position with a probability of the weighted Jaccard similarity.

Documents that agree on a band meet in a bucket. Small buckets are paired; of large ones all members are compared with one leader.
What is still in different classes is joined by differences: large buckets in which
one class leads become one group around a centre (what its most linked document and some documents like it have in common), each member is described by the shingles it lacks of the centre and those it has
beyond it, and two members far from the centre can only be similar if these differences overlap by a known count, so that they share an
element of a prefix (see ``differences``). Classes are the connected components of verified pairs, so a pair is left out only if its
documents are linked already or provably too far apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, packed, row_key, same_row, stored
from .wordhash import GOLDEN, SPACED, mix, portions, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
SMALL_BUCKET = 8
#: Documents that make up a centre.
SAMPLE = 15
#: Members of a group that tell which shingles are common in it.
DRAWN = 64


def shingles(words: np.ndarray, per_doc: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes with the document each belongs to; a text of fewer words is one shingle."""
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    n = len(words)
    salt = mix(np.arange(1, width + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    if n >= width:
        whole = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            whole += words[j : n - width + 1 + j] * salt[j]
        inside = doc[: n - width + 1] == doc[width - 1 :]
        out, own = mix(whole[inside]), doc[: n - width + 1][inside]
    else:
        out, own = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((per_doc > 0) & (per_doc < width))
    if len(short):
        first = np.cumsum(per_doc) - per_doc
        more = []
        for d in short.tolist():
            k = int(per_doc[d])
            more.append(int((words[first[d] : first[d] + k] * salt[:k]).sum(dtype=np.uint64)) ^ k)
        out, own = np.concatenate((out, mix(np.array(more, np.uint64)))), np.concatenate((own, short))
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def weighted(out: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, their document, and how often they occur."""
    order = np.lexsort((out, own))
    out, own = out[order], own[order]
    if not len(out):
        return out, own, np.empty(0, np.int64)
    new = np.concatenate(([True], (out[1:] != out[:-1]) | (own[1:] != own[:-1])))
    at = np.flatnonzero(new)
    return out[at], own[at], np.diff(at, append=len(out))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_signatures(shingle: np.ndarray, own: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """``n_docs`` x ``size`` signature of point names; documents without shingles keep zeros."""
    earliest = np.full(n_docs * size, np.inf)
    name = np.zeros(n_docs * size, np.uint64)
    # one process for each weight range that a shingle reaches: the k-th spans [2^(k-1), 2^k), the first [0, 1)
    seed, doc, below, low, high = [], [], [], [], []
    k, some = 0, np.arange(len(shingle))
    while len(some):
        a, b = (0, 1) if k == 0 else (1 << (k - 1), 1 << k)
        seed.append(mix(shingle[some] + np.full(1, k, np.uint64) * GOLDEN))
        doc.append(own[some])
        below.append(weight[some])
        low.append(np.full(len(some), a))
        high.append(np.full(len(some), b))
        some = some[weight[some] > b]
        k += 1
    if not seed:
        return name.reshape(n_docs, size)
    seed, doc, below, low, high = map(np.concatenate, (seed, doc, below, low, high))
    time, step = np.zeros(len(seed)), 0
    while len(seed):
        step += 1
        point = mix(seed ^ mix(np.full(1, step, np.uint64)))
        time = time - np.log(_uniform(point)) / (high - low)
        other = mix(point + GOLDEN)
        spot = doc * size + ((other >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        level = low + ((other & np.uint64(0xFFFFFFFF)) * (high - low).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        good = (level < below) & (time < earliest[spot])
        spot, when, what = spot[good], time[good], point[good]
        np.minimum.at(earliest, spot, when)
        won = earliest[spot] == when
        name[spot[won]] = what[won]
        latest = earliest.reshape(n_docs, size).max(1)
        stays = time <= latest[doc]
        seed, doc, below, low, high, time = (x[stays] for x in (seed, doc, below, low, high, time))
    return name.reshape(n_docs, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    salt = mix(np.arange(1, rows + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    parts = (signature.reshape(len(signature), bands, rows) * salt).sum(2, dtype=np.uint64)
    return mix(parts + np.arange(bands, dtype=np.uint64) * GOLDEN).astype(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """Row key, ``__n`` (shingles with repeats) and ``__bands`` keys (none without a word) of every row."""
    schema = pa.schema([("__id", pa.int64()), ("__h1", pa.int64()), ("__h2", pa.int64()), ("__n", pa.int64()), ("__bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in portions([len(t or "") for t in texts], 3_000_000):
                words, per_doc = word_hashes(texts[a:b], SPACED)
                out, own = shingles(words, per_doc, width)
                sig = bag_signatures(*weighted(out, own), b - a, bands * rows)
                keys = band_keys(sig[per_doc > 0], bands, rows)
                ends = np.cumsum(np.where(per_doc > 0, bands, 0), dtype=np.int32)
                lists = pa.ListArray.from_arrays(np.concatenate((np.zeros(1, np.int32), ends)), keys.ravel())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in ("__id", "__h1", "__h2")], pa.array(np.bincount(own, minlength=b - a)), lists], schema=schema)

    return docs.select(*row_key(), "text").mapInArrow(sign, "__id long, __h1 long, __h2 long, __n long, __bands array<long>")


def shingle_sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``__id, __set``: the multiset as sorted 64-bit names; the k-th copy of a shingle has a name of its own."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in portions([len(t or "") for t in texts], 3_000_000):
                out, own = shingles(*word_hashes(texts[a:b], SPACED), width)
                shingle, doc, weight = weighted(out, own)
                first = np.cumsum(weight) - weight
                copy = np.arange(int(weight.sum())) - np.repeat(first, weight)
                names = mix(np.repeat(shingle, weight) + copy.astype(np.uint64) * GOLDEN)
                doc = np.repeat(doc, weight)
                names = names[np.lexsort((names, doc))]
                ends = np.cumsum(np.bincount(doc, minlength=b - a)).tolist()
                data = [names[x:y].tobytes() for x, y in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(a, b - a), pa.array(data, pa.binary())], names=["__id", "__set"])

    return docs.select("__id", "text").mapInArrow(collect, "__id long, __set binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``__a, __b`` whose multisets overlap by ``similarity`` of their union."""

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("__x"), batch.column("__y"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(common >= similarity * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("__a"), batch.column("__b")], names=["__a", "__b"]).filter(pa.array(keep, pa.bool_()))

    # the left document may be the leader of many pairs, so it comes last
    left, right = sets.withColumnsRenamed({"__id": "__i", "__set": "__x"}), sets.withColumnsRenamed({"__id": "__j", "__set": "__y"})
    both = pairs.join(right, F.col("__b") == F.col("__j")).join(left, F.col("__a") == F.col("__i"))
    return both.select("__a", "__b", "__x", "__y").mapInArrow(overlap, "__a long, __b long")


def consensus(near: DataFrame, sets: DataFrame) -> DataFrame:
    """``__c, __y``: the shingles that more than half of the (at most ``SAMPLE``) documents ``__id`` given for a ``__centre`` hold."""

    def majority(rows: pd.DataFrame) -> pd.DataFrame:
        names, held = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["__set"]]), return_counts=True)
        return pd.DataFrame({"__c": rows["__centre"].iloc[:1], "__y": [names[2 * held > len(rows)].tobytes()]})

    own = sets.withColumnRenamed("__id", "__i")
    return near.join(own, F.col("__id") == F.col("__i")).select("__centre", "__set").groupBy("__centre").applyInPandas(majority, "__c long, __y binary")


def differences(members: DataFrame, centres: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """What members of a group have to share with each other, given how they differ from the group's centre.

    ``members`` has ``__id, __n, __class, __centre``; added are the lists ``__index``, ``__probe``, and ``__best`` where a link to that document is proven.
    Let a member lack ``d`` shingles of the centre's ``c``, have ``u`` others, and weigh ``w = d + s * u``. Two members are similar
    if and only if their differences overlap by ``(w1 + w2 - (1 - s) * c) / (1 + s)`` or more. The lightest member of the group,
    ``__best``, is therefore similar to all members that make up ``(1 - s) * c`` with it or less; the others are far. A far member
    overlaps by more than ``(w - w(best)) / (1 + s)`` of any partner's difference. In an order that all members of the group share
    (shingles beyond the centre first, rare before common), similar members then have a common element among the first ``size - overlap + 1`` of both.
    ``__w``, ``__size`` (``c``) and ``__whole`` (``d + u``) are added for that count.
    ``__index`` is that prefix against any far partner, ``__probe`` that of a far member against anyone.

    A member with many shingles beyond the centre has a shorter way: similar sets of ``n`` elements have a common one among their first
    ``n - ceil(s * n) + 1``, here all beyond the centre. It probes with these, and all members have theirs in ``__index``.
    The centre, and the sample of ``DRAWN`` far members that tells common shingles, decide how much is compared, never the result.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for x, y in zip(batch.column("__x"), batch.column("__y"), strict=True):
                own, centre = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                parts.append((np.setdiff1d(own, centre, assume_unique=True), np.setdiff1d(centre, own, assume_unique=True), len(centre)))
            ends = np.cumsum([0, *(len(u) + len(d) for u, d, _ in parts)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *(half for u, d, _ in parts for half in (np.sort(u), np.sort(d)))])
            counts = [pa.array([x[0].size for x in parts], pa.int32()), pa.array([x[1].size for x in parts], pa.int32()), pa.array([x[2] for x in parts], pa.int32())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("__id", "__n", "__class", "__centre")], *counts, pa.ListArray.from_arrays(ends, flat.view(np.int64))], names=["__id", "__n", "__class", "__centre", "__u", "__d", "__size", "__apart"])

    own = sets.withColumnsRenamed({"__id": "__i", "__set": "__x"})
    both = members.join(own, F.col("__id") == F.col("__i")).join(centres, F.col("__centre") == F.col("__c"))
    rows = both.select("__id", "__n", "__class", "__centre", "__x", "__y").mapInArrow(compare, "__id long, __n long, __class long, __centre long, __u int, __d int, __size int, __apart array<long>")
    rows = apart = stored(rows.withColumn("__w", F.col("__d") + similarity * F.col("__u")), "apart")
    best = rows.groupBy(F.col("__centre").alias("__g")).agg(F.min("__w").alias("__low"), F.min_by("__id", F.struct("__w", "__id")).alias("__best"))
    rows = rows.join(best, F.col("__centre") == F.col("__g")).drop("__g")
    # shingles that many far members have stand behind the rarer ones
    far = rows.filter(F.col("__w") + F.col("__low") > (1 - similarity) * F.col("__size")).select(F.col("__centre").alias("__g"), F.col("__id").alias("__i"))
    drawn = far.withColumn("__k", F.row_number().over(Window.partitionBy("__g").orderBy(F.xxhash64("__i"), "__i"))).filter(F.col("__k") <= DRAWN).drop("__k")
    drawn = rows.join(drawn, (F.col("__centre") == F.col("__g")) & (F.col("__id") == F.col("__i"))).select("__g", F.explode(F.slice("__apart", F.lit(1), F.col("__u"))).alias("__e"))
    common = drawn.groupBy("__g", "__e").count().filter("count > 2").groupBy("__g").agg(F.collect_list("__e").alias("__common"))
    rows = rows.join(common, F.col("__centre") == F.col("__g"), "left").withColumn("__common", F.coalesce("__common", F.array().cast("array<long>")))
    beyond, lacked = F.slice("__apart", F.lit(1), F.col("__u")), F.slice("__apart", F.col("__u") + 1, F.col("__d"))
    rows = rows.withColumn("__apart", F.concat(F.array_except(beyond, "__common"), F.array_intersect(beyond, "__common"), lacked))
    # rounding errors may only lower the overlap that is asked for
    excess = F.col("__w") + F.col("__low") - (1 - similarity) * F.col("__size")
    near, whole = excess <= 1e-9, F.size("__apart")
    first = (F.col("__n") - F.ceil(similarity * F.col("__n") - 1e-9) + 1).cast("int")
    to_far = F.floor((F.col("__w") - F.col("__low")) / (1 + similarity) - 1e-9).cast("int") + 1
    to_any = F.ceil(excess / (1 + similarity) - 1e-9).cast("int")
    index = F.when(F.col("__u") >= first, first).otherwise(F.greatest("__u", whole - F.greatest(F.lit(1), to_far) + 1))
    probe = F.when(near, 0).when(F.col("__u") >= first, first).otherwise(F.greatest(F.lit(0), whole - F.greatest(F.lit(1), to_any) + 1))
    out = rows.select("__id", "__n", "__class", "__centre", "__w", "__size", F.size("__apart").alias("__whole"), F.when(near, F.col("__best")).alias("__best"), F.slice("__apart", F.lit(1), index).alias("__index"), F.slice("__apart", F.lit(1), probe).alias("__probe"))
    out = stored(out, "differences")
    discard(apart)
    return out


def stars(edges: DataFrame) -> DataFrame:
    """Edges (``__u`` above ``__v``) with the same connected components as ``__a, __b``, by large-star and small-star rounds until all form stars around the least ids.

    Least neighbours are stored before they are joined to a node's edges, so that the edges of a node with very many can be split.
    """
    now = stored(edges.select(F.greatest("__a", "__b").alias("__u"), F.least("__a", "__b").alias("__v")).filter("__u != __v").distinct(), "edges")
    while True:
        # in a star no node has both a smaller and a larger neighbour
        both = now.select(F.col("__u").alias("__node"), F.lit(1).alias("__up"), F.lit(0).alias("__down")).union(now.select("__v", F.lit(0), F.lit(1)))
        chains = both.groupBy("__node").agg(F.max("__up").alias("__up"), F.max("__down").alias("__down"), F.sum("__up").alias("__n")).filter("__up = 1 and __down = 1 or __n > 1")
        if chains.isEmpty():
            break
        # large-star: larger neighbours of each node to its least neighbour
        ways = now.union(now.select("__v", "__u"))
        least = stored(ways.groupBy("__u").agg(F.least(F.min("__v"), F.col("__u")).alias("__m")).withColumnRenamed("__u", "__w"), "least")
        large = ways.filter("__v > __u").join(least, F.col("__u") == F.col("__w")).select(F.col("__v").alias("__u"), F.col("__m").alias("__v"))
        # small-star: smaller neighbours and the node itself to its least neighbour
        small = large.withColumn("__m", F.min("__v").over(Window.partitionBy("__u")))
        moved = F.explode(F.array(F.struct(F.col("__u").alias("u"), F.col("__m").alias("v")), F.struct(F.col("__v").alias("u"), F.col("__m").alias("v")))).alias("e")
        nxt = stored(small.select(moved).select(F.col("e.u").alias("__u"), F.col("e.v").alias("__v")).filter("__u != __v").distinct(), "edges")
        discard(least, now)
        now = nxt
    return now


def labels(star: DataFrame) -> DataFrame:
    """``__id, __class`` of all nodes of ``stars``: the least id of their component."""
    members = star.select(F.col("__u").alias("__id"), F.col("__v").alias("__class"))
    return members.union(members.select("__class", "__class").distinct())


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE, small: int = SMALL_BUCKET) -> DataFrame:
    """One row per row of ``docs``: its key, ``__n``, ``__first`` (least id with its exact text) and ``__rep_id, __rep_h1, __rep_h2``, the key of
    the document that stands for its class (least id, nulls last, then text digest); the last four are null without a word."""
    signs = stored(signatures(docs, bands, rows, width), "signatures")
    texts = signs.filter("__n > 0").groupBy("__h1", "__h2").agg(F.min("__id").alias("__first"), F.first("__n").alias("__n"), F.first("__bands").alias("__bands"))
    # the stored number names the text from here on
    texts = stored(texts.withColumn("__id", F.monotonically_increasing_id()), "texts")

    # buckets may be large: their sizes are stored first, so that the join can split them
    spread = texts.select("__id", "__n", F.explode("__bands").alias("__bucket"))
    sizes = stored(spread.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"), F.min("__id").alias("__leader")).filter("__size > 1").withColumnRenamed("__bucket", "__k"), "sizes")
    members = stored(spread.join(sizes, F.col("__bucket") == F.col("__k")).drop("__k"), "buckets")
    # of copies only the row with the least id is wanted, and with the id in the key they don't meet in one task; texts and members grow
    # with the corpus: joined by shuffle at every size
    wanted = texts.select("__id", F.col("__first").alias("__id_t"), F.col("__h1").alias("__h1_t"), F.col("__h2").alias("__h2_t")).join(members.select(F.col("__id").alias("__m")).distinct(), F.col("__id") == F.col("__m"), "left_semi")
    wanted = wanted.withColumnRenamed("__id", "__node")
    texts_of = docs.select(*row_key(), "text").join(wanted.hint("merge"), same_row("", "_t")).dropDuplicates(["__id", "__h1", "__h2"]).select(F.col("__node").alias("__id"), "text")
    sets = stored(shingle_sets(texts_of, width), "sets")
    discard(sizes)

    near = (F.least("__n", "__on") >= similarity * F.greatest("__n", "__on")) & (F.col("__id") != F.col("__other"))
    pair = [F.least("__id", "__other").alias("__a"), F.greatest("__id", "__other").alias("__b")]
    other = members.select(F.col("__bucket").alias("__k"), F.col("__id").alias("__other"), F.col("__n").alias("__on"), "__size")
    few = members.filter(F.col("__size") <= small).join(other.filter(F.col("__size") <= small).drop("__size"), (F.col("__bucket") == F.col("__k")) & (F.col("__id") < F.col("__other"))).filter(near).select(*pair)

    large = members.filter(F.col("__size") > small)
    led = large.filter(F.col("__id") == F.col("__leader")).select(F.col("__bucket").alias("__k"), F.col("__id").alias("__other"), F.col("__n").alias("__on"))
    to_leader = large.join(led, F.col("__bucket") == F.col("__k")).filter(near).select(*pair)
    asked = stored(few.union(to_leader).distinct(), "pairs")
    made = [members, sets, asked]
    edges = stored(verified(asked, sets, similarity), "verified")
    ways = edges.union(edges.select("__b", "__a"))
    links = stars(edges)
    classes = labels(links)
    made += [edges, links]
    links = links.select(F.col("__u").alias("__a"), F.col("__v").alias("__b"))

    def classed(rows: DataFrame) -> DataFrame:
        of = classes.select(F.col("__id").alias("__c"), "__class")
        return rows.join(of, F.col("__id") == F.col("__c"), "left").withColumn("__class", F.coalesce("__class", "__id")).drop("__c")

    # the members of large buckets that still hold more than one class
    rows = classed(large)
    more = stored(rows.groupBy("__bucket").agg(F.min("__class").alias("__low"), F.max("__class").alias("__high")).filter("__low < __high").withColumnRenamed("__bucket", "__k"), "more")
    rows = stored(rows.join(more, F.col("__bucket") == F.col("__k")).drop("__k"), "mixed")
    made += [more, rows]
    if not rows.isEmpty():  # whatever is still in different classes, in one group per class that leads in a bucket
        degree = ways.groupBy("__a").agg(F.count(F.lit(1)).alias("__links"))
        best = F.max_by("__id", F.struct(F.coalesce("__links", F.lit(0)), -F.col("__id"))).alias("__centre")
        centres = classes.join(degree, F.col("__id") == F.col("__a"), "left").groupBy("__class").agg(best).withColumnRenamed("__class", "__c")
        leads = rows.groupBy("__bucket", "__class").agg(F.count(F.lit(1)).alias("__size")).groupBy("__bucket").agg(F.max_by("__class", F.struct("__size", -F.col("__class"))).alias("__lead"))
        home = leads.join(centres, F.col("__lead") == F.col("__c"), "left").select(F.col("__bucket").alias("__k"), F.coalesce("__centre", "__lead").alias("__centre"))
        group = stored(rows.join(home, F.col("__bucket") == F.col("__k")).select("__centre", "__id", "__n", "__class").distinct(), "group")
        made.append(group)
        centre = group.select("__centre").distinct()
        beside = ways.distinct().join(centre, F.col("__a") == F.col("__centre")).select("__centre", F.col("__b").alias("__id"))
        beside = beside.withColumn("__k", F.row_number().over(Window.partitionBy("__centre").orderBy("__id"))).filter(F.col("__k") < SAMPLE).drop("__k")
        centres = consensus(beside.union(centre.select("__centre", "__centre")), sets)
        group = differences(group, centres, sets, similarity)
        probe = group.select("__centre", "__id", "__n", "__class", "__w", "__size", "__whole", F.posexplode("__probe").alias("__at", "__element"))
        index = group.select(F.col("__centre").alias("__g"), F.col("__id").alias("__other"), F.col("__n").alias("__on"), F.col("__class").alias("__oc"), F.col("__w").alias("__ow"), F.col("__whole").alias("__all"), F.posexplode("__index").alias("__oat", "__e"))
        # no more than the elements from the first common one on can be shared
        enough = (1 + similarity) * F.least(F.col("__whole") - F.col("__at"), F.col("__all") - F.col("__oat")) >= F.col("__w") + F.col("__ow") - (1 - similarity) * F.col("__size") - 1e-9
        new = probe.join(index, (F.col("__centre") == F.col("__g")) & (F.col("__element") == F.col("__e")) & (F.col("__class") != F.col("__oc")) & enough & near).select(*pair)
        new = stored(new.distinct(), "candidates")
        made += [group, new]
        new = new.join(asked.withColumnsRenamed({"__a": "__p", "__b": "__q"}), (F.col("__a") == F.col("__p")) & (F.col("__b") == F.col("__q")), "left_anti")
        proven = group.filter("__id != __best").select("__id", "__best")
        links = links.union(verified(new, sets, similarity)).union(proven)
        links = stars(links)
        classes = labels(links)
        made.append(links)

    # the document that stands for each class
    named = classes.select(F.col("__id").alias("__c"), "__class").join(texts, F.col("__c") == F.col("__id"))
    stands = F.min(F.struct(F.col("__first").isNull().alias("no_id"), F.col("__first").alias("id"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2"))).alias("__rep")
    reps = stored(named.groupBy("__class").agg(stands).withColumnRenamed("__class", "__k"), "representatives")
    of = classes.select(F.col("__id").alias("__c"), "__class").join(reps, F.col("__class") == F.col("__k")).select("__c", "__rep")
    known = texts.join(of, F.col("__id") == F.col("__c"), "left")
    own = F.struct(F.col("__first").isNull().alias("no_id"), F.col("__first").alias("id"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2"))
    known = stored(known.select(F.col("__h1").alias("__g1"), F.col("__h2").alias("__g2"), "__first", F.coalesce("__rep", own).alias("__rep")), "known")
    discard(texts, reps, *made)
    out = signs.select("__id", "__h1", "__h2", "__n").join(known, (F.col("__h1") == F.col("__g1")) & (F.col("__h2") == F.col("__g2")), "left")
    return out.select("__id", "__h1", "__h2", "__n", "__first", F.col("__rep.id").alias("__rep_id"), F.col("__rep.h1").alias("__rep_h1"), F.col("__rep.h2").alias("__rep_h2"))


def _stays() -> Column:
    """Whether a row of ``near_classes`` stands for its class."""
    return (F.col("__n") == 0) | F.col("__id").eqNullSafe(F.col("__rep_id")) & (F.col("__h1") == F.col("__rep_h1")) & (F.col("__h2") == F.col("__rep_h2"))


def near_report(docs: DataFrame, **settings) -> DataFrame:
    """One row per row: ``doc_id, class_id`` (least id of its near-duplicate class), ``first_id`` (least id with the same text) and ``kept``.

    Texts are the same class if a chain of pairs joins them, each of similarity 0.8 or more over multisets of five-word shingles. Words
    are runs of non-space characters; a text of one to four words is one shingle. Documents without words (null, empty, blank)
    are alone in their class and kept. One document of each class is kept: that of least id, nulls last, then of least text digest. Rows
    that repeat an id with different texts are different documents; rows equal in id and text are one, kept or not together. Without
    any id in the class, ``class_id`` and ``first_id`` are null. Very long texts are read whole; an empty table gives no rows; other columns are not looked at.
    """
    out = near_classes(docs.select("doc_id", "text"), **settings)
    some = F.col("__n") > 0
    return out.select(F.col("__id").alias("doc_id"), F.when(some, F.col("__rep_id")).otherwise(F.col("__id")).alias("class_id"), F.when(some, F.col("__first")).otherwise(F.col("__id")).alias("first_id"), _stays().alias("kept"))


def near_stage(docs: DataFrame, **settings) -> DataFrame:
    """The documents that stand for their classes, whole (see ``near_report``, also on nulls and repeats); same columns."""
    gone = near_classes(docs.select("doc_id", "text"), **settings).filter(~_stays()).select("__id", "__h1", "__h2").distinct()
    gone = gone.withColumnsRenamed({"__id": "__id_g", "__h1": "__h1_g", "__h2": "__h2_g"})
    return packed(docs).join(gone, same_row("", "_g"), "left_anti").select("__row.*")
