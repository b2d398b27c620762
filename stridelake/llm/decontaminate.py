"""Benchmark decontamination by winnowing.

From every nine neighbouring five-word grams the least hash is kept, so two texts that share thirteen words share a kept
gram inside them. Kept grams of documents and items are joined, with the eight words on both sides, and each hit is extended over the
words that agree; extensions of thirteen words or more are the shared windows. Items of fewer than thirteen words
are one window each: all grams of their length, where the documents have them, are joined whole.

Before the join, grams of documents pass a bitmap of the items' grams. Its size is fixed, so a growing benchmark only lets more grams
pass; the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import packed, row_key, same_row, stored
from .wordhash import ALNUM, GOLDEN, LOWER, mix, portions, word_hashes

WINDOW = 13
GRAM = 5
BITMAP_BITS = 22

_SALT = mix(np.arange(1, WINDOW + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` neighbouring words."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - width + 1, _SALT[width - 1])
    for j in range(width):
        out += words[j : len(words) - width + 1 + j] * _SALT[j]
    return mix(out)


def winnow(values: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least of every ``window`` neighbours (all minima, so that equal texts keep equal positions)."""
    if len(values) <= window:
        return np.flatnonzero(values == values.min()) if len(values) else np.empty(0, np.int64)
    least = values[: len(values) - window + 1].copy()
    for j in range(1, window):
        np.minimum(least, values[j : len(values) - window + 1 + j], out=least)
    # a value is kept if it is the least of a window that holds it, so the largest such least equals it
    best = np.zeros(len(values), np.uint64)
    for j in range(window):
        part = best[j : j + len(least)]
        np.maximum(part, least, out=part)
    return np.flatnonzero(best == values)


def _context(words: np.ndarray, at: int, width: int) -> bytes:
    """The words around a gram, with zeros beyond the text: WINDOW - width before it, itself, as many after it."""
    reach = WINDOW - width
    out = np.zeros(WINDOW + reach, "<u8")
    a, b = max(0, at - reach), min(len(words), at + WINDOW)
    out[a - at + reach : b - at + reach] = words[a:b]
    return out.tobytes()


def _kept(words: np.ndarray) -> np.ndarray:
    return winnow(grams(words, GRAM), WINDOW - GRAM + 1)


_ROW = "__doc long, __n long, __hits array<struct<width:int,at:long,gram:long,context:binary>>"
_HIT = pa.struct([("width", pa.int32()), ("at", pa.int64()), ("gram", pa.int64()), ("context", pa.binary())])


def fingerprints(texts: DataFrame, bitmap: np.ndarray | None, short: list[int], is_item: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` (longs), ``__doc, __n`` (words) and ``__hits`` of every text: kept grams that the bitmap lets pass, and grams of the short items' lengths."""
    shared = texts.sparkSession.sparkContext.broadcast((bitmap, short))
    schema = pa.schema([*((k, pa.int64()) for k in keep), ("__doc", pa.int64()), ("__n", pa.int64()), ("__hits", pa.list_(_HIT))])

    def passes(values: np.ndarray, bitmap: np.ndarray | None) -> np.ndarray:
        if bitmap is None:
            return np.ones(len(values), bool)
        slot = values >> np.uint64(64 - BITMAP_BITS)
        return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, short = shared.value
        for batch in batches:
            docs = batch.column("__doc")
            rows = batch.column("text").to_pylist()
            for a, b in portions([len(t or "") for t in rows]):
                words, per_doc = word_hashes(rows[a:b], ALNUM, LOWER)
                ends = np.cumsum(per_doc)
                hits: list[list] = [[] for _ in range(b - a)]
                for width in (GRAM, *[-s for s in short]):  # negative: a short item's whole length
                    size = abs(width)
                    every = grams(words, size)
                    start = np.arange(len(every))
                    own = np.searchsorted(ends, start, "right")
                    inside = start + size <= ends[own] if len(every) else np.empty(0, bool)
                    if is_item or width < 0:
                        some = np.flatnonzero(inside & passes(every, bitmap))
                    else:
                        # winnowing over the batch at once: grams across texts are out of the way
                        some = _winnowed(every, inside, own)
                        some = some[passes(every[some], bitmap)]
                    if is_item:
                        n = per_doc[own[some]]
                        some = some[(n == size)] if width < 0 else _winnowed(every, inside, own)
                        some = some[per_doc[own[some]] >= WINDOW] if width > 0 else some
                    first = ends - per_doc
                    for at in some.tolist():
                        d = int(own[at])
                        base = int(first[d])
                        context = _context(words[base : int(ends[d])], at - base, size) if width > 0 else None
                        hits[d].append({"width": width, "at": at - base, "gram": int(every[at].astype(np.int64)), "context": context})
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(a, b - a) for k in keep], docs.slice(a, b - a), pa.array(per_doc), pa.array(hits, pa.list_(_HIT))], schema=schema)

    return texts.select(*keep, "__doc", "text").mapInArrow(take, "".join(f"{k} long, " for k in keep) + _ROW)


def _winnowed(every: np.ndarray, inside: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Kept grams of each text of a batch; runs of grams inside one text are winnowed alone."""
    some = np.flatnonzero(inside)
    if not len(some):
        return some
    values, doc = every[some], own[some]
    window = WINDOW - GRAM + 1
    # texts of different length: pad by infinity between them, so that no window prefers a neighbour's gram
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    gap = window - 1
    shift = np.repeat(np.arange(len(new)) * gap, np.diff(new, append=len(doc)))
    wide = np.full(len(values) + gap * (len(new) + 1), np.iinfo(np.uint64).max)
    place = np.arange(len(values)) + shift + gap
    wide[place] = values
    kept = np.zeros(len(wide), bool)
    kept[winnow(wide, window)] = True
    return some[kept[place]]


def _item_bitmap(items: DataFrame) -> np.ndarray:
    """Fixed-size bitmap of the items' grams, set in parts and joined on the driver."""
    slots = items.select(F.explode("__hits").alias("h")).select(F.shiftrightunsigned("h.gram", 64 - BITMAP_BITS).alias("s")).distinct()
    bits = slots.groupBy(F.floor(F.col("s") / (1 << 12)).alias("page")).agg(F.collect_set((F.col("s") % (1 << 12)).cast("int")).alias("set"))
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for page, some in bits.toLocalIterator():  # at most 2^(BITMAP_BITS - 12) rows of at most 2^12 numbers
        at = np.array(some, np.int64) + page * (1 << 12)
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def extended(joined: DataFrame) -> DataFrame:
    """``__doc, __item, __from, __to``: the words of each document that a hit covers once extended, where they make a window."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, at = batch.column("__width").to_numpy(), batch.column("__at").to_numpy()
            begin, end, good = at.copy(), at.copy(), np.zeros(len(at), bool)
            for k, (w, x, y) in enumerate(zip(width.tolist(), batch.column("__x"), batch.column("__y"), strict=True)):
                if w < 0:  # a short item, met as a whole
                    good[k], end[k] = True, at[k] - w
                    continue
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                same = (a == b) & (a != 0)
                reach = WINDOW - w
                left = int(np.argmin(same[:reach][::-1])) if not same[:reach].all() else reach
                tail = same[reach:]
                right = int(np.argmin(tail)) if not tail.all() else len(tail)
                good[k] = left + right >= WINDOW and right >= w
                begin[k], end[k] = at[k] - left, at[k] + right
            out = pa.RecordBatch.from_arrays([batch.column("__doc"), batch.column("__item"), pa.array(begin), pa.array(end)], names=["__doc", "__item", "__from", "__to"])
            yield out.filter(pa.array(good))

    return joined.select("__doc", "__item", "__width", "__at", "__x", "__y").mapInArrow(extend, "__doc long, __item long, __from long, __to long")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Row key, ``__n_words, __n_hit, __items`` (sorted as strings) of every row of ``docs``."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("__doc"), "text").filter("text is not null")
    lengths = fingerprints(bench, None, [], True).filter(F.col("__n").between(1, WINDOW - 1)).select("__n").distinct()
    short = sorted(r[0] for r in lengths.collect())  # at most twelve numbers
    items = stored(fingerprints(bench, None, short, True), "items")
    bitmap = _item_bitmap(items)
    # hits belong to rows: the stored number of a row tells rows apart whose id is null or repeated
    rows = docs.select(*row_key(), "text").withColumn("__doc", F.monotonically_increasing_id())
    prints = stored(fingerprints(rows, bitmap, short, False, ("__id", "__h1", "__h2")), "prints")

    def opened(table: DataFrame, doc: str, context: str) -> DataFrame:
        return table.select(F.col("__doc").alias(doc), F.explode("__hits").alias("h")).select(doc, F.col("h.width").alias("__width"), F.col("h.at").alias("__at"), F.col("h.gram").alias("__gram"), F.col("h.context").alias(context))

    item_hits = opened(items, "__item", "__y").select("__item", F.col("__width").alias("__w"), F.col("__gram").alias("__g"), "__y").distinct()
    joined = opened(prints, "__doc", "__x").join(item_hits, (F.col("__gram") == F.col("__g")) & (F.col("__width") == F.col("__w")))
    spans = stored(extended(joined).distinct(), "spans")
    # cover of each document: a stretch adds what lies beyond all earlier ones
    inside = spans.groupBy("__doc", "__from").agg(F.max("__to").alias("__to"))
    order = Window.partitionBy("__doc").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("__to").over(order), F.lit(0).cast("long"))
    cover = inside.select("__doc", F.greatest(F.lit(0).cast("long"), F.col("__to") - F.greatest("__from", reach)).alias("__new")).groupBy("__doc").agg(F.sum("__new").alias("__n_hit"))
    found = spans.select("__doc", F.col("__item").cast("string").alias("__item")).distinct().groupBy("__doc").agg(F.array_sort(F.collect_list("__item")).alias("__items"))
    hits = cover.join(found.withColumnRenamed("__doc", "__d"), F.col("__doc") == F.col("__d")).select(F.col("__doc").alias("__of"), "__n_hit", "__items")
    out = prints.join(hits, F.col("__doc") == F.col("__of"), "left")
    return out.select("__id", "__h1", "__h2", F.col("__n").alias("__n_words"), F.coalesce("__n_hit", F.lit(0).cast("long")).alias("__n_hit"), F.coalesce("__items", F.array().cast("array<string>")).alias("__items"))


def _contaminated() -> Column:
    return (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Words are runs of ASCII letters (A-Z lowered), digits and characters beyond ASCII. A window is thirteen neighbouring words of an
    item, or all words of an item that has fewer; every word of a document inside an occurrence of a window is hit. Contaminated: at
    least one word in twenty is hit. Null and empty texts have no words; items without words have no window. Every row has hits of its own,
    also where its id is null or repeated; repeated items count by their id. An empty benchmark hits nothing, an empty table gives no rows. Very long texts are read whole.
    """
    out = contamination(docs, benchmark)
    return out.select(F.col("__id").alias("doc_id"), F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), _contaminated().alias("contaminated"))


def decontamination_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated (see ``contamination_report``, also on nulls and repeats); same columns, of any name."""
    gone = contamination(docs.select("doc_id", "text"), benchmark).filter(_contaminated()).select("__id", "__h1", "__h2").distinct()
    gone = gone.withColumnsRenamed({"__id": "__id_g", "__h1": "__h1_g", "__h2": "__h2_g"})
    return packed(docs).join(gone, same_row("", "_g"), "left_anti").select("__row.*")
