"""Sharding by bytes with Karmarkar-Karp differencing over indivisible groups of equal texts."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import digest

SHARDS = 40
OVERHEAD = 16
#: Groups above this part of an even shard are dealt one by one (there are at most SHARDS * HEAVY of them); smaller ones in lots, by hash.
HEAVY = 8
LOTS = 4096
#: Rows that are numbered together.
ROWS_PER_CELL = 200_000


def differencing(sizes: dict, shards: int) -> dict:
    """Shard of every item: the two partial partitions of largest spread are combined, largest part with smallest, until one is left."""
    heap = []
    for order, (item, size) in enumerate(sorted(sizes.items(), key=lambda x: (-x[1], x[0]))):
        heap.append((-size, order, [size] + [0] * (shards - 1), [[item]] + [[] for _ in range(shards - 1)]))
    heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, one, mine = heappop(heap)
        _, _, two, yours = heappop(heap)
        parts = sorted(((a + b, i) for i, (a, b) in enumerate(zip(one, reversed(two), strict=True))), key=lambda x: (-x[0], x[1]))
        yours = yours[::-1]
        for a, b in zip(mine, yours, strict=True):
            a.extend(b)
        total = [s for s, _ in parts]
        heappush(heap, (total[-1] - total[0], serial, total, [mine[i] for _, i in parts]))
        serial += 1
    return {item: shard for _, _, _, parts in heap for shard, part in enumerate(parts) for item in part}


def shard(docs: DataFrame, shards: int = SHARDS, lots: int = LOTS, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``bytes``: sizes (UTF-8 bytes plus 16; null text: none) of shards are near equal, and equal texts (null
    and empty count as equal) share a shard; a group larger than an even shard stands alone. Slots count from 0 without gaps in
    each shard, repeated ids included. An empty table gives no rows. What the driver sees is bounded: the lots and the heavy groups.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("__text"))
    rows = rows.select("doc_id", (F.octet_length("__text").cast("long") + OVERHEAD).alias("size"), F.crc32(F.col("__text").cast("binary")).alias("text_crc32"), digest(F.col("__text"), seed=41).alias("__h1"), digest(F.col("__text"), seed=43).alias("__h2"))
    lot = F.pmod("__h1", F.lit(lots)).cast("int")
    groups = rows.groupBy("__h1", "__h2").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    heavy = F.col("__bytes") * (shards * HEAVY) > total
    key = F.struct(F.when(heavy, F.lit(-1)).otherwise(lot).alias("lot"), F.when(heavy, F.col("__h1")).otherwise(0).alias("h1"), F.when(heavy, F.col("__h2")).otherwise(0).alias("h2"))
    items = groups.groupBy(key.alias("k")).agg(F.sum("__bytes").alias("__bytes")).select("k.*", "__bytes").collect()
    where = differencing({(r.lot, r.h1, r.h2): r["__bytes"] for r in items}, shards)
    if len(where) > lots + shards * HEAVY:
        raise ValueError("more items than the bound")
    spark = docs.sparkSession
    plan = spark.createDataFrame([(k[0], k[1], k[2], s) for k, s in where.items()], "lot int, h1 long, h2 long, shard int")
    single = F.broadcast(plan.filter("lot = -1").select(F.col("h1").alias("__s1"), F.col("h2").alias("__s2"), F.col("shard").alias("__own")))
    mass = F.broadcast(plan.filter("lot >= 0").select(F.col("lot").alias("__lot"), F.col("shard").alias("__lot_shard")))
    dealt = rows.join(single, (F.col("__h1") == F.col("__s1")) & (F.col("__h2") == F.col("__s2")), "left").join(mass, lot == F.col("__lot"), "left")
    # slots: rows are numbered in cells of a shard, and cells are offset by the rows before them
    cells = max(8, -(-n_rows // rows_per_cell))
    dealt = dealt.select("doc_id", "size", "text_crc32", F.coalesce("__own", "__lot_shard").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int").alias("__cell"))
    counts = dealt.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("shard").alias("__shard"), F.col("__cell").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    number = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy("doc_id", "text_crc32")) - 1
    out = dealt.withColumn("__number", number).join(base, (F.col("shard") == F.col("__shard")) & (F.col("__cell") == F.col("__c")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__base") + F.col("__number")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
