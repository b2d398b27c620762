"""JN-9, JOB-3: which ids a stored table knows, without reading all of it.

Each state of the table has a Bloom filter and its ids. The filter is cut into blocks of 4,096 bits, an id sets ``HASHES`` bits of one block, so filters are
built by a grouping and asked by a join, whatever their size. Only the ids of states that can hold an id of the batch are read,
and of these only the blocks in question count. All sides of the joins grow with the batch or the table, so they are joined by shuffle at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .states import append_table, parts, tokens

BITS = 4_096
HASHES = 8
#: Ids per block: 16 bits for each, so that about one of 2,000 ids is taken for known before its state is read.
PER_BLOCK = 256


def _spot(id_col: str, i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), F.col(id_col)), F.lit(BITS)).cast("int")


def _block(id_col: str, blocks) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), F.col(id_col)), blocks)


def add_to_index(spark: SparkSession, root: str, index: str, id_col: str) -> None:
    """Adds the states of the table ``root`` that ``index`` lacks. A retried call, or two at once, add each state once."""
    done = tokens(spark, f"{index}/filters"), tokens(spark, f"{index}/ids")
    for state in parts(spark, root):
        if state in done[0] and state in done[1]:
            continue
        ids = spark.read.parquet(f"{root}/{state}").select(F.col(f"`{id_col}`").alias("id")).filter("id is not null")
        blocks = max(1, -(-ids.count() // PER_BLOCK))
        dealt = ids.withColumn("block", _block("id", F.lit(blocks)))
        append_table(dealt.repartition("block").sortWithinPartitions("block"), f"{index}/ids", token=state)
        bits = dealt.select("block", F.explode(F.array(*[_spot("id", i) for i in range(HASHES)])).alias("spot"))
        filters = bits.groupBy("block").agg(F.substring(F.bitmap_construct_agg("spot"), 1, BITS // 8).alias("bits"))
        append_table(filters.select(F.lit(state).alias("state"), F.lit(blocks).alias("blocks"), "block", "bits"), f"{index}/filters", token=state)


def _set(bits: str, spot: Column) -> Column:
    """Whether a bit of a bitmap is 1."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("long"), spot % 8) == 1


def possible(batch: DataFrame, root: str, index: str, id_col: str) -> DataFrame:
    """``id, state, block`` of all states of the table that may hold an id of the batch; no state that does is missing."""
    spark = batch.sparkSession
    states, where = parts(spark, root), tokens(spark, f"{index}/filters")
    missing = [s for s in states if s not in where]
    if missing:
        raise ValueError(f"not in the index yet: {missing}")
    filters = spark.read.parquet(*[f"{index}/filters/{where[s]}" for s in states])
    # one row per state; a block of a state is met by the ids that hash to it
    sizes = filters.groupBy("state").agg(F.max("blocks").alias("n"))
    ids = batch.select(F.col(f"`{id_col}`").alias("id")).filter("id is not null").distinct()
    of = F.explode(F.array(*[F.struct(F.lit(r.state).alias("s"), F.lit(r.n).alias("n")) for r in sizes.collect()])).alias("__of")
    asked = ids.select("id", of).select("id", F.col("__of.s").alias("__s"), _block("id", F.col("__of.n")).alias("__b"))
    met = asked.join(filters.hint("merge"), (F.col("__s") == F.col("state")) & (F.col("__b") == F.col("block")))
    for i in range(HASHES):
        met = met.filter(_set("bits", _spot("id", i)))
    return met.select("id", "state", "block")


def known_ids(batch: DataFrame, root: str, index: str, id_col: str) -> tuple[DataFrame, list[str]]:
    """The ids of the batch that the table holds, and the states whose ids are read for that."""
    spark = batch.sparkSession
    maybe = stored(possible(batch, root, index, id_col), "possible")
    read = sorted(r.state for r in maybe.select("state").distinct().collect())  # state names only
    if not read:
        return spark.createDataFrame([], maybe.select("id").schema), []
    where = tokens(spark, f"{index}/ids")
    ids = spark.read.parquet(*[f"{index}/ids/{where[s]}" for s in read]).select("id")
    return ids.join(maybe.select("id").distinct().hint("merge"), "id", "left_semi"), read


def unseen_ids(batch: DataFrame, root: str, index: str, id_col: str) -> DataFrame:
    """The rows of the batch whose id the table lacks; rows without an id count as unseen, as in an anti-join."""
    if not parts(batch.sparkSession, root):
        return batch
    add_to_index(batch.sparkSession, root, index, id_col)
    known, _ = known_ids(batch, root, index, id_col)
    return batch.join(known.select(F.col("id").alias("__known")).hint("merge"), F.col(f"`{id_col}`") == F.col("__known"), "left_anti")
