"""Streams STR-1 to STR-3: the weekly batches as Structured Streaming.

Micro-batches are written with the token ``stream-number``, so a batch that is retried after a crash counts once. ``stream`` names a checkpoint: one name
for each checkpoint folder, another one for a stream that begins anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from .. import sources
from ..sources import sums
from ..storage import discard, stored


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once_per_id(stream: DataFrame, id_col: str, life: str = "8 days") -> DataFrame:
    """STR-1: each id once within ``life`` of its arrival. The state forgets an id by the time that it came, not by the time that the row is about, so a
    row is never too late; repeats after that are left to the sink below."""
    return stream.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", life).dropDuplicatesWithinWatermark([id_col]).drop("__arrived")


def append_unseen(store: str, id_col: str, order: list | None = None, stream: str | None = None):
    """STR-1: a ``foreachBatch`` function that appends the ids the store lacks, however late; a repeated batch adds nothing. Rows without an id are left out;
    of rows with the same id the first in ``order`` counts (by default that of all columns). Of the store only states that can hold an id of the batch are
    read (``sources.unseen_ids``). If another writer adds a state meanwhile, the batch is compared with that, too."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():  # a trigger that only moves the watermark
            return
        # read more than once below, so the state of the stream is asked once
        fresh = stored(op.first_per(batch.filter(F.col(id_col).isNotNull()), [id_col], order or batch.columns), "batch")
        try:
            while True:
                at = sources.newest(spark, store) or ""
                try:
                    sources.append_table(sources.unseen_ids(fresh, store, f"{store}-index", id_col), store, token=f"{stream}-{number}" if stream else None, expect=at)
                    return
                except sources.Conflict:
                    continue
        finally:
            discard(fresh)

    return write


def week_start(ts: str):
    """The Monday of a time's week (the epoch was a Thursday)."""
    return F.window(ts, "7 days", startTime="4 days")["start"]


def weekly(stream: DataFrame, key: str, ts: str, value: str, delay: str = "8 days") -> DataFrame:
    """STR-2: totals of Monday-aligned weeks. In a stream, rows later than ``delay`` are dropped; ``add_weekly`` keeps them."""
    week = F.window(ts, "7 days", startTime="4 days")
    return stream.withWatermark(ts, delay).groupBy(key, week.alias("week")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(key, F.col("week.start").alias("week_start"), "total", "n")


def add_weekly(root: str, key: str, ts: str, value: str, stream: str):
    """STR-2: a ``foreachBatch`` function that adds a batch to the totals of its weeks, be they long past. Rows without a time are left out."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.filter(F.col(ts).isNotNull()).select(F.col(key), week_start(ts).alias("week_start"), F.col(value).alias("total"))
        sums.add_sums(rows, root, [key, "week_start"], ["total"], f"{stream}-{number}")
        sums.compact(batch.sparkSession, root, lambda at: weekly_totals(batch.sparkSession, root, key, at), key)

    return write


def weekly_totals(spark: SparkSession, root: str, key: str, version: str | None = None) -> DataFrame:
    """STR-2: the totals that ``add_weekly`` keeps: those of ``weekly`` over all rows so far, in whatever order they came."""
    return sums.read_sums(spark, root, [key, "week_start"], ["total"], version=version)


def refresh_metadata(totals: str, metadata: str, key: str, weeks: int, stream: str):
    """STR-3: a ``foreachBatch`` function: the batch's activities (``key, type, km, minutes``) are added to the athletes' sums in ``totals``, and the metrics of the
    athletes in the batch, over all their activities, become their rows in ``metadata``. No earlier activity is read again, and no row of
    other athletes is written. ``metadata_rows`` reads the result."""
    keys, values = [key, "type"], ["km", "minutes"]

    def write(batch: DataFrame, number: int) -> None:
        spark, token = batch.sparkSession, f"{stream}-{number}"
        sums.add_sums(batch, totals, keys, values, token)
        now = sums.read_sums(spark, totals, keys, values, of=batch)
        sums.put_rows(op.training_metrics(now, weeks, athlete=key), metadata, key, token)
        sums.compact(spark, totals, lambda at: sums.read_sums(spark, totals, keys, values, version=at), key)
        sums.compact(spark, metadata, lambda at: sums.latest_rows(spark, metadata, key, version=at), key)

    return write


def metadata_rows(spark: SparkSession, metadata: str, key: str) -> DataFrame:
    """STR-3: one row per athlete, the last that was written."""
    return sums.latest_rows(spark, metadata, key)
