"""Tables of partial sums, and tables of rows by key: a batch adds its own rows, whatever is stored before.

The table of partial sums holds, for each batch, one row per key of that batch; the sums of a key are the sums of its rows, so batches may come in any
order, and a batch with a token counts once. Rows are dealt by a hash of the first key into ``bucket``, by which files are
sorted and a reader of some keys skips the rest. ``compact`` puts many small states together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .states import Conflict, append_table, load_table, newest, parts, write_table

BUCKETS = 256
#: States that readers put together before they are written as one.
MOST_STATES = 32


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("bucket", _bucket(key)).repartition("bucket").sortWithinPartitions("bucket", key)


def partial_sums(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """One row per key: its sums and ``n``, the number of rows; of rows that are partial sums themselves their ``n`` is added up."""
    n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], n.alias("n"))


def add_sums(rows: DataFrame, root: str, keys: list[str], sums: list[str], token: str) -> str:
    """Adds a batch; one with a known token is not added again. The work is in proportion to the batch."""
    return append_table(_dealt(partial_sums(rows.select(*keys, *sums), keys, sums), keys[0]), root, token=token)


def _only(rows: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """The rows whose key is in ``of``; buckets of which it has none are not read (their numbers, ``BUCKETS`` at most, go to the driver)."""
    wanted = of.select(F.col(key).alias("__w")).distinct()
    touched = [r[0] for r in wanted.select(_bucket("__w")).distinct().collect()]
    return rows.filter(F.col("bucket").isin(touched)).join(wanted, F.col(key).eqNullSafe(F.col("__w")), "left_semi")


def read_sums(spark: SparkSession, root: str, keys: list[str], sums: list[str], of: DataFrame | None = None, version: str | None = None) -> DataFrame:
    """The sums of all keys, or of those whose first part is in ``of``."""
    rows = load_table(spark, root, version)
    return partial_sums(rows if of is None else _only(rows, keys[0], of), keys, sums)


def put_rows(rows: DataFrame, root: str, key: str, token: str | None = None) -> str:
    """Adds rows, at most one per key; they stand for earlier ones of the same key."""
    return append_table(_dealt(rows, key), root, token=token)


def latest_rows(spark: SparkSession, root: str, key: str, of: DataFrame | None = None, version: str | None = None) -> DataFrame:
    """The last row of every key, or of the keys in ``of``: a partial aggregate, so no key's rows meet before they are few."""
    rows = load_table(spark, root, version).withColumn("__state", F.regexp_extract("_metadata.file_path", r"/(s=\d+)/", 1))
    rows = rows if of is None else _only(rows, key, of)
    rest = [c for c in rows.columns if c not in (key, "bucket", "__state")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "__state").alias("__row")).select(key, "__row.*")


def compact(spark: SparkSession, root: str, current, key: str, most: int = MOST_STATES) -> bool:
    """Once the table has more than ``most`` states, writes what ``current(version)`` makes of them as one; if a batch came meanwhile, a later call does it."""
    at = newest(spark, root)
    if at is None or len(parts(spark, root, at)) <= most:
        return False
    try:
        write_table(_dealt(current(at), key), root, expect=at)
    except Conflict:
        return False
    return True
