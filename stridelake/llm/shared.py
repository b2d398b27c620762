"""What the training-data operators share: document columns and row keys. Intermediate tables are those of ``stridelake.storage``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, new_path, shared_dir, stored

__all__ = ["by_shuffle", "digest", "discard", "new_path", "packed", "read_table", "row_key", "same_row", "shared_dir", "stored"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_shuffle(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Inner join of sides that both grow with the corpus, by shuffle at every size.

    Spark would broadcast a stored table by the size of its files, and lists and lines of near copies take up to some hundred times as much in memory.
    """
    return left.join(right.hint("merge"), on)


def digest(*cols: Column, seed: int) -> Column:
    """64-bit hash that depends on ``seed``; two seeds together identify a text."""
    return F.xxhash64(F.lit(seed), *cols)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``__id, __h1, __h2``: what tells rows apart whose id is null or repeated. Rows equal in all three are one document."""
    return [F.col(doc_id).cast("long").alias("__id"), digest(F.col(text), seed=31).alias("__h1"), digest(F.col(text), seed=37).alias("__h2")]


def same_row(a: str, b: str) -> Column:
    """Join condition of two tables whose row keys carry these suffixes (``__id`` + suffix, ...)."""
    return F.col(f"__id{a}").eqNullSafe(F.col(f"__id{b}")) & (F.col(f"__h1{a}") == F.col(f"__h1{b}")) & (F.col(f"__h2{a}") == F.col(f"__h2{b}"))


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns in the struct ``__row``, next to its row key: no column's name can clash. ``select("__row.*")`` undoes it."""
    return docs.select(F.struct("*").alias("__row"), *row_key())
