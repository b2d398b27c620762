"""FLT-11: names that contain a text, found in posting lists of trigrams instead of a scan of all names.

The index is a stored table of one row per name and trigram, sorted by trigram, so a reader takes only the row groups of the trigrams in question. Lists stay
rows and are intersected by counting, so a trigram of very many names is no single row or task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search_names
from .states import append_table, load_table


def _grams(name: str):
    low = F.lower(F.col(name))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))


def add_names(df: DataFrame, root: str, column: str, key: str, token: str | None = None) -> str:
    """Adds the names of ``df`` (ids in ``key``) to the index; a batch with a known token is not added again. Names of less than three letters
    and null ones have no trigrams; searches for three letters and more cannot find them anyway."""
    names = df.select(F.col(key).alias("key"), F.col(column).alias("name"))
    posts = names.filter(F.length("name") >= 3).filter(F.length(F.lower("name")) >= 3).select(F.explode(_grams("name")).alias("gram"), "key", "name")
    return append_table(posts.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key"), root, token=token)


def posting_rows(spark: SparkSession, root: str, text: str) -> DataFrame:
    """``key, name`` of the names that hold all trigrams of the text (three letters or more), in whatever order."""
    low = text.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    posts = load_table(spark, root).filter(F.col("gram").isin(grams)).distinct()
    return posts.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("key", "name")


def search_indexed(df: DataFrame, root: str, column: str, key: str, text: str, n: int = 10) -> DataFrame:
    """FLT-11: what ``search_names(df, column, text, n, key)`` gives, if ``add_names`` has had all rows of ``df``: the first ``n`` names that contain the text,
    whatever the case. Texts of less than three letters have no trigram and scan the names."""
    if len(text.lower()) < 3:
        return search_names(df, column, text, n, key)
    found = posting_rows(df.sparkSession, root, text).filter(F.contains(F.lower("name"), F.lit(text.lower())))
    first = [r.key for r in found.orderBy("name", "key").limit(n).collect()]  # n keys
    return df.filter(F.col(key).isin(first)).orderBy(column, key).limit(n)
