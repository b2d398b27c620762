"""Quality rules: counts per document and cross-document line frequency, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import digest, packed, row_key, same_row, stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate of its host if at least so many documents there, and this share of them, hold it.
MIN_LINE_DOCS = 10
MIN_LINE_SHARE = 0.10
#: In the pipeline only the number of documents counts: a share would rise with the host.
STAGE_LINE_SHARE = 0.0
#: A document is depleted if more than this share of its words stood in boilerplate lines.
MAX_REMOVED_SHARE = 0.5

_SPACE = "[ \\t-\\r]"
_WORD = "[^ \\t-\\r]+"


def _normal(line: Column) -> Column:
    """Lines are compared in lower case, digits alike, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), f"{_SPACE}+", " "))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``__n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words`` (null text: zeros)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__words", F.regexp_extract_all(text, F.lit(_WORD), 0)).withColumn("__n_words", F.size("__words").cast("long"))
    out = out.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    # a window's hash and place in one number: the low bits hold the place, as many as the text needs
    out = out.withColumn("__bits", F.ceil(F.log2(F.col("__n_words") + 1)).cast("int"))
    windows = F.when(F.col("__n_words") >= 3, F.sequence(F.lit(0), F.col("__n_words").cast("int") - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(windows, lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))
    out = out.withColumn("__hash", hashes)
    packed = F.transform("__hash", lambda h, i: F.call_function("shiftleft", h, F.col("__bits")).bitwiseOR(i.cast("long")))
    out = out.withColumn("__sorted", F.sort_array(packed))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1).cast("int")
    same = lambda k: F.get("__hash", place(F.get("__sorted", k))) == F.get("__hash", place(F.get("__sorted", k - 1)))
    later = F.when(F.size("__sorted") > 1, F.sequence(F.lit(1), F.size("__sorted") - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("__met", F.filter(later, same))
    both = F.concat(F.transform("__met", lambda k: place(F.get("__sorted", k))), F.transform("__met", lambda k: place(F.get("__sorted", k - 1))))
    out = out.withColumn("__repeated", F.sort_array(both))
    # windows cover three words each; neighbours overlap
    gaps = F.aggregate(
        "__repeated",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last")),
        lambda acc, at: F.struct((acc["sum"] + F.least(F.lit(3), at - acc["last"])).alias("sum"), at.alias("last")),
        lambda acc: acc["sum"],
    )
    out = out.withColumn("__n_repeat_words", gaps)
    out = out.withColumn("__word_chars", F.aggregate("__words", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)))
    out = out.withColumn("__n_symbols", (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"))
    out = out.withColumn("__n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    return out.drop("__words", "__lines", "__bits", "__hash", "__sorted", "__met", "__repeated")


def _judged_rows(docs: DataFrame, host: str) -> DataFrame:
    """Stored, one row per row of ``docs``: its number ``__row_no``, row key, ``__host``, base counts and ``__keys``: its lines as (digest of the normal form, words).

    Every text is split and normalised once; whatever follows reads this table, which has no texts.
    """
    rows = docs.select(*row_key(), F.col(host).alias("__host"), "text")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    keys = F.coalesce(F.transform(lines, lambda x: F.struct(digest(_normal(x), seed=3).alias("key"), F.regexp_count(x, F.lit(_WORD)).alias("words"))), F.array().cast("array<struct<key:bigint,words:int>>"))
    out = base_counts(rows).withColumn("__keys", keys).withColumn("__null", F.col("text").isNull()).drop("text")
    return stored(out.withColumn("__row_no", F.monotonically_increasing_id()), "judged")


def boilerplate(rows: DataFrame, min_docs: int = MIN_LINE_DOCS, min_share: float = MIN_LINE_SHARE) -> DataFrame:
    """``__host, __key`` of the lines above the limits, from ``_judged_rows``. Copies of one text count as one document: a text that was
    collected many times makes none of its lines boilerplate."""
    texts = rows.filter("not __null").select("__host", "__h1", "__h2", "__keys")
    lines = texts.select("__host", "__h1", "__h2", F.explode(F.array_distinct(F.transform("__keys", lambda x: x["key"]))).alias("__key"))
    held = lines.distinct().groupBy("__host", "__key").agg(F.count(F.lit(1)).alias("__docs"))
    above = held.filter(F.col("__docs") >= min_docs)
    if min_share <= 0:
        return above.select("__host", "__key")
    hosts = texts.select("__host", "__h1", "__h2").distinct().groupBy(F.col("__host").alias("__h")).agg(F.count(F.lit(1)).alias("__host_docs"))
    return above.join(hosts, F.col("__host").eqNullSafe(F.col("__h"))).filter(F.col("__docs") >= min_share * F.col("__host_docs")).select("__host", "__key")


def judge(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """One row per row of ``docs``: its key, ``__host``, the base counts, ``__removed_words``, ``__gone`` (keys of removed lines), ``__base_failed`` and ``__kept``.

    Null and empty texts have no words and fail the base rules. A null host is a host of its own. Every row is judged by itself, also where
    its id is null or repeated. An empty table gives no rows; very long texts are read whole; columns of ``docs`` may have any name.
    """
    rows = _judged_rows(docs, host)
    above = stored(boilerplate(rows, **limits).withColumnsRenamed({"__host": "__h", "__key": "__k"}), "boilerplate")
    lines = rows.select("__row_no", "__host", F.explode("__keys").alias("x")).select("__row_no", "__host", F.col("x.key").alias("__key"), F.col("x.words").alias("__words"))
    hits = lines.join(above, F.col("__host").eqNullSafe(F.col("__h")) & (F.col("__key") == F.col("__k")))
    gone = hits.groupBy(F.col("__row_no").alias("__of")).agg(F.sum("__words").alias("__removed_words"), F.collect_set("__key").alias("__gone"))
    out = rows.drop("__keys").join(gone, F.col("__row_no") == F.col("__of"), "left").drop("__of").withColumn("__removed_words", F.coalesce("__removed_words", F.lit(0).cast("long")))
    out = out.withColumn("__base_failed", (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words")))
    return out.withColumn("__kept", ~F.col("__base_failed") & (F.col("__removed_words") <= MAX_REMOVED_SHARE * F.col("__n_words")))


def quality_report(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """One row per row: the base counts, ``n_removed_words``, ``base_failed`` and ``kept`` (see ``judge``)."""
    out = judge(docs.select("doc_id", "text", host), host, **limits)
    return out.select(F.col("__id").alias("doc_id"), *[F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("__removed_words").alias("n_removed_words"), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def _last_holders(judged: DataFrame) -> DataFrame:
    """``__whole``: of every removed line that no kept document of its host holds, the first depleted document with it (its row number).

    Near copies of one text deplete each other; so one of them stays.
    """
    held = judged.filter(~F.col("__base_failed") & (F.size("__gone") > 0))
    held = held.select(F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col("__row_no").alias("row")).alias("__place"), "__host", "__kept", F.explode("__gone").alias("__key"))
    lost = held.groupBy("__host", "__key").agg(F.max("__kept").alias("__any"), F.min("__place").alias("__first")).filter(~F.col("__any"))
    return lost.select(F.col("__first.row").alias("__whole")).distinct()


def quality_stage(docs: DataFrame, host: str = "source", min_share: float = STAGE_LINE_SHARE, **limits) -> DataFrame:
    """The kept documents without their boilerplate lines, and whole the depleted ones that alone hold lines (see ``_last_holders``); same columns.

    Nulls, repeated ids, empty tables and clashing names: as in ``judge``.
    """
    judged = stored(judge(docs.select("doc_id", "text", host), host, min_share=min_share, **limits).select("__id", "__h1", "__h2", "__host", "__row_no", "__gone", "__base_failed", "__kept"), "verdicts")
    stays = judged.join(_last_holders(judged), F.col("__row_no") == F.col("__whole"), "left").filter(F.col("__kept") | F.col("__whole").isNotNull())
    # rows equal in id and text have one verdict
    verdict = stays.groupBy(*[F.col(c).alias(f"{c}_v") for c in ("__id", "__h1", "__h2", "__host")]).agg(F.first(F.when(F.col("__kept"), F.col("__gone"))).alias("__gone"))
    rows = packed(docs).hint("merge")
    out = rows.join(verdict, same_row("", "_v") & F.col(f"__row.`{host}`").eqNullSafe(F.col("__host_v")))
    line_stays = lambda line: ~line.rlike("[^ \\t-\\r]") | ~F.array_contains("__gone", digest(_normal(line), seed=3))
    text = F.when(F.size("__gone") > 0, F.array_join(F.filter(F.split("__row.text", "\n"), line_stays), "\n")).otherwise(F.col("__row.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
