"""AGG-7: exact medians of groups of any length, by counts per value range that close in on the middle ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored

#: Values that may stand in one buffer.
LONGEST = 10_000
#: Ranges into which the values around a rank are cut in each round; their bounds come from a sketch of bounded size.
RANGES = 256
_ACCURACY = 4_000


def exact_medians(df: DataFrame, keys: list[str], value: str, name: str = "median", longest: int = LONGEST) -> DataFrame:
    """The keys with the median of ``value`` (a double; the mean of the two middle ones), as ``percentile(value, 0.5)`` has it; nulls are passed over.

    Groups of up to ``longest`` values are sorted in one buffer. In a longer one, a middle rank is looked for between two values that a sketch
    puts just below and above it; the values below, at, between and above these are counted, so the sketch may err without harm. Each round
    leaves about a hundredth of the values, and the last ``longest`` are sorted. No group is held in one task.
    """
    rows = df.select(F.struct(*keys).alias("__g"), F.col(value).cast("double").alias("__v"))
    sizes = stored(rows.groupBy("__g").agg(F.count("__v").alias("__n")).filter(F.col("__n") > longest).withColumnRenamed("__g", "__l"), "long")
    short = rows.join(sizes, F.col("__g") == F.col("__l"), "left_anti").groupBy("__g").agg(F.percentile("__v", F.lit(0.5)).alias(name))
    if sizes.isEmpty():
        discard(sizes)
        out = rows.groupBy("__g").agg(F.percentile("__v", F.lit(0.5)).alias(name))
    else:
        out = short.union(_long(rows, sizes, name, longest))
    return out.select(*[F.col("__g")[k].alias(k) for k in keys], name)


def _long(rows: DataFrame, sizes: DataFrame, name: str, longest: int) -> DataFrame:
    """``__g`` and the median of the groups in ``sizes`` (``__l, __n``)."""
    ranks = F.explode(F.array_distinct(F.array(F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)))).alias("__k")
    live = rows.filter("__v is not null").join(sizes.select("__l", ranks), F.col("__g") == F.col("__l")).select("__g", "__k", "__v")
    # per group and rank: how many values lie below the window
    state = stored(sizes.select(F.col("__l").alias("__g"), ranks, F.lit(0).cast("long").alias("__below")), "ranks")
    answers = []
    grid = [i / RANGES for i in range(RANGES + 1)]
    while True:
        sketch = live.groupBy("__g", "__k").agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", grid, _ACCURACY).alias("__q"))
        at = F.floor((F.col("__k") - F.col("__below")) * RANGES / F.col("__n")).cast("int")
        edge = lambda i: F.element_at("__q", F.greatest(F.lit(1), F.least(F.lit(RANGES + 1), i)))
        cuts = stored(state.join(sketch, ["__g", "__k"]).select(F.col("__g").alias("__h"), F.col("__k").alias("__j"), "__below", edge(at).alias("__a"), edge(at + 3).alias("__b")), "cuts")
        v, a, b = F.col("__v"), F.col("__a"), F.col("__b")
        met = live.join(cuts, (F.col("__g") == F.col("__h")) & (F.col("__k") == F.col("__j")))
        counts = met.groupBy("__g", "__k").agg(F.any_value("__below").alias("__below"), F.any_value("__a").alias("__a"), F.any_value("__b").alias("__b"), F.count_if(v < a).alias("n1"), F.count_if(v == a).alias("n2"), F.count_if((v > a) & (v < b)).alias("n3"), F.count_if((v == b) & (a < b)).alias("n4"), F.count_if(v > b).alias("n5"))
        rank = F.col("__k") - F.col("__below")
        upto = lambda n: sum((F.col(f"n{i}") for i in range(1, n + 1)), F.lit(0))
        case = F.when(rank < upto(1), 1).when(rank < upto(2), 2).when(rank < upto(3), 3).when(rank < upto(4), 4).otherwise(5)
        found = counts.withColumn("__case", case)
        found = found.select(
            "__g", "__k", F.when(F.col("__case") == 2, a).when(F.col("__case") == 4, b).alias("__answer"),
            F.when(F.col("__case") == 3, a).when(F.col("__case") == 5, b).alias("__lo"), F.when(F.col("__case") == 1, a).when(F.col("__case") == 3, b).alias("__hi"),
            (F.col("__below") + F.when(F.col("__case") == 3, upto(2)).when(F.col("__case") == 5, upto(4)).otherwise(0)).alias("__below"),
            F.when(F.col("__case") == 1, F.col("n1")).when(F.col("__case") == 3, F.col("n3")).when(F.col("__case") == 5, F.col("n5")).alias("__left"))
        found = stored(found, "windows")
        answers.append(found.filter("__answer is not null").select("__g", "__answer"))
        open_ = found.filter("__answer is null").select(F.col("__g").alias("__h"), F.col("__k").alias("__j"), "__lo", "__hi", "__below", "__left")
        inside = (F.col("__lo").isNull() | (v > F.col("__lo"))) & (F.col("__hi").isNull() | (v < F.col("__hi")))
        live = stored(live.join(open_, (F.col("__g") == F.col("__h")) & (F.col("__k") == F.col("__j"))).filter(inside).select("__g", "__k", "__v", "__below", "__left"), "window")
        few = live.filter(F.col("__left") <= longest).groupBy("__g", "__k").agg(F.sort_array(F.collect_list("__v")).alias("__all"), F.any_value("__below").alias("__below"))
        answers.append(few.select("__g", F.element_at("__all", (F.col("__k") - F.col("__below") + 1).cast("int")).alias("__answer")))
        state = open_.filter(F.col("__left") > longest).select(F.col("__h").alias("__g"), F.col("__j").alias("__k"), "__below")
        if state.isEmpty():
            break
        live = live.filter(F.col("__left") > longest).select("__g", "__k", "__v")
    every = answers[0]
    for more in answers[1:]:
        every = every.union(more)
    return every.groupBy("__g").agg((0.5 * F.min("__answer") + 0.5 * F.max("__answer")).alias(name))
