"""DataFrame operators: projections, filters, joins, aggregations, windows, orders, sets and data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import finite, match_key, pace, upper_name
from ..storage import stored
from .medians import exact_medians

# -- projections ---------------------------------------------------------------------------------------------


def select_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """PRJ-1: the contract's columns in its order."""
    return df.select(*[F.col(f"`{f.name}`") for f in schema])


def with_literals(df: DataFrame, **columns) -> DataFrame:
    """PRJ-2."""
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def conform(df: DataFrame, schema: T.StructType, defaults: bool = True) -> DataFrame:
    """PRJ-6: missing columns added, all cast and ordered; null numbers become 0 and null texts '' if ``defaults``."""
    have = set(df.columns)

    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`") if f.name in have else F.lit(None)
        kind = f.dataType
        if isinstance(kind, T.IntegralType):  # ids come as "101.0" too
            c = c.try_cast("double").try_cast(kind) if dict(df.dtypes).get(f.name) == "string" else c.try_cast(kind)
        else:
            c = finite(c.try_cast(kind)) if isinstance(kind, T.DoubleType) else c.try_cast(kind)
        if defaults and isinstance(kind, T.NumericType):
            c = F.coalesce(c, F.lit(0).cast(kind))
        elif defaults and isinstance(kind, T.StringType):
            c = F.coalesce(c, F.lit(""))
        return c.alias(f.name)

    return df.select(*[column(f) for f in schema])


def _dealt(df: DataFrame, order: list) -> DataFrame:
    """``df`` in ranges of ``order``, stored once in the shared folder with each row's range ``__part`` and its ``__place`` in it.

    The ranges come from a sample, so a plan that dealt the rows twice could deal them differently; the stored table is read twice instead.
    """
    place = F.monotonically_increasing_id() % F.lit(1 << 33)
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__place": place}), "dealt")


def with_serial(df: DataFrame, order_by: list, start: int = 0, name: str = "serial") -> DataFrame:
    """PRJ-7: consecutive numbers after ``start`` in the given order (columns or names), without moving all rows to one task.

    Each stored range is numbered alone and offset by the rows before it; there is one offset per range, so they can be broadcast.
    """
    dealt = _dealt(df, order_by)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = dealt.join(F.broadcast(offsets), F.col("__part") == F.col("__p"), "left")
    return joined.withColumn(name, F.col("__before") + F.col("__place") + 1 + start).drop("__part", "__place", "__p", "__before")


def chunk_ids(df: DataFrame, id_col: str, size: int = 60) -> DataFrame:
    """PRJ-8: sorted ids in chunks of ``size``."""
    numbered = with_serial(df.select(id_col), [id_col])
    return numbered.groupBy(F.floor((F.col("serial") - 1) / size).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))


def export_fill(df: DataFrame, fills: dict) -> DataFrame:
    """PRJ-11."""
    return df.na.fill(fills)


# -- filters -------------------------------------------------------------------------------------------------


def min_score(df: DataFrame, score: str, cutoff: float = 1100) -> DataFrame:
    """FLT-1."""
    return df.filter(F.col(score) >= cutoff)


def take_while_at_least(df: DataFrame, group: str, order: list[str], score: str, cutoff: float) -> DataFrame:
    """FLT-2: rows of each group up to the first below the cutoff, in ascending ``order``; unreadable scores are passed over.

    The first low row of a group is a partial aggregate, so no task has to sort a long list. Of rows equal in ``order`` to it none stays.
    """
    value, place = F.col(score).try_cast("double"), F.struct(*order)
    stops = df.filter(value < cutoff).groupBy(F.col(group).alias("__g")).agg(F.min(place).alias("__stop"))
    kept = df.filter(value >= cutoff).join(stops, F.col(group).eqNullSafe(F.col("__g")), "left")
    return kept.filter(F.col("__stop").isNull() | (place < F.col("__stop"))).drop("__g", "__stop")


def keep_ids(df: DataFrame, column: str, ids: list) -> DataFrame:
    """FLT-3: membership in a short list; use ``semi`` for a table of ids."""
    return df.filter(F.col(column).isin(ids))


def in_weeks(df: DataFrame, ts: str, start: str, weeks: int) -> DataFrame:
    """FLT-4: half-open window of weeks."""
    first = F.to_timestamp(F.lit(start))
    return df.filter((F.col(ts) >= first) & (F.col(ts) < first + F.make_dt_interval(F.lit(7 * weeks))))


def before(df: DataFrame, day: str, cutoff: str) -> DataFrame:
    """FLT-5."""
    return df.filter(F.col(day) < F.to_timestamp(F.lit(cutoff)))


def outdoor_only(df: DataFrame, location: str = "location") -> DataFrame:
    """FLT-6: without ``(i)`` in the location; unknown locations stay."""
    return df.filter(F.coalesce(~F.col(location).rlike(r"(?i)\(i\)"), F.lit(True)))


def in_event(df: DataFrame, event: str, events: str = "events") -> DataFrame:
    """FLT-7."""
    return df.filter(F.array_contains(events, event))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """FLT-8."""
    return df.dropna(subset=list(columns))


def where_state(df: DataFrame, column: str, value) -> DataFrame:
    """FLT-9."""
    return df.filter(F.col(column) == value)


def find_by_name(df: DataFrame, column: str, name: str) -> DataFrame:
    """FLT-10: exact but for case and outer spaces."""
    return df.filter(F.lower(F.trim(column)) == name.strip().lower())


def search_names(df: DataFrame, column: str, text: str, n: int = 10, ties: str | None = None) -> DataFrame:
    """FLT-11: first ``n`` names that contain the text, whatever the case."""
    return df.filter(F.contains(F.lower(column), F.lit(text.lower()))).orderBy(column, *([ties] if ties else [])).limit(n)


def match_target(df: DataFrame, actual: str, target: str) -> DataFrame:
    """FLT-12."""
    return df.filter(F.lower(F.trim(actual)) == F.lower(F.trim(target)))


def unmatched(df: DataFrame, column: str) -> DataFrame:
    """FLT-13."""
    return df.filter(F.col(column).isNull())


# -- joins ---------------------------------------------------------------------------------------------------
# Lookup sides are left to adaptive execution: it broadcasts what it has measured to be small.


def attach_results(metrics: DataFrame, results: DataFrame, on: str) -> DataFrame:
    """JN-1."""
    return metrics.join(results, on, "left")


def entrants(perf: DataFrame, roster: DataFrame, perf_name: str, roster_name: str, nat: str = "nat") -> DataFrame:
    """JN-2: inner join on upper-cased names; both nations are kept under their own names."""
    left = perf.withColumn("__key", upper_name(F.col(perf_name))).withColumnRenamed(nat, f"{nat}_perf")
    right = roster.withColumn("__rkey", upper_name(F.col(roster_name))).withColumnRenamed(nat, f"{nat}_roster")
    return left.join(right, F.col("__key") == F.col("__rkey")).drop("__key", "__rkey")


def keep_pairs(df: DataFrame, pairs: DataFrame, on: list[str]) -> DataFrame:
    """JN-3."""
    return df.join(pairs.select(*on).distinct(), on)


def compare_scoreboards(a: DataFrame, b: DataFrame, on: str = "event") -> DataFrame:
    """JN-4."""
    return a.join(b, on, "full")


def with_coordinates(df: DataFrame, coords: DataFrame, on: str = "nat", how: str = "left") -> DataFrame:
    """JN-5."""
    return df.join(coords, on, how)


def assign_ids(df: DataFrame, mapping: DataFrame, name: str, id_col: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """JN-6: id of each name (the last of several wins, 0 if none), and the names without one."""
    last = mapping.groupBy(match_key(F.col(name)).alias("__m")).agg(F.max_by(id_col, seq).alias("__id"))
    joined = df.withColumn("__k", match_key(F.col(name))).join(last, F.col("__k") == F.col("__m"), "left")
    missing = unmatched(joined, "__id").select(name).distinct()
    return joined.withColumn("assigned_id", F.coalesce("__id", F.lit(0))).drop("__k", "__m", "__id"), missing


def link_first_match(df: DataFrame, meta: DataFrame, key: str, seq: str, values: list[str], created: str, today) -> DataFrame:
    """JN-7: values of the first match; rows created today get 0, unmatched rows null."""
    first = meta.groupBy(F.col(key).alias("__m")).agg(*[F.min_by(v, seq).alias(f"__{v}") for v in values])
    joined = df.join(first, F.col(key) == F.col("__m"), "left")
    return joined.select(*[F.col(c) for c in df.columns], *[F.when(F.col(created) == today, 0).otherwise(F.col(f"__{v}")).alias(v) for v in values])


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """JN-8."""
    return df.join(keys, on, "left_semi")


def unseen(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """JN-9: rows whose keys are not known yet; null keys never are (the ingest drops them first)."""
    return df.join(known, on, "left_anti")


def update_from(old: DataFrame, new: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """JN-10: matching rows take the new values where there are any."""
    fresh = new.select(F.col(on).alias("__on"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = old.join(fresh, F.col(on) == F.col("__on"), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def rank_lookup(df: DataFrame, ranked: DataFrame, keys: list[str], rank: str = "rank", name: str = "found_rank") -> DataFrame:
    """JN-11: first position in another list, null if absent."""
    first = ranked.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(rank).alias(name))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    return df.join(first, on, "left").drop(*[f"__{k}" for k in keys])


# -- aggregations --------------------------------------------------------------------------------------------

TYPES = ("Run", "Ride", "Swim", "Other")


def totals_by_type(df: DataFrame, athlete: str = "athlete_id", kind: str = "type", km: str = "km", minutes: str = "minutes") -> DataFrame:
    """AGG-1."""
    return df.groupBy(athlete, kind).agg(F.coalesce(F.sum(km), F.lit(0.0)).alias("total_km"), F.coalesce(F.sum(minutes), F.lit(0.0)).alias("total_minutes"))


def pivot_types(df: DataFrame, types: tuple[str, ...] = TYPES, athlete: str = "athlete_id", kind: str = "type", value: str = "total_km") -> DataFrame:
    """AGG-2: one column per type, 0 where there is none."""
    return df.groupBy(athlete).pivot(kind, list(types)).agg(F.sum(value)).na.fill(0.0)


def training_metrics(df: DataFrame, weeks: int, round_to: int | None = 2, athlete: str = "athlete_id", kind: str = "type", km: str = "km", minutes: str = "minutes") -> DataFrame:
    """AGG-3 (with AGG-1 and AGG-2 in one pass): run distance, hours and pace, hours of other types."""
    total = lambda t, c: F.coalesce(F.sum(F.when(F.col(kind) == t, F.col(c))), F.lit(0.0))
    rounded = lambda c: c if round_to is None else F.round(c, round_to)
    sums = df.groupBy(athlete).agg(total("Run", km).alias("run_km"), *[total(t, minutes).alias(f"m_{t}") for t in TYPES])
    columns = {
        "total_run_km": F.col("run_km"),
        "avg_weekly_run_km": F.col("run_km") / weeks,
        "total_run_hours": F.col("m_Run") / 60,
        "avg_weekly_run_hours": F.col("m_Run") / 60 / weeks,
        "total_ride_hours": F.col("m_Ride") / 60,
        "total_swim_hours": F.col("m_Swim") / 60,
        "total_other_hours": F.col("m_Other") / 60,
        "avg_run_pace": pace(F.col("m_Run"), F.col("run_km")),
    }
    return sums.select(athlete, *[rounded(c).alias(n) for n, c in columns.items()])


def _in_order(value: str, seq: str) -> Column:
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v")))), lambda x: x["v"]))


def summarise_results(perf: DataFrame, athlete: str, nat: str, gender: str, mark: str, discipline: str, seq: str) -> DataFrame:
    """AGG-4: first nation and gender, distinct marks and disciplines as first seen, number of results."""
    return perf.groupBy(athlete).agg(F.min_by(nat, seq).alias("nat"), F.min_by(gender, seq).alias("gender"), F.array_join(_in_order(mark, seq), "|").alias("marks"), F.array_join(_in_order(discipline, seq), "|").alias("disciplines"), F.count(F.lit(1)).alias("n_events"))


def suspicious_pace(df: DataFrame, keys: list[str], value: str, lo: float = 4.0, hi: float = 5.0) -> DataFrame:
    """AGG-5, QLT-2: groups whose mean lies in [lo, hi)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("avg_pace")).filter((F.col("avg_pace") >= lo) & (F.col("avg_pace") < hi))


def keys_in_many(df: DataFrame, key: str, dim: str) -> DataFrame:
    """AGG-6."""
    return df.groupBy(key).agg(F.countDistinct(dim).alias("n")).filter("n > 1")


def _exact_moments(value: Column) -> tuple[Column, Column]:
    """``std`` and ``mean`` of a group. Sums of doubles depend on the order in which rows meet, so that groups of equal values would be ranked by rounding errors; values
    of at most six decimals are therefore added up as decimals, which is exact. Groups with other values, or beyond the decimals, have Spark's own figures."""
    number = value.try_cast("decimal(18,6)")
    n = F.count(value)
    total, squares = F.try_sum(number).try_cast("decimal(18,6)"), F.try_sum(number * number).try_cast("decimal(25,12)")
    exact = F.count_if(number.cast("double") == value.cast("double")) == n
    # (n * squares - total * total) / (n * (n - 1)) is the variance; its numerator has no rounding
    spread = F.try_subtract(n.try_cast("decimal(12,0)") * squares, (total * total).try_cast("decimal(38,12)"))
    std = F.when(n > 1, F.sqrt(F.try_divide(spread.cast("double"), n.cast("double") * (n - 1).cast("double"))))
    mean = F.try_divide(total.cast("double"), n.cast("double"))
    return F.when(exact & spread.isNotNull(), std).otherwise(F.stddev_samp(value)).alias("std"), F.when(exact & total.isNotNull(), mean).otherwise(F.avg(value)).alias("mean")


def consistency(df: DataFrame, key: str, value: str, exact: bool = True, longest: int | None = None) -> DataFrame:
    """AGG-7: share of weeks with a distance, spread, median to mean, maximum to median, weeks without data.

    Over the weeks with a distance; with none of them the spread is infinite and the ratios 0. ``exact`` medians
    hold a group's values (at most 53 weeks); else they are approximate. With ``longest`` they are exact, and a group of more values is never held in one
    buffer (``exact_medians``). Groups of equal values have equal figures in whatever order their rows come (``_exact_moments``).
    """
    valid = F.when(F.col(value) > 0, F.col(value))
    median = F.lit(None).cast("double") if longest else F.percentile(valid, F.lit(0.5)) if exact else F.percentile_approx(valid, F.lit(0.5))
    base = df.groupBy(key).agg(F.count(F.lit(1)).alias("weeks"), F.count(valid).alias("valid"), *_exact_moments(valid), median.alias("median"), F.max(valid).alias("top"))
    if longest:
        medians = exact_medians(df.select(F.col(key).alias("__key"), valid.alias("__value")), ["__key"], "__value", "median", longest)
        base = base.drop("median").join(medians, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    none = F.col("valid") == 0
    return base.select(
        key,
        (F.col("valid") * 100.0 / F.col("weeks")).alias("consistency_pct"),
        F.when(none, float("inf")).otherwise(F.col("std")).alias("std_dev"),
        F.when(none, 0.0).otherwise(F.try_divide("median", "mean")).alias("median_to_mean"),
        F.when(none, 0.0).otherwise(F.try_divide("top", "median")).alias("max_to_median"),
        (F.col("weeks") - F.col("valid")).alias("no_data"),
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """AGG-8."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)


def multi_discipline(perf: DataFrame, athlete: str, discipline: str, score: str) -> DataFrame:
    """AGG-9: mean, sum and disciplines of athletes with more than one result."""
    out = perf.groupBy(athlete).agg(F.avg(score).alias("mean_score"), F.sum(score).alias("sum_score"), F.array_sort(F.collect_set(discipline)).alias("disciplines"), F.count(F.lit(1)).alias("n"))
    return out.filter("n > 1")


def best_discipline(perf: DataFrame, athlete: str, discipline: str, score: str) -> DataFrame:
    """AGG-10: discipline of the highest score; of equal scores the last name."""
    return perf.groupBy(athlete).agg(F.max_by(discipline, F.struct(score, discipline)).alias("best_discipline"), F.max(score).alias("best_score"))


def events_per_athlete(roster: DataFrame, athlete: str, event: str) -> DataFrame:
    """AGG-11, one row per athlete. ``with_events`` puts the list on every row."""
    return roster.groupBy(athlete).agg(F.array_sort(F.collect_set(event)).alias("events"))


def with_events(roster: DataFrame, athlete: str, event: str, name: str = "events") -> DataFrame:
    """AGG-11: every row with the sorted events of its athlete."""
    lists = events_per_athlete(roster, athlete, event).select(F.col(athlete).alias("__a"), F.col("events").alias(name))
    return roster.join(lists, F.col(athlete).eqNullSafe(F.col("__a"))).drop("__a")


def headline_counts(df: DataFrame, nat: str) -> DataFrame:
    """AGG-12."""
    return df.agg(F.count(F.lit(1)).alias("athletes"), F.countDistinct(nat).alias("countries"))


def rank_error(df: DataFrame, by: list[str], rank: str, place: str) -> DataFrame:
    """AGG-13: mean squared error of ranks, its root, and the number of ranks."""
    square = F.pow(F.col(rank).cast("double") - F.col(place), F.lit(2))
    return df.groupBy(*by).agg(F.avg(square).alias("mse"), F.sqrt(F.avg(square)).alias("rmse"), F.count(square).alias("n"))


def activity_summary(df: DataFrame, by: str, km: str, minutes: str) -> DataFrame:
    """AGG-14."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(km).alias("sum_km"), F.sum(minutes).alias("sum_minutes"))


def ingest_report(new: DataFrame, name: str) -> DataFrame:
    """AGG-15."""
    return new.groupBy(name).agg(F.count(F.lit(1)).alias("new_rows"))


def location_counts(df: DataFrame, lat: str, lng: str, name: str) -> DataFrame:
    """The number of athletes at each coordinate with the first and last name, without lists."""
    return df.groupBy(lat, lng).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first_name"), F.max(name).alias("last_name"))


def athletes_by_location(df: DataFrame, lat: str, lng: str, name: str, most: int = 1000) -> DataFrame:
    """AGG-16: number and names of the athletes at each coordinate; of more than ``most`` names the first ones, so that a row stays bounded. Each task passes on its
    own first names of a place, no more. ``location_members`` has all of them as rows."""
    counts = df.groupBy(lat, lng).agg(F.count(F.lit(1)).alias("n"))
    place = [F.col(lat).alias("__lat"), F.col(lng).alias("__lng"), F.col(name).alias("__name")]
    first = df.filter(F.col(name).isNotNull()).select(*place).withColumn("__rn", F.row_number().over(Window.partitionBy("__lat", "__lng").orderBy("__name"))).filter(F.col("__rn") <= most)
    lists = first.groupBy("__lat", "__lng").agg(F.array_sort(F.collect_list("__name")).alias("names"))
    out = counts.join(lists, F.col(lat).eqNullSafe(F.col("__lat")) & F.col(lng).eqNullSafe(F.col("__lng")), "left")
    return out.select(lat, lng, "n", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def location_members(df: DataFrame, lat: str, lng: str, name: str) -> DataFrame:
    """AGG-16 in rows: every athlete of a coordinate with their ``place`` in the order of names there; pages of a list are ranges of places."""
    return with_rank(df.select(lat, lng, name), [lat, lng], [name], "place")


def match_stats(df: DataFrame, id_col: str) -> DataFrame:
    """AGG-17."""
    has = F.col(id_col).isNotNull() & (F.col(id_col) != 0)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("with_id"), F.count_if(~has).alias("without_id"))


def weekly_totals(df: DataFrame, athlete: str, ts: str, sums: list[str], first_monday: str, weeks: int) -> DataFrame:
    """AGG-18: totals of every athlete and week, with a zero row where there is no data."""
    first = F.to_date(F.lit(first_monday))
    week = F.floor(F.datediff(F.col(ts).cast("date"), first) / 7).cast("int")
    totals = df.withColumn("week", week).groupBy(athlete, "week").agg(*[F.sum(c).alias(f"sum_{c}") for c in sums])
    grid = df.select(athlete).distinct().withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    return grid.join(totals, [athlete, "week"], "left").na.fill(0.0, [f"sum_{c}" for c in sums])


# -- windows and orders ------------------------------------------------------------------------------------------


def latest_per(df: DataFrame, keys: list[str], day: str, ties: list[Column] | None = None) -> DataFrame:
    """WIN-1."""
    return first_per(df, keys, [F.desc(day), *(ties or [])])


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """WIN-2: the first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def latest_struct(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """WIN-1 as a partial aggregate: no row but the latest of each key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*")


def earliest_batch(df: DataFrame, name: str, batch: str) -> DataFrame:
    """WIN-3: of names that stand in several batches only the rows of the first. Rows without a batch go with those of later ones, and stay where a name is in no
    more than one batch; rows without a name stay. The names in question are found by a partial aggregate, so no task holds all rows of a name."""
    several = df.groupBy(F.col(name).alias("__name")).agg(F.min(batch).alias("__first"), F.max(batch).alias("__last")).filter("__first < __last").drop("__last")
    later = F.coalesce(F.col(batch) != F.col("__first"), F.lit(True))
    return df.join(several, (F.col(name) == F.col("__name")) & later, "left_anti")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-4: all rows of keys that occur more than once (null keys among them), by a count that the rows are compared with."""
    many = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    return df.join(many, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_semi")


def with_rank(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """WIN-5: position in each list, from 1. A list may be longer than a task can sort: rows are dealt in ranges of (list, order), and the
    ranks of a range follow on the list's rows in earlier ranges. For one list of all rows use ``with_serial``."""
    dealt = _dealt(df, [*by, *order])
    upto = Window.partitionBy(*[f"__{k}" for k in by]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("__part", *by).agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__from"))
    counts = counts.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__{k}") for k in by], "__n", "__from").withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
    # as many rows as there are lists, and one more per range
    on = [F.col("__part") == F.col("__p"), *[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]]
    joined = dealt.join(counts, on, "left").withColumn(name, F.col("__before") + F.col("__place") - F.col("__from") + 1)
    return joined.drop("__part", "__place", "__p", *[f"__{k}" for k in by], "__n", "__from", "__before")


def dedupe_ids(df: DataFrame, id_col: str, order: list) -> DataFrame:
    """WIN-6."""
    return first_per(df, [id_col], order)


def order_like(df: DataFrame, ranking: DataFrame, on: str, then: str) -> DataFrame:
    """ORD-2: rows in the order of a ranking, then by ``then``."""
    return df.join(ranking.select(on, "serial"), on).orderBy("serial", then)


def by_score(df: DataFrame, score: str, *ties: str) -> DataFrame:
    """ORD-3: highest score first, unreadable scores last."""
    return df.orderBy(F.desc_nulls_last(score), *ties)


def by_name(df: DataFrame, name: str, discipline: str) -> DataFrame:
    """ORD-4."""
    return df.orderBy(name, discipline)


def top_n(df: DataFrame, n: int, *order) -> DataFrame:
    """ORD-5."""
    return df.orderBy(*order).limit(n)


def latest_row(df: DataFrame, ts: str) -> DataFrame:
    """ORD-6: the row of the latest time, as one aggregate; none for an empty table."""
    return df.agg(F.max_by(F.struct(*df.columns), ts).alias("r")).filter("r is not null").select("r.*")


def newest_first(df: DataFrame, ts: str) -> DataFrame:
    """ORD-7."""
    return df.orderBy(F.desc(ts))


# -- sets and quality --------------------------------------------------------------------------------------------


def stack(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    """SET-1, SET-2."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=allow_missing)
    return out


def new_ids(new: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """SET-3, QLT-5."""
    return new.select(column).subtract(known.select(column))


def null_profile(df: DataFrame) -> DataFrame:
    """QLT-1: number of nulls of every column that has some, in one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "n_null").filter("n_null > 0")


def nulls_replaced(before: DataFrame, after: DataFrame) -> DataFrame:
    """QLT-6: how many nulls of each column were replaced between two states of a table, without columns where none was."""
    left = null_profile(after).select(F.col("column_name").alias("__c"), F.col("n_null").alias("__left"))
    out = null_profile(before).join(left, F.col("column_name") == F.col("__c"), "left").withColumn("n_replaced", F.col("n_null") - F.coalesce("__left", F.lit(0)))
    return out.filter("n_replaced > 0").select("column_name", "n_replaced")


def unmatched_report(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """QLT-4: names of ``a`` that ``b`` lacks, with their number of rows."""
    return a.join(b, on, "left_anti").groupBy(on).agg(F.count(F.lit(1)).alias("n"))


def schema_accepts(columns: list[str], schema: T.StructType) -> bool:
    """QLT-3: whether a header has the contract's columns, in any order."""
    return set(columns) == {f.name for f in schema}
