"""Column functions FN-1 to FN-30: compositions of built-in expressions, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MILE_KM, FOOT_M = 1.60934, 0.3048


def to_number(c: Column, kind: str = "double", default: float | None = None) -> Column:
    """PRJ-5: a number or ``default``; never an error."""
    out = c.try_cast("double") if kind == "double" else c.try_cast("double").try_cast(kind)
    return out if default is None else F.coalesce(out, F.lit(default).cast(kind))


def parse_duration_min(c: Column) -> Column:
    """FN-1: ``1h 5m``, ``42m 51s``, ``16s`` as minutes, two decimals; anything else is 0."""
    whole = r"^\s*(?:([+-]?\d+)\s*h)?\s*(?:([+-]?\d+)\s*m)?\s*(?:([+-]?\d+)\s*s)?\s*$"
    part = lambda i: F.coalesce(F.regexp_extract(c, whole, i).try_cast("double"), F.lit(0.0))
    return F.when(c.rlike(whole) & (F.length(F.trim(c)) > 0), F.round(part(1) * 60 + part(2) + part(3) / 60, 2)).otherwise(F.lit(0.0))


def _quantity(c: Column) -> tuple[Column, Column]:
    form = r"^([\d,\.]+)\s*([a-zA-Z]+)"
    return F.replace(F.regexp_extract(F.trim(c), form, 1), F.lit(","), F.lit("")).try_cast("double"), F.lower(F.regexp_extract(F.trim(c), form, 2))


def to_km(c: Column) -> Column:
    """FN-2: ``3.1 mi`` or ``1,200 km`` in km; other units and bad numbers are 0."""
    n, unit = _quantity(c)
    return F.coalesce(F.when(unit == "mi", n * MILE_KM).when(unit == "km", n), F.lit(0.0))


def to_metres(c: Column) -> Column:
    """FN-3: ``ft`` or ``m`` in metres; others are 0."""
    n, unit = _quantity(c)
    return F.coalesce(F.when(unit == "ft", n * FOOT_M).when(unit == "m", n), F.lit(0.0))


def first_number(c: Column) -> Column:
    """FN-4: the first run of digits and points as a number, or null."""
    return F.regexp_extract(c, r"[\d\.]+", 0).try_cast("double")


def parse_pace(c: Column) -> Column:
    """FN-5: ``m:ss /km`` as minutes, or null."""
    form = r"(\d+):(\d+)\s*/\s*(?:mi|km)"
    return F.round(F.regexp_extract(c, form, 1).try_cast("double") + F.regexp_extract(c, form, 2).try_cast("double") / 60, 2)


def html_to_text(c: Column) -> Column:
    """FN-6: tags to one space, references decoded, trimmed."""
    out = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, " +", " "))


def repair_json(c: Column) -> Column:
    """FN-7: references decoded, line breaks and tabs dropped, commas before a closing bracket removed."""
    out = c
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"[\n\r\t]", ""), r",\s*([}\]])", "$1")


def display_name(c: Column) -> Column:
    """FN-8: trimmed, single spaces, each run of letters capitalised."""
    parts = F.split(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))), "")


def match_key(c: Column) -> Column:
    """FN-9: trimmed, upper case, single spaces."""
    return F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))


def flip_name(c: Column, mode: str = "one_comma") -> Column:
    """FN-10: ``LAST, First`` to ``First LAST``, upper case; ``one_comma`` leaves names with more commas, ``first_comma`` splits at the first."""
    parts = F.split(c, ",") if mode == "one_comma" else F.split(c, ", ", 2)
    return F.upper(F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0]))).otherwise(c))


def upper_name(c: Column) -> Column:
    """FN-11."""
    return F.upper(c)


def mi_to_km(c: Column) -> Column:
    """FN-12."""
    return c * MILE_KM


def pace_mi_to_km(c: Column) -> Column:
    """FN-12."""
    return c / MILE_KM


def pace(minutes: Column, km: Column) -> Column:
    """FN-13: minutes per km, null where there is no distance."""
    return finite(F.try_divide(minutes, km))


def seconds(minutes: Column, legacy: bool = False) -> Column:
    """FN-14: seconds as a number, or cut to an integer (``legacy``)."""
    return (minutes * 60).cast("long") if legacy else minutes * 60.0


def activity_type(c: Column, main: tuple[str, ...] = ("Run", "Ride", "Swim"), same: dict[str, str] | None = None) -> Column:
    """FN-15: virtual rides are rides; what isn't of a main type is Other (null too)."""
    for a, b in ({"VirtualRide": "Ride"} if same is None else same).items():
        c = F.when(c == a, b).otherwise(c)
    return F.when(c.isin(*main), c).otherwise(F.lit("Other"))


def hours(active: Column, elapsed: Column) -> Column:
    """FN-16."""
    return F.coalesce(active.cast("double"), elapsed.cast("double")) / 3600.0


def parse_instant(c: Column) -> Column:
    """FN-17: ISO text to a UTC timestamp, null if unreadable."""
    return F.try_to_timestamp(c)


def parse_day(c: Column) -> Column:
    """FN-18: ``8 Nov 2024`` to a date, null if unreadable."""
    return F.try_to_timestamp(c, F.lit("d MMM yyyy")).cast("date")


def days_since(day: Column, reference: str = "2024-08-01") -> Column:
    """FN-19."""
    return F.datediff(F.lit(reference).cast("date"), day)


def decayed(score: Column, days: Column, lam: float = 0.001) -> Column:
    """FN-20: score weighted by exponential decay."""
    return score * F.exp(days * -lam)


def performance_key(*c: Column) -> Column:
    """FN-21: the parts joined by ``_``; null parts read ``nan``."""
    return F.concat_ws("_", *[F.coalesce(x.cast("string"), F.lit("nan")) for x in c])


def human_date(c: Column) -> Column:
    """FN-22: ``August 01, 2024 at 09:05 AM``; null is ``-``, unreadable text stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "MMMM dd, yyyy 'at' hh:mm a"), c, F.lit("-"))


def fixed(c: Column, n: int = 2, thousands: bool = False) -> Column:
    """FN-23: a number with ``n`` decimals."""
    return F.format_number(c, n) if thousands else F.format_string(f"%.{n}f", c)


def zip_lists(a: Column, b: Column, separator: str = "|") -> Column:
    """FN-24: two delimited lists side by side, cut to the shorter."""
    x, y = F.split(a, rf"\Q{separator}\E"), F.split(b, rf"\Q{separator}\E")
    n = F.least(F.size(x), F.size(y))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: F.struct(p.alias("a"), q.alias("b")))


def not_blank(c: Column) -> Column:
    """FN-25."""
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def finite(c: Column) -> Column:
    """FN-26: NaN and infinities to null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def to_json_rows(df: DataFrame) -> DataFrame:
    """FN-26: each row as JSON without nulls, ids and times as text."""
    kinds = dict(df.dtypes)
    clean = [finite(F.col(f"`{c}`")).alias(c) if k in ("double", "float") else (F.col(f"`{c}`").cast("string").alias(c) if k in ("bigint", "timestamp", "date") else F.col(f"`{c}`")) for c, k in kinds.items()]
    return df.select(F.to_json(F.struct(*clean)).alias("json"))


def week_label(year: Column, week: Column) -> Column:
    """FN-27: ``interval-YYYYWW``."""
    return F.format_string("interval-%d%02d", year.cast("int"), week.cast("int"))


def week_range(c: Column) -> Column:
    """FN-28: struct of start, end and empty from ``Activities for 1 Jan 2024 - 7 Jan 2024`` or ``Week 01 - No Data``."""
    form = r"(\d{1,2} [A-Za-z]{3} \d{4})\s*-\s*(\d{1,2} [A-Za-z]{3} \d{4})"
    return F.struct(parse_day(F.regexp_extract(c, form, 1)).alias("start"), parse_day(F.regexp_extract(c, form, 2)).alias("end"), F.contains(c, F.lit("No Data")).alias("empty"))


def alnum(c: Column) -> Column:
    """FN-29: letters and numbers only."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def rank_delta(rank: Column, place: Column, null_policy: str = "none", over=None) -> Column:
    """FN-30: difference of ranks; missing ones stay null, become 0, or take the mean over ``over``."""
    delta = (rank - place).cast("double")
    if null_policy == "zero":
        return F.coalesce(delta, F.lit(0.0))
    return F.coalesce(delta, F.avg(delta).over(over)) if null_policy == "mean" else delta


def register_sql(spark: SparkSession) -> None:
    """``parse_duration_min(text)`` as a SQL function."""
    form = r"^\\s*(?:([+-]?\\d+)\\s*h)?\\s*(?:([+-]?\\d+)\\s*m)?\\s*(?:([+-]?\\d+)\\s*s)?\\s*$"
    part = lambda i: f"coalesce(try_cast(regexp_extract(t, '{form}', {i}) as double), 0d)"
    spark.sql(f"create or replace temporary function parse_duration_min(t string) returns double return case when t rlike '{form}' and length(trim(t)) > 0 then round({part(1)} * 60 + {part(2)} + {part(3)} / 60, 2) else 0d end")
