import math

import pytest
from pyspark.sql import functions as F

from stridelake import functions as fn


def one(spark, kind, value, expr):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("r")).first()[0]


@pytest.mark.parametrize(
    ("text", "minutes"),
    [("1h 5m", 65.0), ("1 h 5 m", 65.0), ("42m 51s", 42.85), ("30 m 44 s", 30.73), ("16s", 0.27), ("134 bpm", 0), ("1:55 /100yd", 0), ("92 ft", 0), ("175 W", 0), ("1:46 /100m", 0), ("", 0), (None, 0)],
)
def test_duration(spark, text, minutes):
    assert one(spark, "string", text, fn.parse_duration_min) == minutes
    fn.register_sql(spark)
    assert spark.createDataFrame([(text,)], "c string").selectExpr("parse_duration_min(c)").first()[0] == minutes


@pytest.mark.parametrize(("text", "km"), [("3.1 mi", 3.1 * 1.60934), ("1,200 km", 1200), ("5 ft", 0), ("x", 0), (None, 0)])
def test_km(spark, text, km):
    assert math.isclose(one(spark, "string", text, fn.to_km), km)


@pytest.mark.parametrize(("text", "name"), [("  o'brien   smith-jones ", "O'Brien Smith-Jones"), ("CY GARCÍA", "Cy García"), ("", ""), (None, None)])
def test_display_name(spark, text, name):
    assert one(spark, "string", text, fn.display_name) == name


def test_names(spark):
    assert one(spark, "string", "RUNNER, Ada", fn.flip_name) == "ADA RUNNER"
    assert one(spark, "string", "Runner, Ada, Jr", fn.flip_name) == "RUNNER, ADA, JR"
    assert one(spark, "string", "Runner, Ada, Jr", lambda c: fn.flip_name(c, "first_comma")) == "ADA, JR RUNNER"


def test_dates(spark):
    assert one(spark, "string", "8 Nov 2024", fn.parse_day).isoformat() == "2024-11-08"
    assert one(spark, "string", "soon", fn.parse_day) is None
    assert one(spark, "string", "2024-08-01 09:05:00", fn.human_date) == "August 01, 2024 at 09:05 AM"
    assert one(spark, "string", "later", fn.human_date) == "later"
    assert one(spark, "string", None, fn.human_date) == "-"
    week = one(spark, "string", "Activities for 1 Jan 2024 - 7 Jan 2024", fn.week_range)
    assert (week.start.isoformat(), week.end.isoformat(), week.empty) == ("2024-01-01", "2024-01-07", False)
    assert one(spark, "string", "Week 01 - No Data", fn.week_range).empty


def test_finite(spark):
    for bad in (float("nan"), float("inf"), -float("inf"), None):
        assert one(spark, "double", bad, fn.finite) is None
    assert one(spark, "double", 0.0, lambda c: fn.pace(F.lit(5.0), c)) is None


def test_zip_lists_cuts_to_the_shorter(spark):
    r = spark.createDataFrame([("a|b|c", "1|2")], "x string, y string").select(fn.zip_lists(F.col("x"), F.col("y")).alias("r")).first()[0]
    assert [tuple(p) for p in r] == [("a", "1"), ("b", "2")]


def test_repair_json(spark):
    assert one(spark, "string", '{&quot;a&quot;:[1,\n2,],}', fn.repair_json) == '{"a":[1,2]}'
