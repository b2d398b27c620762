"""Table contracts."""

from __future__ import annotations

import re

from pyspark.sql import types as T


_KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampType()}


def table_schema(text: str) -> T.StructType:
    """A flat contract from ``name kind`` pairs (names with spaces in backquotes); needs no session."""
    pairs = re.findall(r"\s*(?:`([^`]+)`|(\w+))\s+(\w+)\s*(?:,|$)", text)
    return T.StructType([T.StructField(a or b, _KINDS[kind]) for a, b, kind in pairs])


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, _KINDS[v] if isinstance(v, str) else v) for k, v in fields.items()])


ACTIVITIES_RAW_KM = table_schema("`Athlete ID` bigint, `Athlete Name` string, `Activity ID` bigint, `Activity Name` string, Description string, `Start Date` timestamp, `Elapsed Time` bigint, Type string, Location string, `Distance (km)` double, `Pace (min/km)` double, Time string")
ACTIVITIES_RAW_MI = table_schema("`Athlete ID` bigint, `Athlete Name` string, `Activity ID` bigint, `Activity Name` string, Description string, `Start Date` timestamp, `Elapsed Time` bigint, Type string, Location string, `Distance (mi)` double, `Pace (min/mi)` double, Time string")
ACTIVITIES = table_schema("Serial bigint, `Athlete ID` bigint, `Athlete Name` string, `Activity ID` bigint, `Activity Name` string, Description string, `Start Date` timestamp, `Elapsed Time` bigint, Type string, Location string, `Pace (min/mi)` double, `Pace (min/km)` double, `Time (min)` double, `Distance (km)` double, `Activity Time (s)` double, Time string")
WEEKLY_TOTALS = table_schema("`Athlete ID` bigint, Name string, `Week Number` string, `Date Range` string, `Distance (km)` double, Time string, `Elevation (m)` double")
PERFORMANCES = table_schema("Mark string, Competitor string, Nat string, Location string, Date string, `Results Score` int, Discipline string, Gender string, Date_Created string")
LOAD_LOG = table_schema("timestamp timestamp, athlete_metadata_count bigint, master_iaaf_count bigint, activities_count bigint")

_STATS = T.ArrayType(_struct(key="string", value="string"))
_PLACE = _struct(location="string")
_ACTIVITY = _struct(id="bigint", activityName="string", description="string", startDate="string", elapsedTime="bigint", type="string", athlete=_struct(athleteId="bigint", athleteName="string"), timeAndLocation=_PLACE, stats=_STATS)
_ROW = _struct(activity_id="bigint", athlete_id="bigint", athlete_name="string", name="string", description="string", start_date="string", elapsed_time="bigint", type="string", stats=_STATS)
_ENTRIES = T.ArrayType(_struct(activity=_ACTIVITY, timeAndLocation=_PLACE, rowData=_struct(entity="string", activities=T.ArrayType(_ROW))))
PAYLOAD = _struct(preFetchedEntries=_ENTRIES, appContext=_struct(athleteProfileId="bigint", preFetchedEntries=_ENTRIES), _corrupt_record="string")
