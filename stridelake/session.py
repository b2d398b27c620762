"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, ANSI arithmetic, adaptive plans with skew handling, and the last of duplicate map keys wins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("stridelake")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | conf).getOrCreate()
