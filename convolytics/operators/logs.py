"""Jobs over log records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def severity_counts(logs: DataFrame) -> DataFrame:
    """Records per hour and severity, with levels of the service mapped to severities."""
    severity = (
        F.when(F.col("level") == "SUCCESS", "INFO")
        .when(F.col("level") == "TRACE", "DEFAULT")
        .otherwise(F.col("level"))
    )
    return logs.groupBy(
        F.date_trunc("hour", "ts").alias("hour"), severity.alias("severity")
    ).agg(F.count(F.lit(1)).alias("n"))


def trace_stats(logs: DataFrame) -> DataFrame:
    """Calls per function: started, ended, not ended, median and longest seconds.

    Durations have whole milliseconds, so equal ones are counted before the median.
    """
    parsed = logs.select(
        F.regexp_extract("message", r"^\[(START|END)\] (\S+)", 1).alias("mark"),
        F.regexp_extract("message", r"^\[(START|END)\] (\S+)", 2).alias("fn"),
        F.regexp_extract("message", r" \(([0-9.]+)s\)$", 1).try_cast("double").alias("seconds"),
    ).where(F.col("mark") != "")
    counted = parsed.groupBy("fn", "mark", "seconds").agg(F.count(F.lit(1)).alias("n"))
    ended = F.when(F.col("mark") == "END", F.col("n")).otherwise(F.lit(0))
    started = F.when(F.col("mark") == "START", F.col("n")).otherwise(F.lit(0))
    return counted.groupBy("fn").agg(
        F.sum(started).alias("n_started"),
        F.sum(ended).alias("n_ended"),
        (F.sum(started) - F.sum(ended)).alias("n_open"),
        F.percentile("seconds", 0.5, F.col("n")).alias("median_sec"),
        F.max("seconds").alias("max_sec"),
    )
