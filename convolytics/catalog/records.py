"""Queries over log records."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolytics.catalog.common import query
from convolytics.operators import logs as op
from convolytics.sources.views import view, with_views

L = with_views("v_logs")


@query(
    "g1_severity_counts",
    L + """ SELECT CAST(epoch(date_trunc('hour', ts)) AS bigint) AS hour,
        CASE level WHEN 'SUCCESS' THEN 'INFO' WHEN 'TRACE' THEN 'DEFAULT' ELSE level END
          AS severity, count(*) AS n FROM v_logs GROUP BY 1, 2""",
)
def g1(spark, d):
    df = op.severity_counts(view(spark, d, "v_logs"))
    return df.select(F.unix_seconds("hour").alias("hour"), "severity", "n")


@query(
    "g2_trace_stats",
    L + """, p AS (SELECT regexp_extract(message, '(fn[0-9]+)', 1) AS fn,
          message LIKE '[END]%' AS ended,
          TRY_CAST(regexp_extract(message, '\\(([0-9.]+)s\\)$', 1) AS double) AS sec FROM v_logs)
      SELECT fn, count(*) FILTER (NOT ended) AS n_started, count(*) FILTER (ended) AS n_ended,
        count(*) FILTER (NOT ended) - count(*) FILTER (ended) AS n_open,
        median(sec) AS median_sec, max(sec) AS max_sec FROM p GROUP BY fn""",
)
def g2(spark, d):
    return op.trace_stats(view(spark, d, "v_logs"))
