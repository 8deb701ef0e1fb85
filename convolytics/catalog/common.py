"""Registry of queries over the given tables, and pieces that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolytics.functions.scalars import TERM, WHITE
from convolytics.session import configure
from convolytics.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def strip_sql(text: str) -> str:
    return f"trim({text}, '{WHITE}')"


def hash_sql(text: str, length: int) -> str:
    return f"substr(translate(to_base64(unhex(sha256({text}))), '+/', 'Aa'), 1, {length})"


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and dates as text, as the oracle returns them."""
    casts = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            casts[f.name] = F.col(f.name).cast("long")
        elif isinstance(f.dataType, T.DateType):
            casts[f.name] = F.col(f.name).cast("string")
    return df.withColumns(casts) if casts else df


def query(name: str, sql: str | None = None):
    """Register a query and the SQL text that gives the same rows."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(fn(configure(spark), folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def epoch(name: str):
    return F.unix_seconds(name).alias(name)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """The message table: uid, tid, turn, mid, role, body, bcp47, created_at."""
    return message_columns(view(spark, folder, "v_messages"))


def message_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "uid", "tid", "turn", F.concat(F.upper("role"), F.col("turn").cast("string")).alias("mid"),
        "role", "body", "bcp47", F.timestamp_seconds("created_epoch").alias("created_at"),
    )


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "v_transcripts").withColumn(
        "created_at", F.timestamp_seconds("created_epoch")
    ).drop("created_epoch")


TERM_SQL = TERM.replace("'", "''")

# Term rows of messages on the oracle's side, to follow ``with_views('v_messages')``.
TERMS_SQL = f"""
v_terms AS (
  SELECT uid, tid, turn, mid, role, bcp47, created_epoch, term,
         row_number() OVER (PARTITION BY tid, turn ORDER BY i) - 1 AS pos
  FROM (SELECT uid, tid, turn, mid, role, bcp47, created_epoch, term, min(i) AS i
        FROM (SELECT *, unnest(ts) AS term, unnest(range(1, len(ts) + 1)) AS i
              FROM (SELECT *, upper(role) || CAST(turn AS varchar) AS mid,
                           regexp_extract_all(lower(body), '{TERM_SQL}') AS ts
                    FROM v_messages))
        GROUP BY uid, tid, turn, mid, role, bcp47, created_epoch, term)),
v_uses AS (
  SELECT uid, bcp47, term, tid, mid, created_epoch AS at_epoch FROM v_terms WHERE role = 'usr'),
v_ledger AS (
  SELECT uid, bcp47, term, count(*) AS n_usgs, min(at_epoch) AS first, max(at_epoch) AS last
  FROM v_uses GROUP BY uid, bcp47, term)"""


def with_terms(*names: str) -> str:
    return with_views("v_messages", *names) + "," + TERMS_SQL
