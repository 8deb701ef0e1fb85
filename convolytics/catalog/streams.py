"""Streaming jobs drained over the given tables; results equal those of the batch jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from convolytics.catalog.common import epoch, message_columns, query, with_terms
from convolytics.catalog.vocabulary import op as vocab
from convolytics.session import shared_dir
from convolytics.sources import views
from convolytics.sources.views import raw, with_views
from convolytics.streaming import jobs

M = with_views("v_messages")


def folder_of(spark) -> str:
    """A new folder for one run of a stream."""
    return f"{shared_dir(spark)}/convolytics-{uuid.uuid4().hex}"


def feed(spark, d, table: str, name: str):
    stream = spark.readStream.schema(raw(spark, d, table).schema).parquet(f"{d}/{table}.parque*")
    return views.query(spark, d, views.VIEWS[name], {table: stream})


def live(spark, d):
    return message_columns(feed(spark, d, "conversations", "v_messages")).drop("mid")


@query(
    "s1_stream_number",
    M + """ SELECT uid, tid, turn, upper(role) || (row_number() OVER (PARTITION BY uid, tid
        ORDER BY created_epoch, turn) - 1) AS mid FROM v_messages""",
)
def s1(spark, d):
    """All is there when the stream starts, so ids are those of the batch job."""
    out = folder_of(spark)
    jobs.drain(jobs.stream_number(live(spark, d), out, f"{out}/check"))
    return jobs.read_numbered(spark, out).select("uid", "tid", "turn", "mid")


@query(
    "s2_stream_state",
    M + """ SELECT uid, tid, count(*) AS n, count(*) FILTER (role = 'usr') AS n_usr,
        max(created_epoch) AS last_updated FROM v_messages GROUP BY uid, tid""",
)
def s2(spark, d):
    out = folder_of(spark)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")

    writer = jobs.stream_state(live(spark, d)).writeStream.foreachBatch(write)
    jobs.drain(writer.outputMode("update").option("checkpointLocation", f"{out}/check"))
    rows = spark.read.parquet(f"{out}/rows")
    rows = rows.where(~F.col("expired"))
    latest = rows.groupBy("uid", "tid").agg(F.max(F.struct("batch_id", "n", "n_usr", "last_updated")).alias("s"))
    return latest.select("uid", "tid", "s.n", "s.n_usr", F.unix_seconds("s.last_updated").alias("last_updated"))


@query(
    "s3_stream_route",
    M + """ SELECT tid, turn, CASE role WHEN 'usr' THEN 'umsgs' WHEN 'ast' THEN 'amsgs'
        ELSE 'rejects' END AS lane FROM v_messages""",
)
def s3(spark, d):
    out = folder_of(spark)
    jobs.drain(jobs.stream_route(live(spark, d), f"{out}/rows", f"{out}/check"))
    return spark.read.parquet(f"{out}/rows").select("tid", "turn", "lane")


@query(
    "s4_stream_vocab",
    with_terms() + " SELECT uid, bcp47, term, n_usgs, first, last FROM v_ledger",
)
def s4(spark, d):
    out = folder_of(spark)
    rows = message_columns(feed(spark, d, "conversations", "v_messages"))
    uses = vocab.usages_of(vocab.extract_terms(rows))
    jobs.drain(jobs.stream_vocab(uses, f"{out}/rows", f"{out}/check"))
    return jobs.read_ledger(spark, f"{out}/rows").select(
        "uid", "bcp47", "term", "n_usgs", epoch("first"), epoch("last")
    )


# A transcript ends a day after it began, unless it is still live.
ENDS = """SELECT conv_id % 17 AS uid, conv_id AS tid,
    CASE WHEN conv_id % 5 = 0 THEN 'live' ELSE 'final' END AS status,
    1704067200 + conv_id * 3600 + 86400 AS ended_epoch FROM conversations WHERE turn = 0"""


@query(
    "s4_final_vocab",
    with_terms() + f""", v_ends AS ({ENDS}) SELECT uid, bcp47, term, count(*) AS n_usgs,
        min(at_epoch) AS first, max(at_epoch) AS last FROM v_uses
        WHERE tid IN (SELECT tid FROM v_ends WHERE status = 'final') GROUP BY uid, bcp47, term""",
)
def s4_final(spark, d):
    """The ledger of finalised transcripts, from a stream of uses and one of events.

    Everything arrives twice (two streams add to one table) with a compaction in between.
    """
    out = folder_of(spark)
    table = None
    for run in ("one", "two"):
        rows = message_columns(feed(spark, d, "conversations", "v_messages"))
        uses = vocab.usages_of(vocab.extract_terms(rows))
        events = spark.readStream.schema(raw(spark, d, "conversations").schema).parquet(
            f"{d}/conversations.parque*"
        )
        ends = views.query(spark, d, ENDS, {"conversations": events}).withColumn(
            "ended_at", F.timestamp_seconds("ended_epoch")
        )
        jobs.drain(jobs.stream_final_vocab(uses, ends, out, f"{out}/check-{run}"))
        if table is None:
            table = jobs.ledger_table(spark, out, uses.schema)
            table.compact(vocab.distinct_uses)
    return jobs.read_final_ledger(table).select(
        "uid", "bcp47", "term", "n_usgs", epoch("first"), epoch("last")
    )


@query(
    "s5_stream_finalize",
    with_views("v_days") + """ SELECT uid, tid, status, count(*) AS n FROM (
        SELECT DISTINCT uid, tid, status FROM v_days) GROUP BY ALL""",
)
def s5(spark, d):
    """All finalise events, then all of them again: each mark is written once."""
    out = folder_of(spark)
    for run in ("one", "two"):
        days = feed(spark, d, "orders", "v_days")
        jobs.drain(jobs.stream_finalize(days, f"{out}/rows", f"{out}/check-{run}"))
    return jobs.marks(spark, f"{out}/rows", days.schema).groupBy("uid", "tid", "status").agg(F.count(F.lit(1)).alias("n"))
