"""Structured Streaming jobs over live messages, transcript events and uses of terms.

Every sink writes one folder per micro-batch and overwrites it when Spark replays the
batch, so a replay leaves nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from convolytics.operators.messages import KEY
from convolytics.operators.vocab import USE, build_user_vocab, distinct_uses, summarize_usages
from convolytics.scale import rank_rows, renamed, same_keys
from convolytics.streaming.tables import KeyedTable, source_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
USAGE_COLUMNS = [*USE, "used_correctly", "when"]
MARK = [*KEY, "status"]


def stream_number(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = KEY, **scale: int
) -> DataStreamWriter:
    """Write live messages with ``mid``: micro-batches in order of arrival, each in time order.

    A micro-batch is numbered as a batch is (``rank_rows``), so that a transcript with very
    many rows spreads over tasks; what it had in earlier batches comes from a table of counts
    per transcript and batch. A batch that Spark replays overwrites its rows and its counts.
    ``read_numbered`` reads the rows.
    """
    keys, source = list(keys), source_of(checkpoint)
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "n long"])

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = KeyedTable(batch.sparkSession, f"{path}/counts", schema, keys)
        if counts.holds(source, batch_id):
            return
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            new = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            known = counts.read(touching=new, without=(source, batch_id))
            before = renamed(known.groupBy(*keys).agg(F.sum("n").alias("_before")), keys)
            ranked = rank_rows(batch, keys, [F.col("created_at"), F.col("turn")], "_rn", **scale)
            joined = ranked.join(before, same_keys(ranked, before, keys), "left")
            index = F.col("_rn") + F.coalesce("_before", F.lit(0))
            mid = F.concat(F.upper("role"), index.cast("string"))
            rows = joined.select(*batch.columns, mid.alias("mid"))
            rows.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
            counts.append(new, source, batch_id)
        finally:
            batch.unpersist()
        counts.compact_if_due(lambda rows: rows.groupBy(*keys).agg(F.sum("n").alias("n")))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """The numbered messages of all batches."""
    return spark.read.parquet(f"{path}/rows").drop("batch_id")


class _Live(StatefulProcessor):
    """Counts per transcript, forgotten ``expire_ms`` of event time after the last message."""

    def __init__(self, expire_ms: int):
        self._expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", "n long, n_usr long, last_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        n, n_usr, last = self._seen.get() if self._seen.exists() else (0, 0, None)
        for frame in rows:  # chunks of an Arrow batch each: none is kept
            n += len(frame)
            n_usr += int((frame["role"] == "usr").sum())
            newest = frame["created_at"].max()
            if not pd.isna(newest):
                micros = newest.value // 1000
                last = micros if last is None else max(last, micros)
        self._seen.update((n, n_usr, last))
        if last is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(last // 1000 + self._expire_ms)
        when = pd.NaT if last is None else pd.Timestamp(last, unit="us")
        yield self._row(key, n, n_usr, when, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, n_usr, last = self._seen.get()
        self._seen.clear()
        yield self._row(key, n, n_usr, pd.Timestamp(last, unit="us"), True)

    def _row(self, key, n, n_usr, last, expired):
        row = {f"k{i}": [k] for i, k in enumerate(key)}
        return pd.DataFrame({**row, "n": [n], "n_usr": [n_usr], "last_updated": [last], "expired": [expired]})

    def close(self) -> None:
        pass


def stream_state(
    stream: DataFrame,
    late: str = "10 minutes",
    expire_after: timedelta = timedelta(days=1),
    keys: Sequence[str] = KEY,
) -> DataFrame:
    """Live state per transcript in update mode: messages, learner messages, last update.

    Time is that of the messages. The watermark follows the newest message by ``late``, and
    messages older than it are dropped. A transcript without messages for ``expire_after`` (by
    the watermark) leaves the state, with a last row marked ``expired``; one that goes on
    after that begins anew. State is three numbers and a timer per live transcript.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    names = ", ".join(f"k{i} {types[k]}" for i, k in enumerate(keys))
    state = (
        stream.select(*keys, "role", "created_at")
        .withWatermark("created_at", late)
        .groupBy(*keys)
        .transformWithStateInPandas(
            statefulProcessor=_Live(int(expire_after.total_seconds() * 1000)),
            outputStructType=f"{names}, n long, n_usr long, last_updated timestamp, expired boolean",
            outputMode="Update",
            timeMode="EventTime",
        )
    )
    return state.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def stream_route(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write live messages to lanes ``umsgs``, ``amsgs`` and ``rejects`` in one pass."""
    role = F.coalesce("role", F.lit(""))
    lane = F.when(role == "usr", "umsgs").when(role == "ast", "amsgs").otherwise("rejects")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("lane", lane)
        rows.write.mode("overwrite").partitionBy("lane").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_lane(spark: SparkSession, path: str, lane: str) -> DataFrame:
    """Messages of one lane; the other lanes are not read."""
    return spark.read.parquet(path).where(F.col("lane") == lane).drop("lane", "batch_id")


USES = (
    "uid {uid}, bcp47 string, term string, tid {tid}, mid string, used_correctly boolean, "
    "when timestamp"
)
#: Uses of one transcript wait in so many tasks.
SALTS = 16


def ledger_table(spark: SparkSession, path: str, uses: T.StructType) -> KeyedTable:
    """The table of uses under ``path``, in buckets by learner."""
    types = {f.name: f.dataType.simpleString() for f in uses}
    return KeyedTable(spark, path, USES.format(uid=types["uid"], tid=types["tid"]), ["uid"])


def finalised_uses(
    uses: DataFrame,
    ends: DataFrame,
    late: str = "10 minutes",
    longest: str = "7 days",
    salts: int = SALTS,
) -> DataFrame:
    """Uses of terms whose transcript was finalised, as a join of two streams.

    ``uses`` are those of ``usages_of``; ``ends`` has uid, tid, status and ended_at. A use
    waits in state until a ``final`` event of its transcript comes, then leaves for the ledger.
    A session lasts ``longest`` at most: a use without such an event by then leaves the state
    without having counted, and so does a use that ``late`` rows of either stream can no longer
    reach. Events may repeat. Uses of one transcript are dealt over ``salts`` join keys; the
    few events are repeated for each.
    """
    waiting = uses.select(*USAGE_COLUMNS).withWatermark("when", late)
    waiting = waiting.withColumn("_salt", F.pmod(F.xxhash64("term", "mid"), F.lit(salts)).cast("int"))
    final = (
        ends.where(F.col("status") == "final")
        .select(F.col("uid").alias("_uid"), F.col("tid").alias("_tid"), "ended_at")
        .withWatermark("ended_at", late)
        .withColumn("_end_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    met = (
        (F.col("uid") == F.col("_uid"))
        & (F.col("tid") == F.col("_tid"))
        & (F.col("_salt") == F.col("_end_salt"))
        & (F.col("ended_at") >= F.col("when"))
        & (F.col("ended_at") <= F.col("when") + F.expr(f"INTERVAL {longest}"))
    )
    return waiting.join(final, met).select(*USAGE_COLUMNS)


def stream_final_vocab(
    uses: DataFrame, ends: DataFrame, path: str, checkpoint: str, **waiting
) -> DataStreamWriter:
    """Keep the ledger of finalised transcripts (``finalised_uses``) under ``path``.

    Each batch adds what it brings; when the batches have grown to the size of the base, a new
    base is written and pointed to. ``read_final_ledger`` reads it.
    """
    source, schema = source_of(checkpoint), uses.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        table = ledger_table(batch.sparkSession, path, schema)
        table.append(distinct_uses(batch), source, batch_id)
        table.compact_if_due(distinct_uses)

    joined = finalised_uses(uses, ends, **waiting)
    return joined.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_final_ledger(table: KeyedTable, learners: DataFrame | None = None) -> DataFrame:
    """Count, first and last of each term; with ``learners`` (uid) only their buckets are read."""
    rows = table.read(touching=learners)
    if learners is not None:
        rows = rows.join(learners.select("uid").distinct(), "uid", "left_semi")
    return summarize_usages(distinct_uses(rows))


def stream_vocab(usages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append the uses of terms of each batch to the ledger folder.

    A batch costs what it brings in; the ledger itself is not rewritten. Repeated
    uses, within a batch or between batches, count once on reading.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = distinct_uses(batch.select(*USAGE_COLUMNS))
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return usages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_usages(spark: SparkSession, path: str, final: DataFrame | None = None) -> DataFrame:
    """The uses in the folder; with ``final`` (uid, tid) only those of these transcripts.

    The gate is on reading, so uses that came in before their transcript ended count once
    it has.
    """
    rows = spark.read.parquet(path).select(*USAGE_COLUMNS)
    if final is not None:
        rows = rows.join(final.select("uid", "tid"), ["uid", "tid"], "left_semi")
    return distinct_uses(rows)


def read_ledger(spark: SparkSession, path: str, final: DataFrame | None = None) -> DataFrame:
    """Count, first and last of each term over all batches."""
    return summarize_usages(read_usages(spark, path, final))


def read_user_vocab(spark: SparkSession, path: str, final: DataFrame | None = None) -> DataFrame:
    """Ledger documents over all batches."""
    return build_user_vocab(read_usages(spark, path, final))


def compact_ledger(spark: SparkSession, path: str, out: str) -> None:
    """Write all uses once to a new folder, clustered by learner, for cheaper reading."""
    read_usages(spark, path).sort(*USE).write.mode("overwrite").parquet(f"{out}/batch_id=-1")


def _marks_table(spark: SparkSession, path: str, events: T.StructType) -> KeyedTable:
    rest = [f for f in events if f.name not in MARK]
    return KeyedTable(spark, path, T.StructType([*[events[m] for m in MARK], *rest]), MARK)


def stream_finalize(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write the first event of each (transcript, status) as a mark, once for ever.

    Marks are a table under ``path`` in buckets by key, that any number of streams may add to,
    one after the other. A batch is reduced to one row per mark and compared with the marks
    of the buckets its keys fall into; a batch that Spark replays overwrites its own rows.
    """
    rest = [c for c in events.columns if c not in MARK]
    source, schema = source_of(checkpoint), events.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        table = _marks_table(batch.sparkSession, path, schema)
        first = batch.groupBy(*MARK).agg(F.min(F.struct(*rest)).alias("_r")).select(*MARK, "_r.*")
        known = renamed(table.read(touching=first, without=(source, batch_id)).select(*MARK), MARK)
        new = first.join(known, same_keys(first, known, MARK), "left_anti")
        table.append(new, source, batch_id)
        table.compact_if_due(lambda rows: rows)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def marks(spark: SparkSession, path: str, events: T.StructType) -> DataFrame:
    """All marks under ``path`` of events of that schema."""
    return _marks_table(spark, path, events).read()


def drain(writer: DataStreamWriter) -> None:
    """Run a stream over all that is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
