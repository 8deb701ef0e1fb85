"""Drained streams equal the batch operators on the same rows."""

import pytest
from datetime import datetime

from pyspark.sql import functions as F

from convolytics.catalog.common import messages
from convolytics.operators import messages as ms
from convolytics.operators import vocab as vo
from convolytics.streaming import jobs
from convolytics.streaming.tables import KeyedTable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Message files in time order, one per third of the turns."""
    path = str(tmp_path_factory.mktemp("feed"))
    rows = messages(spark, SF).drop("mid")
    for i, cond in enumerate([F.col("turn") < 2, F.col("turn").between(2, 4), F.col("turn") > 4]):
        rows.where(cond).coalesce(1).write.parquet(f"{path}/{i}")
    return path, rows


def _stream(spark, feed):
    path, rows = feed
    return (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    )


def _set(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_number_is_in_time_order_whatever_the_chunks(spark, feed, tmp_path):
    """Several chunks of a transcript in one micro-batch, rows in no order."""
    out = str(tmp_path / "out")
    feed[1].orderBy(F.rand(3)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feed[1].schema).parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        jobs.drain(jobs.stream_number(stream, out, str(tmp_path / "c")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    cols = ["uid", "tid", "turn", "mid"]
    assert _set(jobs.read_numbered(spark, out), *cols) == _set(ms.number_messages(feed[1]), *cols)


def test_number_has_no_gaps_and_no_repeats(spark, feed, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    jobs.drain(jobs.stream_number(_stream(spark, feed), out, check))
    got = jobs.read_numbered(spark, out)
    want = ms.number_messages(feed[1])
    assert got.count() == want.count()
    index = F.regexp_extract("mid", "[0-9]+", 0)
    assert _set(got.withColumn("i", index), "uid", "tid", "i") == _set(
        want.withColumn("i", index), "uid", "tid", "i"
    )
    assert got.where(~F.startswith("mid", F.upper("role"))).count() == 0


def _batches(writer):
    """Run a stream over all that is there; its progress per micro-batch."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return [p for p in query.recentProgress]


def test_hot_transcript_is_numbered_in_several_tasks(spark, tmp_path):
    """One transcript with nearly all rows of each batch: ids are those of one batch job."""
    rows = spark.range(400).select(
        F.lit(1).alias("uid"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("tid"),
        F.col("id").alias("turn"), F.lit("usr").alias("role"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("created_at"),
    )
    for i in range(2):
        rows.where(F.floor(F.col("id") / 200) == i).repartition(3).write.parquet(f"{tmp_path}/in/{i}")
        out, check = str(tmp_path / "out"), str(tmp_path / "check")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
        jobs.drain(jobs.stream_number(stream, out, check, rows_per_task=25))
    cols = ["uid", "tid", "turn", "mid"]
    assert _set(jobs.read_numbered(spark, out), *cols) == _set(ms.number_messages(rows), *cols)


def test_state_equals_batch(spark, feed, tmp_path):
    """Three micro-batches; the last row of each transcript has the counts of all its messages."""
    out = str(tmp_path / "rows")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    # Files follow the turns, not the time, so no row of them may be late.
    state = jobs.stream_state(_stream(spark, feed), late="9999 days")
    writer = state.writeStream.foreachBatch(write).outputMode("update")
    jobs.drain(writer.option("checkpointLocation", str(tmp_path / "c")))
    latest = spark.read.parquet(out).groupBy("uid", "tid").agg(
        F.max(F.struct("n", "n_usr", "last_updated")).alias("s")
    )
    want = feed[1].groupBy("uid", "tid").agg(
        F.count("*").alias("n"), F.count_if(F.col("role") == "usr").alias("n_usr"),
        F.max("created_at").alias("last_updated"),
    )
    cols = ["uid", "tid", "n", "n_usr", "last_updated"]
    assert _set(latest.select("uid", "tid", "s.*"), *cols) == _set(want, *cols)


def test_state_expires_and_drops_late_rows(spark, tmp_path):
    hour = 3600
    steps = [
        [("a", 0), ("a", 60), ("b", 0)],
        [("c", 30 * hour)],  # the watermark passes a and b by more than a day
        [("a", 10), ("c", 30 * hour + 5)],  # a's row is late
        [("d", 60 * hour)],
    ]
    schema = "uid string, tid string, role string, created_at timestamp"
    out = str(tmp_path / "rows")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    progress = []
    for i, step in enumerate(steps):
        rows = [("u", t, "usr", datetime.fromtimestamp(1704067200 + s)) for t, s in step]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        state = jobs.stream_state(stream, late="10 minutes")
        writer = state.writeStream.foreachBatch(write).outputMode("update")
        progress += _batches(writer.option("checkpointLocation", str(tmp_path / "c")))
    got = spark.read.parquet(out).orderBy("batch_id", "tid").collect()
    assert [(r.tid, r.n) for r in got if not r.expired] == [("a", 2), ("b", 1), ("c", 1), ("c", 2), ("d", 1)]
    assert sorted(r.tid for r in got if r.expired) == ["a", "b", "c"]
    late = sum(o.numRowsDroppedByWatermark for p in progress for o in p.stateOperators)
    assert late == 1
    sizes = [o.numRowsTotal for p in progress for o in p.stateOperators]
    assert max(sizes) > sizes[-1]


def test_route_keeps_every_message_in_one_lane(spark, feed, tmp_path):
    out = str(tmp_path / "out")
    jobs.drain(jobs.stream_route(_stream(spark, feed), out, str(tmp_path / "check")))
    lanes = ms.split_live(feed[1])
    for lane, want in zip(("umsgs", "amsgs", "rejects"), lanes):
        got = jobs.read_lane(spark, out, lane)
        assert _set(got, "tid", "turn", "body") == _set(want, "tid", "turn", "body")


def _uses(rows):
    return vo.usages_of(vo.extract_terms(ms.number_messages(rows)))


def test_vocab_ledger_survives_replay(spark, feed, tmp_path):
    out = str(tmp_path / "ledger")
    uses = _uses(feed[1])
    source = str(tmp_path / "uses")
    uses.repartition(4).write.parquet(source)
    stream = (
        spark.readStream.schema(uses.schema).option("maxFilesPerTrigger", 2).parquet(source)
    )
    jobs.drain(jobs.stream_vocab(stream, out, str(tmp_path / "c1")))
    cols = ["uid", "bcp47", "term", "n_usgs", "first", "last"]
    want = _set(vo.summarize_usages(uses), *cols)
    assert _set(jobs.read_ledger(spark, out), *cols) == want
    # The same uses once more, as further batches.
    vo.distinct_uses(uses).write.parquet(f"{out}/batch_id=77")
    assert _set(jobs.read_ledger(spark, out), *cols) == want
    docs = jobs.read_user_vocab(spark, out)
    assert docs.select(F.sum(F.size("usgs"))).first()[0] == uses.count()
    jobs.compact_ledger(spark, out, str(tmp_path / "new"))
    assert _set(jobs.read_ledger(spark, str(tmp_path / "new")), *cols) == want


def test_finalize_passes_each_mark_once(spark, tmp_path):
    rows = spark.range(40).select(
        (F.col("id") % 2).alias("uid"), (F.col("id") % 10).alias("tid"),
        F.when(F.col("id") % 10 < 5, "final").otherwise("empty").alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ended_at"),
    )
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.repartition(4).write.parquet(source)
    stream = (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    )
    for again in ("a", "b"):  # the events once more, long after
        jobs.drain(jobs.stream_finalize(stream, out, str(tmp_path / again)))
    got = jobs.marks(spark, out, rows.schema)
    assert got.count() == 10
    assert _set(got, "uid", "tid", "status") == _set(
        rows.select("uid", "tid", "status").distinct(), "uid", "tid", "status"
    )


def test_ledger_of_finalised_transcripts(spark, tmp_path):
    names = "uid string, bcp47 string, term string, tid string, mid string, used_correctly boolean, when timestamp"
    when = datetime(2024, 1, 1)
    uses = spark.createDataFrame([("u", "en-US", "fox", t, "USR0", None, when) for t in ("t1", "t2")], names)
    uses.write.parquet(f"{tmp_path}/batch_id=0")
    final = spark.createDataFrame([("u", "t1")], "uid string, tid string")
    assert jobs.read_ledger(spark, str(tmp_path)).first().n_usgs == 2
    assert jobs.read_ledger(spark, str(tmp_path), final).first().n_usgs == 1


def _uses_and_ends(spark):
    """Uses of 30 transcripts, a third of all in one of them; every third one is not finalised."""
    when = F.timestamp_seconds(F.lit(1704067200) + F.col("id"))
    uses = spark.range(900).select(
        F.lit("u").alias("uid"), F.lit("en-US").alias("bcp47"),
        F.concat(F.lit("w"), (F.col("id") % 23).cast("string")).alias("term"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 30).alias("tid"),
        F.concat(F.lit("USR"), F.col("id").cast("string")).alias("mid"),
        F.lit(None).cast("boolean").alias("used_correctly"), when.alias("when"),
    )
    ends = spark.range(30).select(
        F.lit("u").alias("uid"), F.col("id").alias("tid"),
        F.when(F.col("id") % 3 == 0, "empty").otherwise("final").alias("status"),
        F.timestamp_seconds(F.lit(1704067200 + 3600) + F.col("id")).alias("ended_at"),
    )
    return uses, ends


def test_uses_wait_for_the_end_of_their_transcript(spark, tmp_path):
    """Uses first, events later and again; a compaction and a replayed batch change nothing."""
    uses, ends = _uses_and_ends(spark)
    out, check = str(tmp_path / "ledger"), str(tmp_path / "c")
    spark_schema = uses.schema
    (tmp_path / "uses").mkdir()
    (tmp_path / "ends").mkdir()
    want = vo.summarize_usages(uses.where("tid % 3 <> 0"))
    cols = ["uid", "bcp47", "term", "n_usgs", "first", "last"]
    table = jobs.ledger_table(spark, out, spark_schema)
    seen = []
    for step in range(4):
        if step == 0:
            uses.repartition(3).write.parquet(f"{tmp_path}/uses/0")
        elif step < 3:
            ends.coalesce(1).write.parquet(f"{tmp_path}/ends/{step}")
        else:
            table.compact(vo.distinct_uses)
            before = table.read().count()
            # The batch that brought the uses once more, after it went into the base.
            table.append(uses.where("tid % 3 <> 0"), jobs.source_of(check), 1)
            assert table.read().count() == before
        u = spark.readStream.schema(uses.schema).parquet(f"{tmp_path}/uses/*")
        e = spark.readStream.schema(ends.schema).parquet(f"{tmp_path}/ends/*") if step else None
        if e is None:
            e = spark.readStream.schema(ends.schema).parquet(f"{tmp_path}/ends")
        jobs.drain(jobs.stream_final_vocab(u, e, out, check, salts=4))
        seen.append(table.read().count())
    assert seen[0] == 0 and seen[1] > 0
    assert _set(jobs.read_final_ledger(table), *cols) == _set(want, *cols)
    one = jobs.read_final_ledger(table, spark.createDataFrame([("u",)], "uid string"))
    assert _set(one, *cols) == _set(want, *cols)


def test_table_reads_only_buckets_of_the_keys(spark, tmp_path):
    """What a batch reads to look up its keys does not grow with what was written before."""
    table = KeyedTable(spark, str(tmp_path), "k long, v long", ["k"], bucket_rows=100, first_depth=3)
    keys = spark.range(3).select(F.col("id").alias("k"))
    read = []
    for batch in range(6):
        rows = spark.range(batch * 1000, batch * 1000 + 1000).select(
            F.col("id").alias("k"), F.lit(batch).cast("long").alias("v")
        )
        table.append(rows, "s", batch)
        table.compact(lambda r: r)
        hit = table.read(touching=keys)
        assert hit.join(keys, "k", "left_semi").count() == 3
        read.append(hit.count())
    assert table.read().count() == 6000 and table.pointer()["depth"] > 3
    assert max(read[3:]) <= max(read[:3]) and max(read) <= 3 * 400
    table.append(spark.range(1).select(F.col("id").alias("k"), F.col("id").alias("v")), "s", 5)
    assert table.read().count() == 6000
