"""The end of sessions, twice in a row."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from convolytics.operators import backends as bk
from convolytics.plans.session_end import end_sessions

T0 = datetime(2024, 1, 1)


def test_second_run_adds_nothing(spark, tmp_path):
    rows = [("u", "t1", f"USR{i}", "usr", b, T0 + timedelta(minutes=i), "en-US")
            for i, b in enumerate(["the red fox", "the blue fox"])]
    rows += [("u", "t2", "AST0", "ast", "hello there", T0, "en-US")]
    messages = spark.createDataFrame(
        rows, "uid string, tid string, mid string, role string, body string, created_at timestamp, bcp47 string"
    )
    heads = spark.createDataFrame([("u", t, "live") for t in ("t1", "t2", "t3")], "uid string, tid string, status string")
    acts = spark.createDataFrame(
        [("a1", "unstr", "en-US", T0), ("a2", "unstr", "en-US", T0 + timedelta(1)), ("a3", "drill", "en-US", T0)],
        "aid string, atp string, bcp47 string, created_at timestamp",
    )
    users = spark.createDataFrame([("u", "en-US"), ("v", "en-US")], "uid string, language string")
    scores = spark.createDataFrame([("u", "t1", "usr", "vocab", 3)], "uid string, tid string, role string, dim string, score int")
    none = spark.createDataFrame(
        [], "uid string, bcp47 string, term string, tid string, mid string, used_correctly boolean, when timestamp"
    )
    as_of = F.lit(T0 + timedelta(days=2)).cast("timestamp")
    first = end_sessions(messages, heads, none, acts, users, as_of, n=3, scores=scores, ledger_out=str(tmp_path / "a"))
    assert {r.tid: r.status for r in first["transcripts"].collect()} == {"t1": "final", "t2": "empty", "t3": "empty"}
    plans = {r.uid: r for r in first["plans"].collect()}
    assert plans["u"].aid == plans["v"].aid == "a2" and plans["v"].vocab is None
    # Newest last use first, then the earlier first use, then the term.
    assert plans["u"].vocab == ["fox", "the", "blue"]
    starts = first["next_transcripts"].collect()
    assert {r.uid for r in starts} == {"u", "v"} and all(r.status == "live" for r in starts)
    assert first["scores"].first().median == 3.0
    again = end_sessions(messages, heads, first["usages"], acts, users, as_of, n=3, ledger_out=str(tmp_path / "b"))
    assert again["usages"].count() == first["usages"].count() == 6
    assert {r.uid: r.vocab for r in again["plans"].collect()} == {u: p.vocab for u, p in plans.items()}


def test_session_end_asks_about_finalised_transcripts(spark):
    columns = "uid string, tid string, mid string, role string, body string, created_at timestamp, bcp47 string"
    rows = [("u", "t1", "USR0", "usr", "the red fox", T0, "en-US"), ("u", "t2", "AST0", "ast", "hello", T0, "en-US")]
    rows += [("u", "t3", "USR0", "usr", "odd", T0, "en-US")]
    messages = spark.createDataFrame(rows, columns)
    heads = messages.select("uid", "tid", "bcp47").distinct()
    acts = spark.createDataFrame([("a1", "unstr", "en-US", T0)], "aid string, atp string, bcp47 string, created_at timestamp")
    users = spark.createDataFrame([("u", "en-US")], "uid string, language string")
    none = spark.createDataFrame(
        [], "uid string, bcp47 string, term string, tid string, mid string, used_correctly boolean, when timestamp"
    )
    memory = spark.createDataFrame([], "text string, source string, target string, translated string")
    reply = """CASE effect WHEN 'grade' THEN if(messages[0].content = 'odd', 'none', 'adult')
      WHEN 'skills' THEN 'report' WHEN 'split_skills' THEN 'good\\nbad'
      WHEN 'topics' THEN 'a, b' ELSE 'sum' END"""

    def backend(requests):
        asked = bk.distinct_requests(requests)
        return bk.replay(bk.recorded_reply(asked.withColumn("reply", F.expr(reply))))(requests)

    out = end_sessions(
        messages, heads, none, acts, users, F.lit(T0 + timedelta(days=2)).cast("timestamp"), backend=backend,
        memory=memory, translator=lambda df: df.withColumn("translated", F.col("text")),
    )
    assert [(r.tid, r.grade) for r in out["grades"].collect()] == [("t1", 11)]
    skills = {r.tid: (r.assessment, r.strengths, r.weaknesses) for r in out["skills"].collect()}
    assert skills == dict.fromkeys(("t1", "t3"), ("report", "good", "bad"))
    assert {r.tid: r.topics for r in out["topics"].collect()} == dict.fromkeys(("t1", "t3"), ["a", "b"])
    assert {r.tid: r.summary for r in out["summaries"].collect()} == dict.fromkeys(("t1", "t3"), "sum")
    rejects = [(r.tid, r.reason, r.effect) for r in out["effect_rejects"].collect()]
    assert rejects == [("t3", "grade not understood", "grades")]
