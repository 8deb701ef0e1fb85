"""Messages, transcripts and scores on small literal inputs."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convolytics.functions import dims, scalars
from convolytics.operators import messages as ms
from convolytics.operators import scores as sc

T0 = datetime(2024, 1, 1)
SCHEMA = "uid string, tid string, turn int, role string, body string, created_at timestamp"


def talk(spark, lines, tid="t"):
    rows = [
        ("u", tid, i, role, body, T0 + timedelta(minutes=i))
        for i, (role, body) in enumerate(lines)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    "lines, text",
    [
        ([], ""),
        ([("sys", "only rules")], ""),
        ([("ast", "Shall we start?")], "ast: Shall we start?"),
        (
            [("ast", "\tWhere to?"), ("sys", "note"), ("usr", "the station \n"), ("usr", "please")],
            "ast: Where to?\nusr: the station\nusr: please",
        ),
        ([("usr", "two\nlines"), ("ast", "\n")], "usr: two\nlines\nast:"),
    ],
)
def test_dialogue(spark, lines, text):
    listed = spark.createDataFrame([("u", "t")], "uid string, tid string")
    assert ms.dialogue(talk(spark, lines), transcripts=listed).first().text == text


def test_number_and_assemble(spark):
    rows = talk(spark, [("sys", "s"), ("usr", "a"), ("ast", "b"), ("usr", "c")])
    numbered = ms.number_messages(rows)
    mids = {r.body: r.mid for r in numbered.collect()}
    assert mids == {"s": "SYS0", "a": "USR1", "b": "AST2", "c": "USR3"}
    header = spark.createDataFrame([("u", "t", "live"), ("u", "x", "live")], "uid string, tid string, status string")
    assembled = ms.assemble(numbered, header).withColumn("mids", F.map_keys("messages"))
    docs = {r.tid: r for r in assembled.collect()}
    assert docs["t"].mids == ["SYS0", "USR1", "AST2", "USR3"]
    assert docs["t"].messages["AST2"].body == "b"
    assert docs["x"].messages == {} and docs["x"].part == 0


def test_finalize_is_idempotent(spark):
    rows = talk(spark, [("usr", "a")], "t1").unionByName(talk(spark, [("ast", "b")], "t2"))
    header = spark.createDataFrame([("u", f"t{i}", "live") for i in (1, 2, 3)], "uid string, tid string, status string")
    once = ms.finalize(header, rows)
    assert {r.tid: r.status for r in once.collect()} == {"t1": "final", "t2": "empty", "t3": "empty"}
    none = spark.createDataFrame([], "uid string, tid string, status string")
    marks = ms.finalize_sentinels(once, none)
    assert marks.count() == 3
    assert ms.finalize_sentinels(ms.finalize(once, rows), marks).count() == 0


def test_gate_takes_live_only(spark):
    rows = talk(spark, [("usr", "a")], "t1").unionByName(talk(spark, [("usr", "b")], "t2"))
    rows = rows.unionByName(talk(spark, [("usr", "c")], "t3"))
    state = spark.createDataFrame([("u", "t1", "live"), ("u", "t2", "final")], "uid string, tid string, status string")
    good, bad = ms.gate_live(rows, state)
    assert [r.body for r in good.collect()] == ["a"]
    assert {r.body: r.reason for r in bad.collect()} == {
        "b": "transcript is final", "c": "transcript not found"
    }


def test_needs_reply(spark):
    rows = spark.createDataFrame(
        [("a", 0, "usr"), ("a", 1, "ast"), ("b", 0, "ast"), ("b", 1, "sys")],
        "prompt_id string, pos int, role string",
    )
    assert [r.prompt_id for r in ms.needs_reply(rows).collect()] == ["b"]


def _scores(spark, vocab, grammar):
    rows = [("u", "t", i, "usr", "vocab", s) for i, s in enumerate(vocab)]
    rows += [("u", "t", i, "usr", "grammar", s) for i, s in enumerate(grammar)]
    rows += [("u", "t", 99, "ast", "vocab", 0)]
    return spark.createDataFrame(
        rows, "uid string, tid string, mid int, role string, dim string, score int"
    )


def test_score_rollup(spark):
    df = sc.transcript_scores(_scores(spark, [5, 1, None, 1, 9, 4], [None, 7]))
    got = {r.dim: (r.median, r.mad, r.n) for r in df.collect()}
    assert got == {"vocab": (4.0, 3.0, 5), "grammar": (7.0, 0.0, 1)}


def test_no_scores_no_row(spark):
    assert sc.transcript_scores(_scores(spark, [None], [None])).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 14), min_size=1, max_size=30))
def test_median_and_mad(spark, values):
    from statistics import median

    m = median(values)
    row = sc.transcript_scores(_scores(spark, values, []).where("role = 'usr'")).first()
    assert (row.median, row.mad, row.n) == (m, median(abs(v - m) for v in values), len(values))


@pytest.mark.parametrize("scale", list(dims.SCALES))
def test_ranks_round_trip(spark, scale):
    df = spark.createDataFrame([(n.lower(), scale) for n in dims.SCALES[scale]], "n string, s string")
    good, bad = sc.rank_of(df, "n", "s")
    assert [r.value for r in good.orderBy("value").collect()] == list(range(len(dims.SCALES[scale])))
    assert bad.count() == 0


def test_rfc3339_and_strip(spark):
    row = spark.sql("SELECT timestamp'2023-01-02 03:04:05' a, timestamp'2023-01-02 03:04:05.5' b").select(
        scalars.rfc3339(F.col("a")), scalars.rfc3339(F.col("b")),
        scalars.py_strip(F.lit(" \t\x1c x y　\n")),
    ).first()
    assert list(row) == ["2023-01-02T03:04:05+00:00", "2023-01-02T03:04:05.500000+00:00", "x y"]


def test_audio_ordinal(spark):
    df = spark.createDataFrame([("a/b/12-usr.wav",), ("7-x",), ("a/b.wav",)], "p string")
    got = [r[0] for r in df.select(scalars.audio_ordinal(F.col("p"))).collect()]
    assert got == [12, 7, None]


def test_split_then_union_restores(spark):
    rows = talk(spark, [("usr", "a"), ("ast", "b"), ("sys", "c"), (None, "d")])
    users, assistants, rejects = ms.split_live(rows)
    together = ms.union_live(users, assistants)
    assert sorted(r.body for r in together.collect()) == ["a", "b"]
    assert sorted(r.body for r in rejects.collect()) == ["c", "d"]
