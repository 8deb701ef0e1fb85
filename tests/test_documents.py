"""Stored documents: paths, reading, writing operators, flattening."""

import json

import pytest
from pyspark.sql import functions as F

from convolytics.operators import docs as op
from convolytics.sources.documents import explode_messages, export_json, parse_paths, read_docs


@pytest.mark.parametrize(
    "path, want",
    [
        ("users/u1", ("user", "u1")),
        ("users/u1/plans/p1", ("plan", "u1")),
        ("users/u1/transcripts/t1", ("transcript", "u1")),
        ("users/u1/vocab/en-US", ("vocab", "u1")),
        ("acts/min/en-US/a1", ("act", None)),
        ("languages/es-MX", ("language", None)),
        ("users", "odd number of parts"),
        ("users/u1/plans", "odd number of parts"),
        ("users/None", "empty part"),
        ("users/u1//x", "empty part"),
        ("other/x", "unknown collection"),
        ("acts/zzz/en-US/a1", "invalid activity type"),
        ("acts/min/en/a1", "invalid language"),
        ("acts/min/en-QQ/a1", "invalid language"),
        (None, "no path"),
    ],
)
def test_paths(spark, path, want):
    good, bad = parse_paths(spark.createDataFrame([(path,)], "path string"))
    if isinstance(want, str):
        assert good.count() == 0 and bad.first().reason == want
    else:
        assert bad.count() == 0 and tuple(good.first()[c] for c in ("entity", "uid")) == want


TRANSCRIPT = {
    "uid": "wrong", "aid": "a", "status": "live", "topics": ["x"], "other": 1,
    "messages": {
        "USR0": {"role": "usr", "body": "hi", "created_at": "2024-01-01T00:00:00Z",
                 "vocab": {"hi": {"pos": "noun"}}, "score": {"vocab": {"score": 2}}},
        "AST1": {"role": "ast", "body": "hello", "created_at": "2024-01-01T00:00:01Z"},
    },
}


def test_read_transcripts(spark, tmp_path):
    rows = [
        {"path": "users/u/transcripts/t", "data": json.dumps(TRANSCRIPT)},
        {"path": "users/u/transcripts/bad", "data": "{"},
        {"path": "users/u", "data": "{}"},
        {"path": "users", "data": "{}"},
    ]
    (tmp_path / "d.json").write_text("\n".join(json.dumps(r) for r in rows))
    good, bad = read_docs(spark, str(tmp_path), "transcript", "json")
    doc = good.first()
    assert (good.count(), doc.uid, doc.tid, doc.status, doc.topics) == (1, "u", "t", "live", ["x"])
    assert sorted(r.reason for r in bad.collect()) == ["invalid document", "odd number of parts"]
    msgs = {r.mid: r for r in explode_messages(good).collect()}
    assert msgs["USR0"].vocab["hi"].pos == "noun" and msgs["USR0"].score.vocab.score == 2
    assert msgs["AST1"].body == "hello"


def test_export_drops_nulls_and_keys(spark):
    df = spark.sql(
        "SELECT 'u' uid, 't' tid, timestamp'2024-01-01 00:00:00' created_at, "
        "cast(null as string) summary, map('USR0', named_struct('body', 'x', 'at', "
        "timestamp'2024-01-01 00:00:01', 'gone', cast(null as int))) messages"
    )
    row = export_json(df, ["uid", "tid"]).first()
    assert (row.uid, row.tid) == ("u", "t")
    assert json.loads(row.data) == {
        "created_at": "2024-01-01T00:00:00+00:00",
        "messages": {"USR0": {"body": "x", "at": "2024-01-01T00:00:01+00:00"}},
    }


def test_flatten(spark):
    df = spark.sql(
        "SELECT 1 k, named_struct('bar', 1) foo, map() m, map('a', named_struct('s', 2)) score"
    ).withColumn("m", F.col("m").cast("map<string,string>"))
    got = {r.path: r.value for r in op.flatten_docs(df, ["k"]).collect()}
    assert got == {"foo.bar": "1", "m": "{}", "score.a.s": "2"}


def table(spark, rows):
    return spark.createDataFrame(
        rows, "k int, name string, streak struct<count:int,tid:string>, tags map<string,string>"
    )


def test_merge(spark):
    old = table(spark, [(1, "a", (1, "t"), {"x": "1", "y": "2"}), (2, "b", None, None)])
    new = table(spark, [(1, None, (None, "s"), {"y": "3"}), (2, None, (5, None), {"z": "1"}), (3, "c", None, None)])
    got = {r.k: (r.name, r.streak, r.tags) for r in op.merge_docs(old, new, ["k"]).collect()}
    assert got[1] == ("a", (1, "s"), {"x": "1", "y": "3"})
    assert got[2] == ("b", (5, None), {"z": "1"})
    assert got[3] == ("c", None, None)


def test_update_by_path(spark):
    old = table(spark, [(1, "a", (1, "t"), {"x": "1"}), (2, "b", None, None)])
    patches = spark.createDataFrame(
        [
            (1, "streak.count", "2", 1), (1, "streak.count", "3", 2), (1, "tags", '{"q":"r"}', 1),
            (2, "streak.tid", "n", 1), (9, "name", "x", 1), (1, "nope", "x", 1),
        ],
        "k int, path string, value string, seq int",
    )
    result, rejects = op.update_docs(old, patches, ["k"])
    got = {r.k: (r.name, r.streak, r.tags) for r in result.collect()}
    assert got == {1: ("a", (3, "t"), {"q": "r"}), 2: ("b", (None, "n"), None)}
    assert sorted((r.k, r.reason) for r in rejects.collect()) == [
        (1, "unknown field"), (9, "document not found")
    ]


def test_life_of_a_document(spark):
    one = table(spark, [(1, "a", None, None)])
    result, conflicts = op.create_docs(one, table(spark, [(1, "z", None, None), (2, "b", None, None)]), ["k"])
    assert {r.k: r.name for r in result.collect()} == {1: "a", 2: "b"}
    assert [r.k for r in conflicts.collect()] == [1]
    replaced = op.set_docs(result, table(spark, [(1, "z", None, None)]), ["k"])
    assert {r.k: r.name for r in replaced.collect()} == {1: "z", 2: "b"}
    kids = spark.createDataFrame([(1, "m"), (2, "n")], "k int, body string")
    left, kids_left = op.delete_docs(replaced, one, ["k"], [kids])
    assert [r.k for r in left.collect()] == [2] and [r.body for r in kids_left.collect()] == ["n"]


def test_update_below_map_keys(spark):
    old = spark.sql(
        "SELECT 1 k, map('a', '1') tags, map('USR0', named_struct('body', 'x', 'score', "
        "named_struct('vocab', 1))) messages UNION ALL SELECT 2, null, null"
    )
    patches = spark.createDataFrame(
        [
            (1, "tags.b", "2", 1), (1, "messages.USR0.score.vocab", "4", 1),
            (1, "messages.AST1.body", "new", 1), (2, "tags.c", "3", 1), (1, "messages.USR0.no", "x", 1),
        ],
        "k int, path string, value string, seq int",
    )
    result, rejects = op.update_docs(old, patches, ["k"])
    rows = {r.k: r for r in result.collect()}
    assert rows[1].tags == {"a": "1", "b": "2"} and rows[2].tags == {"c": "3"}
    assert rows[1].messages["USR0"] == ("x", (4,)) and rows[1].messages["AST1"] == ("new", None)
    assert rows[2].messages is None
    assert [r.path for r in rejects.collect()] == ["messages.USR0.no"]


def test_flatten_then_update_restores(spark):
    doc = table(spark, [(1, "a", (1, "t"), {"x": "1"}), (2, "b", None, {})])
    empty = table(spark, [(1, None, None, None), (2, "old", (7, "s"), {"y": "2"})])
    patches = op.flatten_docs(doc, ["k"]).withColumn("seq", F.lit(1))
    result, rejects = op.update_docs(empty, patches, ["k"])
    got = {r.k: (r.name, r.streak, r.tags) for r in result.collect()}
    assert got == {1: ("a", (1, "t"), {"x": "1"}), 2: ("b", (7, "s"), {})}
    assert rejects.count() == 0
