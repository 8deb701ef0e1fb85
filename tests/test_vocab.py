"""Ledger, selection, sizes and term matching."""

import random
from datetime import UTC, datetime, timedelta
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convolytics.operators import terms as tm
from convolytics.operators import vocab as vo

#: term -> (uses, day of the first use, day of the last)
LEDGER = {
    "river": (6, 1, 9), "stone": (0, 2, 2), "bridge": (3, 3, 8), "boat": (3, 4, 4),
    "reed": (1, 5, 7), "otter": (2, 6, 6),
}


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [
        ("u", "en", t, n, datetime(2023, 5, first), datetime(2023, 5, last))
        for t, (n, first, last) in LEDGER.items()
    ]
    return spark.createDataFrame(
        rows, "uid string, bcp47 string, term string, n_usgs int, first timestamp, last timestamp"
    )


@pytest.mark.parametrize(
    "args, want",
    [
        ({}, ["stone", "bridge", "boat", "reed", "otter"]),
        ({"max_usg": 7}, list(LEDGER)),
        ({"max_usg": 1}, ["stone"]),
        ({"as_of": 6}, ["stone", "boat", "otter"]),
        ({"as_of": 1}, []),
    ],
)
def test_select_vocabulary(ledger, args, want):
    if "as_of" in args:
        args = {**args, "as_of": F.lit(f"2023-05-0{args['as_of']}").cast("timestamp")}
    rows = vo.select_vocabulary(ledger, **args).orderBy("rank").collect()
    assert [r.term for r in rows] == want
    assert [r.rank for r in rows] == list(range(1, len(want) + 1))


def test_select_few(ledger):
    every = [r.term for r in vo.select_vocabulary(ledger).orderBy("rank").collect()]
    for n in (1, 2, 4):
        rows = vo.select_vocabulary(ledger, n=n).orderBy("rank").collect()
        assert len(rows) == n and {r.term for r in rows} <= set(every)


USES = "uid string, bcp47 string, term string, tid string, mid string, used_correctly boolean, when timestamp"


def uses(spark, spots):
    rows = [
        ("u", "en", t, f"t{i}", f"USR{j}", None, datetime(2024, 1, 1 + i, j)) for t, i, j in spots
    ]
    return spark.createDataFrame(rows, USES)


def docs(df):
    return sorted(
        (r.term, r.part, tuple((u.tid, u.mid) for u in r.usgs), r.first, r["last"])
        for r in df.collect()
    )


spots = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 3), st.integers(0, 3)), max_size=12)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(spots, spots)
def test_merge_equals_build_and_is_idempotent(spark, a, b):
    old = vo.build_user_vocab(vo.distinct_uses(uses(spark, a)))
    once = vo.merge_user_vocab(old, uses(spark, b))
    assert docs(once) == docs(vo.build_user_vocab(vo.distinct_uses(uses(spark, a + b))))
    assert docs(vo.merge_user_vocab(once, uses(spark, b))) == docs(once)


def test_usage_stats_of_unknown_flags(spark):
    row = vo.usage_stats(uses(spark, [("a", 0, 0)])).first()
    assert (row.n, row.correct, row.incorrect, row.pct_correct) == (1, 0, 0, 0.0)


def test_first_use(spark):
    df = uses(spark, [("a", 0, 1), ("a", 0, 0), ("b", 1, 0), ("a", 1, 0)])
    flags = {(r.term, r.tid, r.mid): r.is_first for r in vo.flag_first_use(df).collect()}
    assert {k for k, v in flags.items() if v} == {("a", "t0", "USR0"), ("b", "t1", "USR0")}
    new = {(r.tid, r.mid): r.n_new for r in vo.new_terms(df).collect()}
    assert new == {("t0", "USR0"): 1, ("t1", "USR0"): 1}


def test_pages(ledger):
    pages = {r.term: r.page for r in vo.paginate(ledger, 3).collect()}
    assert [pages[t] for t in LEDGER] == [0, 0, 0, 1, 1, 1]


def test_terms(spark):
    df = spark.createDataFrame([("I'm well-known, well I'm! 42",), ("",)], "body string")
    got = [(r.pos, r.term) for r in vo.extract_terms(df).collect()]
    assert got == [(0, "i'm"), (1, "well-known"), (2, "well"), (3, "42")]


def rows_of(spark, words, mid="m"):
    return spark.createDataFrame([("u", "t", mid, w) for w in words], "uid string, tid string, mid string, term string")


@pytest.mark.parametrize("a, b, ratio", [("asdf", "asdF", 0.75), ("asdf", "asdf", 1.0), ("asdf", "qwer", 0.0)])
def test_similarity(spark, a, b, ratio):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(tm.block_ratio(F.col("a"), F.col("b"))).first()[0] == ratio


def test_block_ratio_equals_difflib(spark):
    """Random words over few letters, so that blocks tie and nest; also with a floor."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(0, 14)))
    pairs = [(a, b) for a, b in ((word(), word()) for _ in range(1500)) if a or b]
    pairs += [(a, a[:3] + a[4:5] + a[3:4] + a[5:]) for a in (word() + word() for _ in range(300)) if a]
    df = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", tm.block_ratio(F.col("a"), F.col("b")).alias("r"),
        tm.block_ratio(F.col("a"), F.col("b"), 0.7).alias("floored"),
    )
    for r in df.collect():
        want = SequenceMatcher(None, r.a, r.b).ratio()
        assert r.r == want, (r.a, r.b)
        assert r.floored == want if want >= 0.7 else r.floored < 0.7


def test_soft_match_of_long_texts(spark):
    """Texts over the JVM's bound are scored all the same."""
    a, b = "ab" * 60, "ab" * 58 + "xy"
    got = tm.soft_match(rows_of(spark, [a]), rows_of(spark, [b]), 0.75).first()
    assert (got.reply_term, got.ratio) == (b, SequenceMatcher(None, a, b).ratio())


def brute(asked, given, floor):
    """The same rule by comparing all pairs."""
    out, used = {}, set()
    for a in asked:
        same = [g for g in given if g.lower() == a.lower()]
        if same:
            out[a] = (min(same), 1.0)
            used |= {g.lower() for g in same}
    left = [g for g in given if g.lower() not in used]
    for a in asked:
        scored = [(-SequenceMatcher(None, a, g).ratio(), g) for g in left]
        if a not in out and scored and -min(scored)[0] >= floor:
            out[a] = (min(scored)[1], -min(scored)[0])
    return out


words = st.lists(st.text("abcdAü", min_size=1, max_size=7), max_size=9, unique=True)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(words, words, st.sampled_from([0.3, 0.6, 0.75, 0.8, 1.0]))
def test_soft_match_equals_all_pairs(spark, asked, given_, floor):
    got = tm.soft_match(rows_of(spark, asked), rows_of(spark, given_), floor)
    assert {r.term: (r.reply_term, r.ratio) for r in got.collect()} == brute(asked, given_, floor)


def test_soft_match_case_first(spark):
    got = tm.soft_match(rows_of(spark, ["Hola", "soy"]), rows_of(spark, ["hola", "Holo", "sox"]), 0.6)
    assert {r.term: r.reply_term for r in got.collect()} == {"Hola": "hola", "soy": "sox"}


def one_message(spark, asked, replies):
    words = rows_of(spark, asked).selectExpr("struct(mid) AS _k", "term AS text", "true AS asked")
    return words.unionByName(rows_of(spark, replies).selectExpr("struct(mid) AS _k", "term AS text", "false AS asked"))


def test_soft_match_scores_no_words_of_the_same_letters_only(spark):
    words = one_message(spark, ["abcdefgh", "listen"], ["hgfedcba", "silent", "listne"])
    got = tm._candidates(words, 0.8).collect()
    assert [(r.term, r.reply_term) for r in got] == [("listen", "listne")]


def test_pairs_are_scored_after_they_are_made_distinct(spark):
    """The filter by ratio does not take the scoring below the distinct."""
    pairs = spark.createDataFrame([("listen", "listne")] * 3, "term string, reply_term string").distinct()
    plan = tm.rated(pairs, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [term"):plan.index("LogicalRDD")]
    assert "aggregate(" not in below


@pytest.mark.parametrize("floor", [0.3, 0.6, 0.8])
def test_soft_match_of_long_messages_equals_all_pairs(spark, monkeypatch, floor):
    """Messages of many words meet by marks; short ones in the same call do not."""
    monkeypatch.setattr(tm, "MANY_WORDS", 10)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdAü0😀") for _ in range(rng.randint(1, 8)))
    lists = {m: (list({word() for _ in range(n)}), list({word() for _ in range(n)})) for m, n in (("a", 40), ("b", 4))}
    asked, replies = (
        rows_of(spark, lists["a"][i], "a").unionByName(rows_of(spark, lists["b"][i], "b")) for i in (0, 1)
    )
    got = tm.soft_match(asked, replies, floor).collect()
    for m, (a, b) in lists.items():
        assert {r.term: (r.reply_term, r.ratio) for r in got if r.mid == m} == brute(a, b, floor)


def test_soft_match_of_null_keys(spark):
    """NULL equals NULL in the keys, for equal and for similar words."""
    got = tm.soft_match(rows_of(spark, ["Hola", "listen"], None), rows_of(spark, ["hola", "listne"], None))
    assert {r.term: r.reply_term for r in got.collect()} == {"Hola": "hola", "listen": "listne"}


def test_repair(spark):
    e = "array<struct<key:string,value:string>>"
    df = spark.createDataFrame(
        [
            (1, ["a", "b"], [("b", "1"), ("a", "2")]),
            (2, ["a", "b"], [("A", "1"), ("b", "2")]),
            (3, ["a", "b"], [("a", "1")]),
        ],
        f"id int, terms array<string>, entries {e}",
    )
    good, bad = tm.repair_keys(df)
    got = {r.id: [(x.key, x.value) for x in r.entries] for r in good.collect()}
    assert got == {1: [("b", "1"), ("a", "2")], 2: [("a", "1"), ("b", "2")]}
    assert [r.id for r in bad.collect()] == [3]


def test_json_entries_last_value_wins(spark):
    df = spark.createDataFrame([('{"a": "1", "b": "2", "a": "3"}',), ("nope",), ('["a"]',)], "r string")
    got = [r[0] for r in df.select(tm.json_entries(F.col("r"))).collect()]
    assert [(x.key, x.value) for x in got[0]] == [("a", "3"), ("b", "2")]
    assert got[1:] == [None, None]


def test_select_keeps_no_clock(ledger):
    # Without as_of nothing is cut, whatever today is.
    late = ledger.withColumn("last", F.lit(datetime.now(UTC) + timedelta(days=900)))
    assert vo.select_vocabulary(late).count() == 5
