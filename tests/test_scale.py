"""Positions within groups, by the plain and by the hot-group path."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from convolytics.scale import ordered_parts, rank_rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of 3000 rows in one group, some without a group, times with ties."""
    i = F.col("id")
    return spark.range(3000).select(
        F.when(i % 3 == 0, 0).when(i % 50 == 1, None).otherwise(i % 97).alias("g"),
        (i * 7919 % 501).alias("t"), i,
    )


@pytest.mark.parametrize("rows_per_task", [10_000, 400, 100, 7])
@pytest.mark.parametrize("desc", [False, True])
def test_rank_rows_equals_window(skewed, rows_per_task, desc):
    order = [F.col("t").desc() if desc else F.col("t"), F.col("id")]
    want = skewed.withColumn(
        "rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)) - 1
    )
    got = rank_rows(skewed, ["g"], order, "rn", rows_per_task)
    assert got.columns == ["g", "t", "id", "rn"]
    rows = {(r.id, r.rn) for r in got.collect()}
    assert rows == {(r.id, r.rn) for r in want.collect()}


def test_hot_group_is_spread_over_tasks(skewed):
    from convolytics.scale import _rank_hot

    hot = skewed.where("g = 0")
    ranked = _rank_hot(hot, ["g"], [F.col("t"), F.col("id")], "rn", 8)
    assert ranked.count() == hot.count()
    assert ranked.agg(F.max("rn")).first()[0] == hot.count() - 1


def test_ordered_parts_are_bounded_and_whole(skewed):
    parts = ordered_parts(
        skewed, ["g"], [F.col("t"), F.col("id")], F.col("id"), 64, "ids", rows_per_task=100
    )
    assert parts.agg(F.max(F.size("ids"))).first()[0] == 64
    assert parts.agg(F.sum(F.size("ids"))).first()[0] == 3000
    want = [r.id for r in skewed.where("g = 0").orderBy("t", "id").collect()]
    hot = parts.where("g = 0").orderBy("part").collect()
    assert [x for r in hot for x in r.ids] == want
    assert len(hot) == -(-len(want) // 64)


def test_limits_run_before_the_shuffle(spark, skewed):
    from convolytics.operators.sessions import latest_acts
    from convolytics.operators.vocab import select_vocabulary

    acts = skewed.select(
        F.col("g").alias("atp"), F.lit("en-US").alias("bcp47"), F.col("id").alias("aid"),
        F.timestamp_seconds("t").alias("created_at"),
    )
    ledger = skewed.select(
        F.col("g").alias("uid"), F.lit("en-US").alias("bcp47"), F.col("id").alias("term"),
        F.lit(1).alias("n_usgs"), F.timestamp_seconds("t").alias("first"),
        F.timestamp_seconds("t").alias("last"),
    )
    for df in (latest_acts(acts), select_vocabulary(ledger)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan


def test_small_limits_make_no_tiny_ranges(spark):
    from convolytics.scale import ROWS_PER_TASK, _ranges

    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert _ranges(spark, 1_000_000, 20) == usual
    assert _ranges(spark, 3, 20) == 2
    assert _ranges(spark, 1000 * usual * ROWS_PER_TASK, 20) == 1000 * usual


def test_many_hot_groups_are_placed_together(skewed, monkeypatch):
    from convolytics import scale

    order = [F.col("t"), F.col("id")]
    want = skewed.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)) - 1)
    monkeypatch.setattr(scale, "MAX_BROADCAST_KEYS", 1)
    got = rank_rows(skewed, ["g"], order, "rn", 7)
    assert "Anti" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.rn) for r in got.collect()} == {(r.id, r.rn) for r in want.collect()}


def _written(monkeypatch):
    """Columns of the tables that hot groups are written to."""
    from convolytics import scale

    seen, cut = [], scale.cut

    def noted(df):
        seen.append(set(df.columns))
        return cut(df)

    monkeypatch.setattr(scale, "cut", noted)
    return seen


def test_numbering_writes_no_bodies(spark, monkeypatch):
    from convolytics.catalog import QUERIES

    seen = _written(monkeypatch)
    assert QUERIES["w1_number_long_groups"](spark, "/root/testdata/sf0.01").count() > 0
    assert seen == [{"uid", "tid", "turn", "role", "created_at", "_task"}]


def test_dialogue_writes_each_line_once(spark, monkeypatch):
    from convolytics.catalog import QUERIES

    seen = _written(monkeypatch)
    assert QUERIES["a2_dialogue_parts"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [{"uid", "tid", "turn", "created_at", "_v", "_task"}]
