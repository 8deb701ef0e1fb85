"""Order within groups, also where one group holds a large share of all rows.

A window or a collected list puts a whole group into one task. The helpers here
first look at the largest group (one aggregated row comes back). Usual groups take
a plain window. The rows of larger groups are range-partitioned by key and order,
so that a group spans as many tasks as it needs, and positions are put together
from counts per task. Where larger groups are many, all rows are placed that way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolytics.session import cut

ROWS_PER_TASK = 2_000_000
#: Up to so many keys of hot groups are broadcast; with more, all rows go the hot groups' way.
MAX_BROADCAST_KEYS = 10_000


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of ``left[k]`` and ``right['r_' + k]``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"r_{k}"]) for k in keys])


def renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"r_{k}" for k in keys})


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``name``: the 0-based position of each row in its group.

    ``order`` must be total within a group (end it with the row's own key).
    """
    keys = list(keys)
    plain = Window.partitionBy(*keys).orderBy(*order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    over = F.col("_n") > rows_per_task
    top = sizes.agg(
        F.count_if(over).alias("groups"),
        F.sum(F.when(over, F.col("_n"))).alias("rows"),
        F.sum("_n").alias("every"),
    )
    groups, rows, every = top.first()
    if not groups:
        return df.withColumn(name, (F.row_number().over(plain) - 1).cast("long"))
    if groups > MAX_BROADCAST_KEYS:
        return _rank_hot(df, keys, order, name, _ranges(df.sparkSession, every, rows_per_task))

    hot = F.broadcast(renamed(sizes.where(over).select(*keys), keys))
    cold_rows = df.join(hot, same_keys(df, hot, keys), "left_anti")
    hot_rows = df.join(hot, same_keys(df, hot, keys), "left_semi")
    cold_rows = cold_rows.withColumn(name, (F.row_number().over(plain) - 1).cast("long"))
    tasks = _ranges(df.sparkSession, rows, rows_per_task)
    return cold_rows.unionByName(_rank_hot(hot_rows, keys, order, name, tasks))


def _ranges(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Ranges of ``rows_per_task`` rows, but no more than the session's shuffle partitions
    unless they would be larger than ``ROWS_PER_TASK``: a small limit makes no tiny tasks."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(usual, -(-rows // ROWS_PER_TASK))
    return max(2, min(-(-rows // rows_per_task), most))


def _rank_hot(df, keys, order, name, tasks):
    placed = cut(
        df.repartitionByRange(tasks, *keys, *order).withColumn("_task", F.spark_partition_id())
    )
    here = Window.partitionBy("_task", *keys)
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_task", *keys).agg(F.count(F.lit(1)).alias("_n"))
    # Ranges follow the key, so only the first group of a task can have begun in an
    # earlier task: fewer rows than tasks are left after the filter.
    before = renamed(
        counts.withColumn("_before", F.sum("_n").over(earlier))
        .where(F.col("_before") > 0)
        .drop("_n"),
        ["_task", *keys],
    )
    joined = placed.join(before, same_keys(placed, before, ["_task", *keys]), "left")
    position = F.row_number().over(here.orderBy(*order)) - 1 + F.coalesce("_before", F.lit(0))
    return joined.withColumn(name, position.cast("long")).select(*df.columns, name)


def ordered_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    part_rows: int,
    out: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Ordered lists of ``value`` per group, at most ``part_rows`` to a row.

    Nearly every group is one row, ``part`` 0. A longer group goes on in parts 1, 2, ...
    """
    ranked = rank_rows(df.withColumn("_v", value), keys, order, "_rn", rows_per_task)
    return (
        ranked.withColumn("part", F.floor(F.col("_rn") / part_rows))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "_v"))).alias("_ranked"))
        .withColumn(out, F.transform("_ranked", lambda x: x["_v"]))
        .drop("_ranked")
    )
