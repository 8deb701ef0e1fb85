"""What the operators share: written intermediate tables, column hygiene, components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolytics.session import shared_dir

#: A table of ids is broadcast up to this many rows (16 bytes each); a larger one is joined.
MAX_BROADCAST_ROWS = 1_000_000


#: Rows per Arrow batch: texts may be long, and a batch lies in memory on both sides.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> SparkSession:
    """Set the session's Arrow batches to ``BATCH_ROWS`` rows, as texts need."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def tidy(run):
    """``run``, a map over Arrow batches; the worker gives its freed memory back at the end.

    Workers are used again by later tasks, also by those of other steps, so that what one step
    needed for a moment would count for all that follow.
    """

    def mapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return mapped


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the written rows."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_column(df: DataFrame, name: str) -> F.Column:
    """``name`` as string, nulls as the empty text."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``MAX_BROADCAST_ROWS`` rows."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= MAX_BROADCAST_ROWS else df


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), component the least node.

    Alternates large-star and small-star steps, so that the number of rounds grows with
    the logarithm of the longest path. Edges stay distributed; a node with very many
    neighbours is aggregated before the shuffle and its join is split by adaptive
    execution. Self loops keep lone nodes in the result; null nodes have no component.
    """
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where(
        F.col("u").isNotNull() & F.col("v").isNotNull()
    )
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    edges = keep(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        name,
    )
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = keep(small, name)
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == state or not now[0]:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return (
        nodes.join(roots, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )
