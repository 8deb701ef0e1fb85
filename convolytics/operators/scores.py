"""Score rows of messages and their roll-up per transcript."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.functions import dims


def each_score(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The score dimensions a message has, as rows. One int column per dimension comes in."""
    names = [d for d in dims.SCORE_DIMS if d in df.columns]
    long = df.unpivot(list(keys), names, "dim", "score")
    return long.where(F.col("score").isNotNull()).withColumn(
        "scale", dims.lookup(dims.SCORE_DIMS, F.col("dim"))
    )


def rank_value(name: Column, scale: Column) -> Column:
    """Value of a name in its scale, whatever the case; NULL when unknown."""
    table = {f"{s}/{n}": str(v) for s, ns in dims.SCALES.items() for v, n in enumerate(ns)}
    return dims.lookup(table, F.concat(scale, F.lit("/"), F.upper(name))).cast("int")


def rank_of(df: DataFrame, name: str, scale: str) -> tuple[DataFrame, DataFrame]:
    """Add ``value`` for a name in the scale named by the column ``scale``."""
    marked = df.withColumn("value", rank_value(F.col(name), F.col(scale)))
    return marked.where(F.col("value").isNotNull()), marked.where(
        F.col("value").isNull()
    ).drop("value").withColumn("reason", F.lit("unknown name"))


def rankings(ranks: DataFrame) -> DataFrame:
    """Names of each scale in order, as one text."""
    return ranks.groupBy("scale").agg(F.expr(
        "listagg(name, ', ') WITHIN GROUP (ORDER BY value)"
    ).alias("ranking"))


def transcript_scores(scores: DataFrame, keys: Sequence[str] = ("uid", "tid")) -> DataFrame:
    """Exact median, median absolute deviation and count of learner scores.

    Scores are ordinals of at most 15 values, so rows shrink to a histogram per
    transcript and dimension before anything else happens.
    """
    group = [*keys, "dim"]
    histogram = (
        scores.where((F.col("role") == "usr") & F.col("score").isNotNull())
        .groupBy(*group, "score")
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    # At most 15 bars per group: small lists, and the same shuffle serves both medians.
    bars = histogram.groupBy(*group).agg(
        F.percentile("score", 0.5, F.col("freq")).alias("median"),
        F.sum("freq").alias("n"),
        F.collect_list(F.struct("score", "freq")).alias("bars"),
    )
    return (
        bars.select(*group, "median", "n", F.inline("bars"))
        .groupBy(*group)
        .agg(
            F.first("median").alias("median"),
            F.percentile(F.abs(F.col("score") - F.col("median")), 0.5, F.col("freq")).alias("mad"),
            F.first("n").alias("n"),
        )
    )
