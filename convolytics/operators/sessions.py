"""Activities, plans, transcripts to start, and learner streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolytics.functions import dims
from convolytics.functions.scalars import plan_id, transcript_id, voice_language, voice_type


def latest_acts(acts: DataFrame, n: int = 16) -> DataFrame:
    """Newest ``n`` activities per type and language; those without a time are left out.

    Each task keeps at most ``n`` rows of a group before the shuffle.
    """
    newest = Window.partitionBy("atp", "bcp47").orderBy(
        F.col("created_at").desc(), F.col("aid").desc()
    )
    return (
        acts.where(F.col("created_at").isNotNull())
        .withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= n)
    )


def resolve_plans(
    wanted: DataFrame, plans: DataFrame, acts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Plan and activity of each wanted (uid, pid), or the reason why there is none."""
    found = plans.withColumn("_plan", F.lit(True))
    known = acts.select("atp", "bcp47", "aid").withColumn("_act", F.lit(True))
    joined = wanted.join(found, ["uid", "pid"], "left").join(known, ["atp", "bcp47", "aid"], "left")
    reason = (
        F.when(F.col("_plan").isNull(), "plan not found")
        .when(F.col("atp").isNull(), "plan has no activity type")
        .when(~F.col("atp").isin(*dims.ACT_TYPES), "invalid activity type")
        .when(~F.col("atp").isin(*dims.RUNNABLE_TYPES), "unsupported activity type")
        .when(F.col("_act").isNull(), "activity not found")
    )
    marked = joined.withColumn("reason", reason).drop("_plan", "_act")
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(
        F.col("reason").isNotNull()
    )


def with_voice(df: DataFrame) -> DataFrame:
    """Add ``voice``: language and type read from the model name, or the default voice."""
    model = F.coalesce("voice_model", F.concat(F.col("bcp47"), F.lit("-Standard-A")))
    return df.withColumn(
        "voice",
        F.struct(
            voice_language(model).alias("bcp47"),
            model.alias("model"),
            F.lit(0).alias("gender"),
            voice_type(model).alias("type"),
        ),
    ).drop("voice_model")


def plans_from_acts(acts: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """A plan for each learner from the latest activity of each runnable type.

    One activity per type and language is left before the join, so a learner gets at
    most as many plans as there are runnable types.
    """
    latest = latest_acts(acts.where(F.col("atp").isin(*dims.RUNNABLE_TYPES)), 1)
    subscribers = users.select("uid", F.col("language").alias("bcp47"))
    return subscribers.join(latest.select("aid", "atp", "bcp47"), "bcp47").withColumn(
        "pid", plan_id(as_of, F.col("atp"), F.col("uid"), F.col("aid"))
    )


def transcripts_from_plans(plans: DataFrame, as_of: Column) -> DataFrame:
    """A live transcript for each plan."""
    return plans.select(
        "uid", "aid", "atp", "pid", "bcp47",
        F.lit("live").alias("status"),
        as_of.alias("created_at"),
        transcript_id(as_of, F.col("bcp47"), F.col("uid"), F.col("pid")).alias("tid"),
    )


def streaks(transcripts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Current streak per learner: count of consecutive UTC days, last time, last transcript.

    A day counts when a transcript became ``final`` on it. With ``as_of`` later days don't
    count, and a streak that ended before the day before is 0. Rows shrink to learner and
    day first.
    """
    done = F.col("status") == "final"
    if as_of is not None:
        done = done & (F.col("ended_at") <= as_of)
    days = (
        transcripts.where(done)
        .groupBy("uid", F.to_date("ended_at").alias("day"))
        .agg(F.max(F.struct("ended_at", "tid")).alias("_last"))
    )
    by_day = Window.partitionBy("uid").orderBy("day")
    islands = days.withColumn("_run", F.date_sub("day", F.row_number().over(by_day)))
    runs = islands.groupBy("uid", "_run").agg(
        F.count(F.lit(1)).alias("count"),
        F.max("day").alias("day"),
        F.max("_last").alias("_last"),
    )
    count = F.max_by("count", "day")
    if as_of is not None:
        alive = F.max("day") >= F.date_sub(F.to_date(as_of), 1)
        count = F.when(alive, count).otherwise(F.lit(0))
    return (
        runs.groupBy("uid")
        .agg(count.alias("count"), F.max("_last").alias("_last"))
        .select("uid", "count", F.col("_last.ended_at").alias("last"), "_last.tid")
    )
