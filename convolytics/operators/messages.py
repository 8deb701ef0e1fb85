"""Messages and transcripts: roles, numbering, assembly, status, live routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolytics.functions import dims
from convolytics.functions.scalars import py_strip
from convolytics.scale import ordered_parts, rank_rows

KEY = ["uid", "tid"]
TIME_ORDER = ["created_at", "turn"]
PART_ROWS = 10_000


def _by_time(order: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in order]


def map_roles(df: DataFrame, to: str = "wire") -> tuple[DataFrame, DataFrame]:
    """Translate ``role`` to the chat wire (``to='wire'``) or back (``to='short'``)."""
    names = dims.ROLES if to == "wire" else {v: k for k, v in dims.ROLES.items()}
    mapped = df.withColumn("_role", dims.lookup(names, F.col("role")))
    good = mapped.where(F.col("_role").isNotNull()).withColumn("role", F.col("_role"))
    rejects = mapped.where(F.col("_role").isNull()).withColumn("reason", F.lit("unknown role"))
    return good.drop("_role"), rejects.drop("_role")


def chat_struct(role: Column, body: Column) -> Column:
    return F.struct(dims.lookup(dims.ROLES, role).alias("role"), body.alias("content"))


def to_chat(df: DataFrame) -> DataFrame:
    """Add ``chat``: the wire form ``{role, content}`` of a message."""
    return df.withColumn("chat", chat_struct(F.col("role"), F.col("body")))


def filter_roles(df: DataFrame, roles: Sequence[str] = ("ast", "usr")) -> DataFrame:
    return df.where(F.col("role").isin(*roles))


def explode_vocab(df: DataFrame, vocab: str = "vocab") -> DataFrame:
    """One row per annotated term of a message; ``vocab`` is a map from term to a struct."""
    rest = [c for c in df.columns if c != vocab]
    return df.select(*rest, F.explode(vocab).alias("term", "_v")).select(*rest, "term", "_v.*")


def number_messages(
    messages: DataFrame,
    keys: Sequence[str] = KEY,
    order: Sequence[str] = TIME_ORDER,
    **scale: int,
) -> DataFrame:
    """Add ``mid``: the upper-case role and the position over all roles, from 0."""
    ranked = rank_rows(messages, keys, _by_time(order), "_rn", **scale)
    return ranked.withColumn(
        "mid", F.concat(F.upper("role"), F.col("_rn").cast("string"))
    ).drop("_rn")


def ordered(
    messages: DataFrame, keys: Sequence[str] = KEY, order: Sequence[str] = TIME_ORDER
) -> DataFrame:
    """Messages in time order. A long transcript may run over several partitions."""
    return messages.orderBy(*keys, *order)


def assemble(
    messages: DataFrame,
    transcripts: DataFrame,
    keys: Sequence[str] = KEY,
    part_rows: int = PART_ROWS,
    **scale: int,
) -> DataFrame:
    """Transcript documents: the header and a map ``messages`` keyed by mid, in time order.

    Transcripts longer than ``part_rows`` continue in further parts.
    """
    body = [c for c in messages.columns if c not in (*keys, "mid")]
    entry = F.struct(F.col("mid").alias("key"), F.struct(*body).alias("value"))
    parts = ordered_parts(
        messages, keys, [F.col("created_at"), F.col("mid")], entry, part_rows, "_m", **scale
    )
    docs = parts.withColumn("messages", F.map_from_entries("_m")).drop("_m")
    empty = F.expr("map()").cast(docs.schema["messages"].dataType)
    return transcripts.join(docs, list(keys), "left").withColumns(
        {"part": F.coalesce("part", F.lit(0)), "messages": F.coalesce("messages", empty)}
    )


def chat_line() -> Column:
    return F.concat(F.col("role"), F.lit(": "), py_strip(F.col("body")))


def dialogue(
    messages: DataFrame,
    roles: Sequence[str] = ("ast", "usr"),
    transcripts: DataFrame | None = None,
    keys: Sequence[str] = KEY,
    order: Sequence[str] = TIME_ORDER,
    part_rows: int = PART_ROWS,
    **scale: int,
) -> DataFrame:
    """``role: body`` lines in time order, ``''`` for listed transcripts without any.

    Texts of more than ``part_rows`` lines go on in further parts; white space at the end
    is dropped from the last one.
    """
    # Rows of hot groups are written: each holds its line once, and not the body beside it.
    lines = filter_roles(messages, roles).select(
        *dict.fromkeys([*keys, *order]), chat_line().alias("_v")
    )
    parts = ordered_parts(lines, keys, _by_time(order), F.col("_v"), part_rows, "_l", **scale)
    joined = F.array_join("_l", "\n")
    last = F.max("part").over(Window.partitionBy(*keys)) == F.col("part")
    texts = parts.withColumn("text", F.when(last, py_strip(joined)).otherwise(joined)).drop("_l")
    if transcripts is None:
        return texts
    listed = transcripts.select(*keys).distinct()
    return listed.join(texts, list(keys), "left").withColumns(
        {"part": F.coalesce("part", F.lit(0)), "text": F.coalesce("text", F.lit(""))}
    )


def last_updated(
    transcripts: DataFrame, messages: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """Add the time of the latest message, or of creation when there is none."""
    latest = messages.groupBy(*keys).agg(F.max("created_at").alias("_latest"))
    return (
        transcripts.join(latest, list(keys), "left")
        .withColumn("last_updated", F.coalesce("_latest", "created_at"))
        .drop("_latest")
    )


def finalize(
    transcripts: DataFrame, messages: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """Set ``status``: ``final`` when the learner said anything, else ``empty``."""
    spoken = messages.groupBy(*keys).agg(F.bool_or(F.col("role") == "usr").alias("_usr"))
    status = F.when(F.col("_usr"), F.lit("final")).otherwise(F.lit("empty"))
    return (
        transcripts.join(spoken, list(keys), "left").withColumn("status", status).drop("_usr")
    )


def finalize_sentinels(
    finalized: DataFrame, sentinels: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """New (transcript, status) marks only, so that a second run adds nothing."""
    marks = [*keys, "status"]
    return finalized.select(*marks).distinct().join(sentinels, marks, "left_anti")


def union_live(user_messages: DataFrame, assistant_messages: DataFrame) -> DataFrame:
    return user_messages.unionByName(assistant_messages)


def split_live(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Learner messages, assistant messages, and all others as rejects."""
    role = F.coalesce("role", F.lit(""))
    rejects = messages.where(~role.isin("usr", "ast"))
    return (
        messages.where(role == "usr"),
        messages.where(role == "ast"),
        rejects.withColumn("reason", F.lit("only usr and ast messages are live")),
    )


def gate_live(
    new_messages: DataFrame, transcripts: DataFrame, keys: Sequence[str] = KEY
) -> tuple[DataFrame, DataFrame]:
    """Let messages pass to live transcripts only."""
    state = transcripts.select(*keys, F.col("status").alias("_status"))
    joined = new_messages.join(state, list(keys), "left")
    reason = F.when(F.col("_status").isNull(), F.lit("transcript not found")).when(
        F.col("_status") != "live", F.concat(F.lit("transcript is "), F.col("_status"))
    )
    marked = joined.withColumn("reason", reason).drop("_status")
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(
        F.col("reason").isNotNull()
    )


def patch_messages(
    messages: DataFrame, patches: DataFrame, keys: Sequence[str] = ("uid", "tid", "mid")
) -> DataFrame:
    """Replace the given fields of single messages; NULL leaves a field as it is.

    ``patches`` holds the keys, ``seq`` and any message columns. The latest patch of a
    field wins.
    """
    fields = [c for c in patches.columns if c not in (*keys, "seq")]
    latest = patches.groupBy(*keys).agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
            for c in fields
        ]
    )
    joined = messages.join(latest, list(keys), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).select(
        *messages.columns
    )


def needs_reply(prompt_messages: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Conversations whose last message is not the assistant's."""
    last = prompt_messages.groupBy(key).agg(F.max_by("role", "pos").alias("last_role"))
    return last.where(F.col("last_role") != "ast")
