"""Where completions come from: recorded replies, or a client called in batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolytics.schemas import COMPLETION, USAGE
from convolytics.session import cut

# From rows with a ``request_id`` (and the request, where it must be sent) to completions
# by request id. There may be completions of other requests as well.
Backend = Callable[[DataFrame], DataFrame]
NO_REPLY = "no recorded completion"
TOO_LONG = "transcript too long for a request"
COLUMNS = ["request_id", "choices", "usage", "attempts", "error"]


def replay(recorded: DataFrame, unique: bool = False) -> Backend:
    """Answer requests from a table of recorded completions.

    Of several rows of a request id one counts; ``unique`` says that there are none, as in
    what ``batch`` and ``recorded_reply`` write.
    """
    rows = recorded.select(*COLUMNS)
    one = rows if unique else rows.dropDuplicates(["request_id"])
    return lambda requests: one


def distinct_requests(requests: DataFrame) -> DataFrame:
    """One row per request id; equal requests are merged before the shuffle.

    Of a request in parts that is its last part, with ``n``, the messages of all parts.
    """
    fields = ["effect", "model", "messages", "params"]
    if "part" in requests.columns:
        requests, fields = requests.where("last"), [*fields, "n"]
    return requests.groupBy("request_id").agg(*[F.first(c).alias(c) for c in fields])


def whole_requests(requests: DataFrame) -> DataFrame:
    """One row per request id with all its messages, as a client needs them."""
    if "part" not in requests.columns:
        return distinct_requests(requests)
    fields = ["effect", "model", "messages", "params", "joined"]
    parts = requests.groupBy("request_id", "part").agg(*[F.first(c).alias(c) for c in fields])
    rows = parts.groupBy("request_id").agg(
        *[F.first(c).alias(c) for c in ("effect", "model", "params", "joined")],
        F.array_sort(F.collect_list(F.struct("part", "messages"))).alias("_p"),
    )
    lists = F.transform("_p", lambda p: p["messages"])
    # Joined: the last message goes on from part to part.
    start = F.element_at(lists, 1)
    text = F.array_join(F.transform(lists, lambda m: F.element_at(m, -1)["content"]), "")
    long = F.struct(F.element_at(start, -1)["role"].alias("role"), text.alias("content"))
    joined = F.concat(F.slice(start, F.lit(1), F.size(start) - 1), F.array(long))
    messages = F.when(F.col("joined"), joined).otherwise(F.flatten(lists))
    return rows.select("request_id", "effect", "model", messages.alias("messages"), "params")


def recorded_reply(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Completions of one assistant choice from rows of ``request_id`` and a reply text."""
    choice = F.struct(
        F.lit(0).alias("index"),
        F.lit("stop").alias("finish_reason"),
        F.lit("assistant").alias("role"),
        F.col(reply).alias("content"),
    )
    return replies.groupBy("request_id").agg(F.min(reply).alias(reply)).select(
        "request_id",
        F.array(choice).alias("choices"),
        F.lit(None).cast(USAGE).alias("usage"),
        F.lit(1).alias("attempts"),
        F.lit(None).cast("string").alias("error"),
    )


def batch(
    make_client: Callable[[], Callable[[dict], dict]],
    known: DataFrame | None = None,
    retries: int = 3,
    backoff_sec: float = 5.0,
    partitions: int | None = None,
    max_messages: int | None = None,
) -> Backend:
    """Call a client once for each distinct request that ``known`` does not answer.

    ``make_client`` runs once per task and gives a function from a request (dict) to
    ``{"choices": [...], "usage": {...}}``. Requests in parts are put together for it;
    those of more than ``max_messages`` messages, if given, become an error without a
    call. A call is tried again ``retries`` times;
    then its error becomes the row. ``partitions`` bounds how many calls run at once.
    New completions are written to the shared folder before anything uses them, so a
    lost executor does not lead to a second round of calls.
    """
    schema = T.StructType.fromDDL(COMPLETION)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            rows = [_try(client, r, retries, backoff_sec) for r in frame.to_dict("records")]
            yield pd.DataFrame(rows, columns=COLUMNS)

    def answer(requests: DataFrame) -> DataFrame:
        new = requests
        if known is not None:
            new = new.join(known.select("request_id"), "request_id", "left_anti")
        refused = None
        if max_messages is not None:
            n = F.col("n") if "part" in new.columns else F.size("messages")
            refused = new.where(n > max_messages).select("request_id").distinct()
            new = new.where(n <= max_messages)
        new = whole_requests(new)
        if partitions is not None:
            new = new.repartition(partitions)
        called = cut(new.mapInPandas(call, schema))
        if refused is not None:
            called = called.unionByName(_refused(refused))
        if known is None:
            return called
        return called.unionByName(known.select(*COLUMNS))

    return answer


def _refused(ids: DataFrame) -> DataFrame:
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in T.StructType.fromDDL(COMPLETION)[1:]}
    return ids.withColumns(nothing | {"attempts": F.lit(0), "error": F.lit(TOO_LONG)})


def _try(client, request: dict, retries: int, backoff_sec: float) -> dict:
    error = None
    for attempt in range(1, retries + 2):
        try:
            done = client(request)
            return {"request_id": request["request_id"], "choices": done["choices"],
                    "usage": done.get("usage"), "attempts": attempt, "error": None}
        except Exception as exc:  # the error is the result
            error = f"{type(exc).__name__}: {exc}"
            if attempt <= retries:
                time.sleep(backoff_sec)
    return {"request_id": request["request_id"], "choices": None, "usage": None,
            "attempts": retries + 1, "error": error}
