"""Model requests: building, de-duplicating, completing, picking, joining back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.functions import dims
from convolytics.functions.scalars import let, once, template_var
from convolytics.operators.backends import NO_REPLY, Backend, distinct_requests
from convolytics.scale import renamed, same_keys
from convolytics.schemas import CHAT
from convolytics.session import cut

EMPTY_BIAS = "map<string,double>"
#: Messages to a part of a request about a long talk.
PART_MESSAGES = 1_000


@dataclass(frozen=True)
class Effect:
    """What a kind of request asks for. Prompt lines are (role, text)."""

    name: str
    prompt: tuple[tuple[str, str], ...] = ()
    model: str = dims.DEFAULT_MODEL
    n: int = 1
    max_tokens: int = 128
    stop: tuple[str, ...] | None = ("\n",)
    presence_penalty: float | None = None
    top_p: float | None = None
    response_format: str | None = None
    fixed: dict[str, str] = field(default_factory=dict)


def message(role: str, body: Column) -> Column:
    """A chat message in the short form used until requests are built."""
    return F.struct(F.lit(role).alias("role"), body.alias("body"))


def prompt_messages(effect: Effect, **variables: Column) -> Column:
    """The prompt of an effect as an array, its variables filled in."""
    out = []
    for role, text in effect.prompt:
        for name, value in effect.fixed.items():
            text = text.replace("{{" + name + "}}", value)
        body = F.lit(text)
        for name, value in variables.items():
            if "{{" + name + "}}" in text:
                body = F.replace(body, F.lit("{{" + name + "}}"), value)
        out.append(message(role, body))
    return F.array(*out)


def _number(value: float | None) -> Column:
    return F.lit(value).cast("double").alias("_")


def params_of(effect: Effect, bias: Column | None = None) -> Column:
    stop = F.lit(None).cast("array<string>")
    if effect.stop is not None:
        stop = F.array(*[F.lit(s) for s in effect.stop])
    if bias is None:
        bias = F.lit(None).cast(EMPTY_BIAS)
    return F.struct(
        F.lit(effect.n).alias("n"),
        F.lit(effect.max_tokens).alias("max_tokens"),
        stop.alias("stop"),
        _number(effect.presence_penalty).alias("presence_penalty"),
        _number(effect.top_p).alias("top_p"),
        F.lit(effect.response_format).cast("string").alias("response_format"),
        bias.alias("logit_bias"),
    )


def _unfilled(talk: Column) -> Column:
    left = F.exists(talk, lambda m: (m["role"] == "sys") & template_var(m["body"]).isNotNull())
    return F.coalesce(left, F.lit(False))


def _wire(talk: Column) -> Column:
    wire = F.transform(
        talk,
        lambda m: F.struct(
            dims.lookup(dims.ROLES, m["role"]).alias("role"), m["body"].alias("content")
        ),
    )
    return wire.cast(f"array<{CHAT}>")


def request_id(*more: str) -> Column:
    """The id of a request, from its columns.

    Never NULL, and known to be so: a join on it needs no check that hashes again.
    """
    ident = F.to_json(F.struct("effect", "model", "messages", "params", *more))
    return F.coalesce(F.sha2(ident, 256), F.lit(""))


def request_fields(effect: Effect, chat: Column, bias: Column | None = None) -> list[Column]:
    """``effect``, ``model``, ``messages`` and ``params`` of a request, as columns."""
    return [
        F.lit(effect.name).alias("effect"),
        F.lit(effect.model).alias("model"),
        _wire(chat).alias("messages"),
        params_of(effect, bias).alias("params"),
    ]


def _joined(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """Rows with their completions, ``_found`` where there is one.

    Both sides are dealt by id at every size: the planner's estimate knows nothing of exploded
    terms and would send millions of completions through the driver as a broadcast.
    """
    return rows.join(picked.withColumn("_found", F.lit(True)).hint("merge"), "request_id", "left")


def completed(requests: DataFrame, keep: Sequence[str], backend: Backend) -> DataFrame:
    """Rows of ``keep`` with the ``reply`` to each request, or the ``reason`` why there is none."""
    joined = _joined(requests.select(*keep, "request_id"), pick(backend(requests)))
    reason = F.when(F.col("_found"), F.col("error")).otherwise(F.lit(NO_REPLY))
    return joined.select(*keep, F.when(reason.isNull(), F.col("reply")).alias("reply"), reason.alias("reason"))


def build_requests(
    df: DataFrame,
    effect: Effect,
    keys: Sequence[str],
    chat: str = "chat",
    bias: str | None = None,
    check_user: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Requests from rows with an array ``chat`` of (role, body).

    Adds ``request_id``, ``effect``, ``model``, ``messages`` and ``params``; equal
    requests have equal ids. Rejects: a template variable is left, or the last message
    is already the assistant's (with ``check_user``). Rows of last parts come with the
    hash of the parts ``before`` them and whether a variable is left there (``unfilled``).
    """
    in_parts = "before" in df.columns

    def read(talk: Column) -> Column:
        unfilled = _unfilled(talk)
        if in_parts:
            unfilled = unfilled | F.coalesce("unfilled", F.lit(False))
        reason = F.when(F.size(talk) == 0, "no messages").when(
            F.coalesce(unfilled, F.lit(False)), "template not substituted"
        )
        if check_user:
            last = F.try_element_at(F.transform(talk, lambda m: m["role"]), F.lit(-1))
            reason = reason.when(last == "ast", "the last message is from the assistant")
        return F.struct(reason.alias("reason"), _wire(talk).alias("messages"))

    marked = once(df, _c=let(F.col(chat), read))
    built = marked.where(F.col("_c.reason").isNull()).withColumns(
        {
            "effect": F.lit(effect.name),
            "model": F.lit(effect.model),
            "messages": F.col("_c.messages"),
            "params": params_of(effect, None if bias is None else F.col(bias)),
        }
    )
    rejects = marked.where(F.col("_c.reason").isNotNull())
    return (
        # Where nothing lies before, it is NULL and not part of the text.
        built.drop("_c").withColumn("request_id", request_id(*(["before"] if in_parts else []))),
        rejects.select(*keys, F.col("_c.reason").alias("reason")),
    )


def complete(requests: DataFrame, backend: Backend) -> DataFrame:
    """Completions of the distinct requests; what has no reply is an error."""
    asked = requests.select("request_id").distinct()
    done = asked.join(backend(requests), "request_id", "left")
    nothing = F.col("choices").isNull() & F.col("error").isNull()
    return done.withColumn("error", F.when(nothing, F.lit(NO_REPLY)).otherwise(F.col("error")))


def pick(completions: DataFrame) -> DataFrame:
    """The first choice of each completion; ``odd_role`` marks one not by the assistant."""
    first = F.try_element_at(F.col("choices"), F.lit(1))
    return completions.select(
        "request_id",
        first["content"].alias("reply"),
        (first["role"] != "assistant").alias("odd_role"),
        F.when(first.isNull(), F.coalesce("error", F.lit("no choice"))).alias("error"),
    )


def ask(
    df: DataFrame,
    effect: Effect,
    keys: Sequence[str],
    backend: Backend,
    chat: str = "chat",
    keep: Sequence[str] = (),
    bias: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``keys``, ``keep`` and ``reply``, and rejects of ``keys`` and ``reason``."""
    requests, rejects = build_requests(df, effect, keys, chat, bias)
    return _answered(requests, requests, rejects, keys, keep, backend)


def _answered(requests, sent, rejects, keys, keep, backend):
    # Rows look their completion up directly: only a backend that sends requests has
    # to make them distinct.
    joined = _joined(requests.select(*keys, *keep, "request_id"), pick(backend(sent)))
    good = joined.where(F.col("_found") & F.col("error").isNull()).select(*keys, *keep, "reply")
    reason = F.when(F.col("_found"), F.col("error")).otherwise(F.lit(NO_REPLY)).alias("reason")
    failed = joined.where(F.col("_found").isNull() | F.col("error").isNotNull())
    return good, rejects.unionByName(failed.select(*keys, reason))


def lookup(df: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join by ``keys`` in which NULL equals NULL."""
    right = renamed(right, keys)
    return df.join(right, same_keys(df, right, keys), how).drop(*[f"r_{k}" for k in keys])


def _before(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For the last part of each list: the hash of all parts before it, from their hashes."""
    return lists.select(
        *keys,
        F.size("_l").cast("long").alias("part"),
        F.sha2(F.array_join(F.transform("_l", lambda x: x["hash"]), ""), 256).alias("before"),
        F.exists("_l", lambda x: x["left"]).alias("unfilled"),
    )


def _starts(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each part but the first: the chain of hashes of the parts before it."""

    def step(chain: Column, x: Column) -> Column:
        last = F.element_at(chain, -1)
        link = F.struct(
            F.sha2(F.concat(last["start"], x["hash"]), 256).alias("start"),
            (last["unfilled"] | x["left"]).alias("unfilled"),
        )
        return F.concat(chain, F.array(link))

    first = F.array(F.struct(F.lit("").alias("start"), F.lit(False).alias("unfilled")))
    each = lists.select(*keys, F.posexplode(F.aggregate("_l", first, step)).alias("part", "_s"))
    return each.where(F.col("part") > 0).select(*keys, F.col("part").cast("long").alias("part"), "_s.*")


def _hash_lists(earlier: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The hashes of the earlier parts of each list, in order: one for ``PART_MESSAGES`` messages."""
    mark = F.struct(
        "part", F.sha2(F.to_json("messages"), 256).alias("hash"), F.col("_unfilled").alias("left")
    )
    return earlier.groupBy(*keys).agg(F.array_sort(F.collect_list(mark)).alias("_l"))


def _earlier(parts: DataFrame, group: Sequence[str], chat: Column) -> DataFrame:
    inner = parts.where(F.col("part") < F.col("parts") - 1)
    return inner.select(*group, "part", _wire(chat).alias("messages"), _unfilled(chat).alias("_unfilled"))


def one_part(parts: DataFrame) -> bool:
    """Whether all lists are one part, as nearly always; ``parts`` is a written table."""
    return parts.where(F.col("parts") > 1).isEmpty()


FIELDS = ["request_id", "effect", "model", "params", "n"]


def _sent(built: DataFrame, earlier: DataFrame | None, group: Sequence[str], joined: bool) -> DataFrame:
    """A row per part of each request, for backends that read what is sent."""
    sent = built.select(*FIELDS, "messages", "part", F.lit(True).alias("last"))
    if earlier is not None:
        longer = built.where(F.col("part") > 0).select(*group, *FIELDS, F.col("part").alias("_upto"))
        others = lookup(longer, earlier.drop("_unfilled"), group, "inner").where(
            F.col("part") < F.col("_upto")
        )
        sent = sent.unionByName(
            others.select(*FIELDS, "messages", "part", F.lit(False).alias("last"))
        )
    return sent.withColumn("joined", F.lit(joined))


def ask_in_parts(
    parts: DataFrame,
    effect: Effect,
    group: Sequence[str],
    backend: Backend,
    bias: str | None = None,
    joined: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``ask`` about lists of any length, which come in rows of bounded parts.

    ``parts`` has ``group``, ``part`` (from 0), ``parts``, ``n`` (messages of the request)
    and ``chat``, the messages of the part; it is written once and read from there. The request
    id is that of the last part and the hashes of the parts before it; a request of one
    part has the id that ``ask`` gives. The backend gets a row per part, with ``part``,
    ``last``, ``n`` and ``joined`` (the last message goes on in the next part). What reads
    the rows of ``last`` only never makes the others.
    """
    group = list(group)
    parts = cut(parts)
    if one_part(parts):
        built, rejects = build_requests(parts, effect, group, bias=bias)
        return _answered(built, _sent(built, None, group, joined), rejects, group, (), backend)
    earlier = _earlier(parts, group, F.col("chat"))
    last = parts.where(F.col("part") == F.col("parts") - 1)
    marked = lookup(last, _before(_hash_lists(earlier, group), group), [*group, "part"])
    built, rejects = build_requests(marked, effect, group, bias=bias)
    return _answered(built, _sent(built, earlier, group, joined), rejects, group, (), backend)


def ask_prefixes(
    parts: DataFrame, effect: Effect, group: Sequence[str], key: str, role: str, backend: Backend
) -> tuple[DataFrame, DataFrame]:
    """Ask about each message by ``role`` with the prompt and all messages up to it.

    ``parts`` has ``group``, ``part``, ``parts`` and ``talk``, an array of (role, body, ``key``).
    A message is hashed once: the hash of a prefix is that of the prefix before it and of its
    last message, so that a request is one row with an id, however long the talk before it.
    Only a backend that reads what is sent makes the prefixes.
    """
    group = list(group)
    keys = [*group, key]
    parts = cut(parts)
    prompt = prompt_messages(effect)

    def plain(talk: Column) -> Column:
        return F.transform(talk, lambda m: F.struct(m["role"], m["body"]))

    earlier = None
    if one_part(parts):
        marked = parts.withColumns({"start": F.lit(""), "unfilled": F.lit(False)})
    else:
        first = F.when(F.col("part") == 0, prompt).otherwise(F.slice(prompt, F.lit(1), F.lit(0)))
        earlier = _earlier(parts, group, F.concat(first, plain(F.col("talk"))))
        starts = _starts(_hash_lists(earlier, group), group)
        marked = lookup(parts, starts, [*group, "part"]).withColumns(
            {"start": F.coalesce("start", F.lit("")), "unfilled": F.coalesce("unfilled", F.lit(False))}
        )

    def link(chain: Column, m: Column) -> Column:
        said = F.to_json(F.struct(m["role"], m["body"]))
        return F.concat(chain, F.array(F.sha2(F.concat(F.element_at(chain, -1), said), 256)))

    links = F.aggregate("talk", F.array("start"), link)
    open_ = F.array_position(F.transform("talk", lambda m: _unfilled(F.array(m))), True)
    chained = once(marked, links=links, _open=open_)
    each = chained.select(
        *group, "part", "unfilled", "_open",
        F.posexplode(F.arrays_zip("talk", F.slice("links", F.lit(2), F.size("talk")).alias("link"))).alias("_i", "_m"),
    ).where(F.col("_m.talk.role") == role)
    left = F.col("unfilled") | ((F.col("_open") > 0) & (F.col("_open") <= F.col("_i") + 1)) | _unfilled(prompt)
    asked = each.select(
        *group, F.col(f"_m.talk.{key}").alias(key), "part", "_i",
        F.when(left, F.lit("template not substituted")).alias("reason"),
        F.lit(effect.name).alias("effect"), F.lit(effect.model).alias("model"),
        params_of(effect).alias("params"), _wire(prompt).alias("messages"),
        F.col("_m.link").alias("upto"),
        (F.col("part") * PART_MESSAGES + F.col("_i") + 1 + len(effect.prompt)).alias("n"),
    )
    built = asked.where(F.col("reason").isNull()).withColumn("request_id", request_id("upto"))
    rejects = asked.where(F.col("reason").isNotNull()).select(*keys, "reason")
    here = renamed(parts.select(*group, "part", "talk"), [*group, "part"])
    begun = F.when(F.col("part") == 0, F.col("messages")).otherwise(F.slice("messages", F.lit(1), F.lit(0)))
    whole = built.join(here, same_keys(built, here, [*group, "part"])).withColumn(
        "messages",
        F.concat(begun, _wire(plain(F.slice("talk", F.lit(1), F.col("_i") + 1)))),
    )
    return _answered(built, _sent(whole, earlier, group, False), rejects, keys, (), backend)


def logit_bias(
    vocab: DataFrame,
    token_table: DataFrame,
    keys: Sequence[str],
    bias: float = 5.0,
    overrides: str | None = None,
) -> DataFrame:
    """Token bias maps: every token of every term gets ``bias``.

    ``vocab`` has the array ``vocab`` (and maybe a map ``overrides`` that wins);
    ``token_table`` has ``term`` and ``token_ids``.
    """
    keys = list(keys)
    words = vocab.select(*keys, F.explode(F.array_distinct("vocab")).alias("term"))
    table = token_table.select("term", F.col("token_ids").cast("array<string>").alias("_ids"))
    tokens = words.join(table, "term").select(*keys, F.explode("_ids").alias("token"))
    # A list of terms comes in as one row, so its tokens fit one row as well.
    maps = (
        tokens.groupBy(*keys)
        .agg(F.array_sort(F.collect_set("token")).alias("_t"))
        .select(
            *keys,
            F.map_from_arrays("_t", F.transform("_t", lambda _: F.lit(float(bias)))).alias("_m"),
        )
    )
    empty = F.expr("map()").cast(EMPTY_BIAS)
    own = empty if overrides is None else F.coalesce(F.col(overrides), empty)
    merged = F.map_zip_with(
        F.coalesce("_m", empty), own, lambda _, ours, theirs: F.coalesce(theirs, ours)
    )
    return vocab.join(maps, keys, "left").withColumn("logit_bias", merged).drop("_m")


def token_usage(completions: DataFrame, requests: DataFrame) -> DataFrame:
    """Tokens spent per model and effect."""
    asked = requests.select("request_id", "model", "effect").distinct()
    return (
        completions.join(asked, "request_id")
        .groupBy("model", "effect")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("usage.prompt_tokens").alias("prompt_tokens"),
            F.sum("usage.completion_tokens").alias("completion_tokens"),
            F.sum("usage.total_tokens").alias("total_tokens"),
        )
    )
