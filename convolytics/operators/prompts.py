"""Prompt corpora as tables: continuation lines, parsing, templates, composing.

A prompt file is one row, so lines are joined, classified and checked inside the row
and no step before templates needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolytics.functions import dims
from convolytics.functions.scalars import let, once, py_strip, template_var
from convolytics.sources.prompts import clean_lines

BACKSLASH = "\\"


def continued(lines: Column) -> Column:
    """Join each line that ends with a backslash to the next one, with a newline."""
    pieces = F.split(F.array_join(lines, "\n"), r"(?<!\\)\n")
    joined = F.transform(pieces, lambda x: F.replace(x, F.lit(BACKSLASH + "\n"), F.lit("\n")))
    any_goes_on = F.exists(lines, lambda x: F.endswith(x, F.lit(BACKSLASH)))
    return F.when(any_goes_on, joined).otherwise(lines)


def join_continuations(files: DataFrame, lines: str = "lines") -> tuple[DataFrame, DataFrame]:
    """Join continuation lines in the array column ``lines``; dangling ones are rejects."""
    dangling = F.coalesce(
        F.endswith(F.try_element_at(F.col(lines), F.lit(-1)), F.lit(BACKSLASH)), F.lit(False)
    )
    good = files.where(~dangling).withColumn(lines, continued(F.col(lines)))
    return good, files.where(dangling).withColumn(
        "reason", F.lit("the last line ends with a backslash")
    )


def _parse_line(line: Column, functions: Sequence[str] | None) -> Column:
    head = F.lower(py_strip(F.substring_index(line, ":", 1)))
    colon = F.locate(":", line)
    rest = py_strip(F.when(colon > 0, F.substr(line, colon + 1)).otherwise(F.lit("")))
    return let(
        F.struct(head.alias("head"), rest.alias("rest")),
        lambda x: _classified(line, x["head"], x["rest"], functions),
    )


def _classified(line, head, rest, functions):
    models = {**dims.CHAT_MODELS, **{v: v for v in dims.CHAT_MODELS.values()}}
    model = dims.lookup(models, head)
    is_func = head == "func"
    kind = (
        F.when(head.isin(*models), "model")
        .when(is_func, "func")
        .when(head.isin(*dims.ROLES), "msg")
    )
    colons = F.length(line) - F.length(F.replace(line, F.lit(":"), F.lit("")))
    unknown = ~rest.isin(*functions) if functions is not None else F.lit(False)
    reason = (
        F.when(~head.isin(*models, *dims.ROLES), "unknown role")
        .when(is_func & (colons != 1), "a function line has one colon")
        .when(is_func & unknown, "unknown function")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(~head.isin(*models), head).alias("role"),
        F.when(head.isin(*models), model).otherwise(rest).alias("body"),
        reason.alias("reason"),
    )


def parse_prompts(
    files: DataFrame, functions: Sequence[str] | None = None, lines: str = "lines"
) -> tuple[DataFrame, DataFrame]:
    """Lines of prompts as (file_id, pos, kind, role, body); kind is model, func or msg.

    A prompt with a bad line is left out; its bad lines are the rejects.
    """
    parsed = once(files, _p=F.transform(lines, lambda x: _parse_line(x, functions)))
    bad = F.exists("_p", lambda p: p["reason"].isNotNull())
    good = parsed.where(~bad).select("file_id", F.posexplode("_p").alias("pos", "_l"))
    rejects = (
        parsed.where(bad)
        .select("file_id", F.posexplode(F.arrays_zip(F.col(lines).alias("line"), "_p")).alias("pos", "_l"))
        .select("file_id", "pos", F.col("_l").getField("line").alias("line"), F.col("_l._p.reason").alias("reason"))
        .where(F.col("reason").isNotNull())
    )
    return good.select("file_id", "pos", "_l.kind", "_l.role", "_l.body"), rejects


def read_prompts(
    files: DataFrame, functions: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """From file texts to prompt lines and rejects."""
    lined = once(files, lines=clean_lines(F.col("text"))).select("file_id", "lines")
    good, dangling = join_continuations(lined)
    prompts, bad = parse_prompts(good, functions)
    whole = dangling.select(
        "file_id",
        (F.size("lines") - 1).alias("pos"),
        F.try_element_at("lines", F.lit(-1)).alias("line"),
        "reason",
    )
    return prompts, bad.unionByName(whole)


def prompt_models(prompts: DataFrame) -> DataFrame:
    """The model of each prompt: its last model line, else the default."""
    at = F.when(F.col("kind") == "model", F.col("pos"))
    return prompts.groupBy("file_id").agg(
        F.coalesce(F.max_by("body", at), F.lit(dims.DEFAULT_MODEL)).alias("model")
    )


def template_vars(prompts: DataFrame) -> DataFrame:
    """The first variable of each system message."""
    found = once(prompts.where(F.col("role") == "sys"), var=template_var(F.col("body")))
    return found.where(F.col("var").isNotNull()).select("file_id", "pos", "var")


def substitute(prompts: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill template variables from ``params(file_id, var, value)``.

    A prompt is rejected for a parameter it does not have, for a missing parameter,
    and for a variable that is left (only the first one of a message is filled, and
    only when written without spaces). One row per prompt tells the first reason.
    """
    # A prompt is one text, so its lines and parameters fit one group.
    given = (
        params.groupBy("file_id", "var")
        .agg(F.max("value").alias("value"))
        .groupBy("file_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("var", F.col("value").cast("string"))))
             .alias("_given"))
    )
    none = F.expr("map()").cast("map<string,string>")
    rows = once(
        prompts.join(given, "file_id", "left"),
        _var=F.when(F.col("role") == "sys", template_var(F.col("body"))),
        _all=F.coalesce("_given", none),
    )
    var = F.col("_var")
    value = F.try_element_at("_all", var)
    filled = F.replace(F.col("body"), F.concat(F.lit("{{"), var, F.lit("}}")), value)
    done = once(rows, _body=F.coalesce(filled, F.col("body")))

    prompt = Window.partitionBy("file_id")
    left = template_var(F.col("_body"))
    own = F.when(var.isNotNull() & value.isNull(), F.struct(F.lit(2).alias("why"), var.alias("var"))).when(
        (F.col("role") == "sys") & left.isNotNull(), F.struct(F.lit(3).alias("why"), left.alias("var"))
    )
    seen = done.withColumns(
        {"_vars": F.collect_set(var).over(prompt), "_worst": F.min(own).over(prompt)}
    )
    unknown = F.array_min(F.array_except(F.map_keys("_all"), "_vars"))
    judged = once(
        seen,
        _bad=let(
            unknown,
            lambda name: F.when(
                name.isNotNull(), F.struct(F.lit(1).alias("why"), name.alias("var"))
            ).otherwise(F.col("_worst")),
        ),
    )
    good = judged.where(F.col("_bad").isNull()).withColumn("body", F.col("_body"))
    why = F.element_at(
        F.array(F.lit("unknown parameter"), F.lit("missing parameter"), F.lit("variable is left")),
        F.col("_f.why"),
    )
    rejects = (
        judged.where(F.col("_bad").isNotNull())
        .groupBy("file_id")
        .agg(F.min("_bad").alias("_f"))
        .select("file_id", why.alias("reason"), "_f.var")
    )
    return good.select(*prompts.columns), rejects


def guard_templates(prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep prompts without variables left."""
    left = template_vars(prompts)
    marks = left.select("file_id").distinct()
    return prompts.join(marks, "file_id", "left_anti"), left.withColumn(
        "reason", F.lit("template not substituted")
    )


def compose(base: Column, messages: Column, mode: str = "append", extra: Column | None = None):
    """Put session messages into a prompt, all being arrays of messages.

    ``append``: prompt, extra prompt, messages. ``prepend``: messages, then the prompt.
    ``insert``: messages before the last four of the prompt.
    """
    if mode == "append":
        blocks = [base, messages] if extra is None else [base, extra, messages]
        return F.concat(*blocks)
    if mode == "prepend":
        return F.concat(messages, base)
    if mode == "insert":
        head = F.greatest(F.size(base) - 4, F.lit(0))
        return F.concat(
            F.slice(base, F.lit(1), head), messages, F.slice(base, head + 1, F.lit(4))
        )
    raise ValueError(f"unknown mode {mode}")


def compose_parts(base: Column, messages: Column, mode: str = "append", extra: Column | None = None):
    """``compose`` for one part of a long list (columns ``part`` and ``parts``): what comes
    before the messages goes to the first part, what comes after them to the last."""
    none = F.slice(base, F.lit(1), F.lit(0))
    head = F.greatest(F.size(base) - 4, F.lit(0))
    if mode == "append":
        before, after = base if extra is None else F.concat(base, extra), none
    elif mode == "prepend":
        before, after = none, base
    elif mode == "insert":
        before, after = F.slice(base, F.lit(1), head), F.slice(base, head + 1, F.lit(4))
    else:
        raise ValueError(f"unknown mode {mode}")
    first, last = F.col("part") == 0, F.col("part") == F.col("parts") - 1
    return F.concat(
        F.when(first, before).otherwise(none), messages, F.when(last, after).otherwise(none)
    )
