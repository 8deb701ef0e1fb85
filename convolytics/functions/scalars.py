"""Column functions. All of them stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters and digits, with hyphens or apostrophes only inside a term.
TERM = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"


# Characters that count as white space at the ends of a text.
WHITE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def rfc3339(when: Column) -> Column:
    """Time as text, with microseconds only when there are any."""
    whole = when == F.date_trunc("second", when)
    return F.when(whole, F.date_format(when, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    )


def py_strip(text: Column) -> Column:
    """Drop all Unicode white space (and separators 28-31) at both ends."""
    return F.btrim(text, F.lit(WHITE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, also where later filters use them.

    A filter on a plain column is moved below it and computes the expression again.
    """
    fields = [c.alias(name) for name, c in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*fields))))


def short_hash(length: int, *keys: Column) -> Column:
    """Letters and digits that follow from the keys, in place of random ones."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/", "Aa"), 1, length)


def transcript_id(when: Column, bcp47: Column, *keys: Column) -> Column:
    return F.concat_ws("-", short_hash(12, *keys), F.date_format(when, "yyMMdd-HHmmss"), bcp47)


def plan_id(when: Column, atp: Column, *keys: Column, length: int = 6) -> Column:
    return F.concat_ws("-", short_hash(length, *keys), atp, F.date_format(when, "yyyyMMdd-HHmmss"))


def activity_id(when: Column, atp: Column, *keys: Column) -> Column:
    return plan_id(when, atp, *keys, length=4)


def voice_language(model: Column) -> Column:
    return F.substring_index(model, "-", 2)


def voice_type(model: Column) -> Column:
    return F.try_element_at(F.split(model, "-"), F.lit(-2))


def audio_ordinal(path: Column) -> Column:
    """The whole number before the first ``-`` of the file name."""
    return F.substring_index(F.substring_index(path, "/", -1), "-", 1).try_cast("long")


def terms_of(body: Column) -> Column:
    """Distinct terms of a text in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(TERM), F.lit(0)))


def template_var(body: Column) -> Column:
    """The first ``{{...}}`` of a text without outer spaces, NULL when there is none."""
    inner = F.substring_index(F.substring_index(body, "{{", 2), "{{", -1)
    inner = F.substring_index(inner, "}}", 1)
    return F.when(F.contains(body, F.lit("{{")) & F.contains(body, F.lit("}}")), py_strip(inner))


def language_part(tag: Column) -> Column:
    return F.lower(F.substring_index(F.replace(py_strip(tag), F.lit("_"), F.lit("-")), "-", 1))


def territory_part(tag: Column) -> Column:
    """Two letters or three digits after the language (and script), upper case."""
    return F.upper(
        F.nullif(
            F.regexp_extract(
                F.replace(py_strip(tag), F.lit("_"), F.lit("-")),
                r"^[A-Za-z]{2,3}(?:-[A-Za-z]{4})?-([A-Za-z]{2}|[0-9]{3})(?:-|$)",
                1,
            ),
            F.lit(""),
        )
    )
