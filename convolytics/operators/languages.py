"""Language tags and names, and translation with a memory."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.functions import dims
from convolytics.functions.scalars import language_part, py_strip, territory_part

TEXT = ["text", "source", "target"]


def parse_bcp47(df: DataFrame, col: str = "tag") -> DataFrame:
    """Add ``language`` and ``territory`` of a tag and the tag in normal form.

    Withdrawn codes and three letters where two will do become the code in use.
    """
    lang, land = language_part(F.col(col)), territory_part(F.col(col))
    lang = F.coalesce(dims.lookup(dims.short_codes(df.sparkSession), lang), lang)
    land = F.coalesce(dims.lookup(dims.OLD_COUNTRIES, land), land)
    script = F.nullif(
        F.initcap(F.lower(F.regexp_extract(py_strip(F.col(col)), r"^[A-Za-z]{2,3}[-_]([A-Za-z]{4})(?:[-_]|$)", 1))),
        F.lit(""),
    )
    return df.withColumns(
        {"language": lang, "territory": land, "bcp47": F.concat_ws("-", lang, script, land)}
    )


def match_country(
    df: DataFrame, countries: Sequence[str] | None = None, col: str = "territory"
) -> tuple[DataFrame, DataFrame]:
    """Keep tags of a known country."""
    codes = list(countries or dims.countries(df.sparkSession))
    reason = F.when(F.col(col).isNull(), "no country").when(
        ~F.col(col).isin(*codes), "unknown country"
    )
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(
        F.col("reason").isNotNull()
    )


def match_language(
    df: DataFrame, iso: DataFrame | None = None, col: str = "name"
) -> tuple[DataFrame, DataFrame]:
    """Add the ``code`` of a language (two letters, else three) given by name, code or native name."""
    iso = dims.languages(df.sparkSession) if iso is None else iso
    aliases = dims.language_aliases(iso).withColumnRenamed("alias", col)
    joined = df.join(aliases, col, "left")
    return joined.where(F.col("code").isNotNull()), joined.where(F.col("code").isNull()).drop(
        "code"
    ).withColumn("reason", F.lit("unknown language"))


def _key() -> Column:
    """A number per (text, source, target), so that joins don't move whole texts to compare."""
    return F.xxhash64(F.coalesce("source", F.lit("\0")), F.coalesce("target", F.lit("\0")), "text")


def _reduced(memory: DataFrame) -> DataFrame:
    """One row per key."""
    least = memory.groupBy(*TEXT).agg(F.min("translated").alias("translated"))
    return least.withColumn("_h", _key())


def _lookup(left: DataFrame, known: DataFrame, how: str) -> DataFrame:
    right = known.withColumnsRenamed({c: f"_{c}" for c in (*TEXT, "_h")})
    same = F.col("_h") == F.col("__h")
    for c in TEXT:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.withColumn("_h", _key()).join(right, same, how).drop("_h")


def translate(
    df: DataFrame,
    memory: DataFrame,
    backend: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Add ``translated`` to rows of ``text``, ``source`` and ``target``.

    Text already in the target language stays. Every other distinct text is looked up
    in ``memory``; only unknown ones go to ``backend``, a function from a DataFrame of
    distinct (text, source, target) to the same with ``translated``. A missing source is
    a value like any other. Of several translations of a text the least counts.
    """
    foreign = df.where(~F.col("source").eqNullSafe(F.col("target")))
    asked = foreign.select(*TEXT).distinct()
    new = backend(_lookup(asked, _reduced(memory).select(*TEXT, "_h"), "left_anti"))
    known = _reduced(memory.select(*TEXT, "translated").unionByName(new.select(*TEXT, "translated")))
    done = _lookup(foreign, known, "left").select(*df.columns, "translated")
    same = df.where(F.col("source").eqNullSafe(F.col("target")))
    return done.unionByName(same.withColumn("translated", F.col("text")))


def replay_translations(recorded: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A backend that answers from a table of recorded translations."""
    return lambda asked: _lookup(asked, _reduced(recorded), "left").select(*asked.columns, "translated")
