"""Fixed dimensions: roles, scales, activity types, languages and countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Message roles, ours to the chat wire.
ROLES = {"sys": "system", "usr": "user", "ast": "assistant", "func": "function"}

# Names of each scale, from value 0 upwards.
SCALES = {
    "YesNo": ["NO", "SLIGHT", "SOMEWHAT", "MOSTLY", "YES"],
    "Level": ["ERROR", "BABY", "CHILD", "ADULT", "EXPERT"],
    "Grade": [
        "BABY", "TODDLER", "PRESCHOOL", "KINDERGARTEN", "FIRSTGRADE", "SECONDGRADE",
        "THIRDGRADE", "FOURTHGRADE", "FIFTHGRADE", "MIDDLESCHOOL", "HIGHSCHOOL", "ADULT",
        "COLLEGE", "SPECIALIST", "EXPERT",
    ],
}

# Score dimensions of a message and the scale of each.
SCORE_DIMS = {
    "vocab": "Level",
    "grammar": "Level",
    "idiom": "YesNo",
    "polite": "YesNo",
    "context": "YesNo",
}

# Activity types, ordered by level, and those that can be run.
ACT_TYPES = ["min", "intro", "guided", "scen", "unstr", "lesson", "story", "drill", "asmt"]
RUNNABLE_TYPES = ["min", "unstr"]

# Three-letter codes in bibliographic use that differ from the usual ones.
BIBLIOGRAPHIC = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl",
    "fre": "fr", "geo": "ka", "ger": "de", "gre": "el", "ice": "is", "mac": "mk", "mao": "mi",
    "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}

# Chat model names by the word used in prompt files.
CHAT_MODELS = {"gpt35turbo": "gpt-3.5-turbo", "gpt35turbo0301": "gpt-3.5-turbo-0301"}
DEFAULT_MODEL = "gpt-3.5-turbo"


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a fixed mapping, NULL when absent."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def ranks(spark: SparkSession) -> DataFrame:
    rows = [(s, n, v) for s, names in SCALES.items() for v, n in enumerate(names)]
    return spark.createDataFrame(rows, "scale string, name string, value int")


def ranking(scale: str) -> str:
    """The names of a scale in order, as prompts spell them out."""
    return ", ".join(SCALES[scale])


def act_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(t, i) for i, t in enumerate(ACT_TYPES)], "atp string, ord int"
    )


# Withdrawn codes of languages and countries, and what stands for them.
OLD_LANGUAGES = {"in": "id", "iw": "he", "ji": "yi", "jw": "jv", "mo": "ro", "tl": "fil"}
OLD_COUNTRIES = {
    "BU": "MM", "DD": "DE", "FX": "FR", "SU": "RU", "TP": "TL", "UK": "GB", "YD": "YE", "ZR": "CD",
}

# Codes of three letters that name no language.
NO_LANGUAGE = ("mis", "mul", "und", "zxx")
ICU = "com.ibm.icu.util.ULocale"

_KNOWN: dict[str, list] = {}


def countries(spark: SparkSession) -> list[str]:
    """ISO 3166 two-letter codes, as the Java runtime knows them."""
    if "countries" not in _KNOWN:
        locale = spark.sparkContext._jvm.java.util.Locale
        _KNOWN["countries"] = list(locale.getISOCountries())
    return _KNOWN["countries"]


def languages(spark: SparkSession) -> DataFrame:
    """Languages with names: ISO 639-1, and those that have a code of three letters only."""
    if "languages" not in _KNOWN:
        locale = spark.sparkContext._jvm.java.util.Locale
        tags = [(code, locale.forLanguageTag(code)) for code in locale.getISOLanguages()]
        short = [
            (code, tag.getISO3Language(), tag.getDisplayLanguage(locale.ENGLISH),
             tag.getDisplayLanguage(tag))
            for code, tag in tags
            if tag.getLanguage() == code  # leaves out withdrawn codes
        ]
        taken = {c for row in short for c in (row[1], row[2])} | set(BIBLIOGRAPHIC) | set(NO_LANGUAGE)
        here = {tag.getLanguage() for tag in locale.getAvailableLocales()}

        def native(code: str) -> str:
            tag = locale.forLanguageTag(code)
            return tag.getDisplayLanguage(tag) if code in here else ""

        _KNOWN["languages"] = short + [
            (r.code, r.code, r.name, native(r.code))
            for r in _long_codes(spark).collect()
            if r.code not in taken and r.name not in taken
        ]
    return spark.createDataFrame(
        _KNOWN["languages"], "code string, code3 string, name string, native string"
    )


def _long_codes(spark: SparkSession) -> DataFrame:
    """(code, name) of every code of three letters for which Spark's locale library has an
    English name (about nine hundred of 17,576)."""
    letters = [F.char(F.lit(97) + F.floor(F.col("id") / n) % 26) for n in (676, 26, 1)]
    codes = spark.range(26**3).select(F.concat(*letters).alias("code"))
    name = F.java_method(F.lit(ICU), F.lit("getDisplayLanguage"), F.col("code"), F.lit("en"))
    # Computed once: a filter on a plain column would look every name up again.
    known = codes.select("code", F.inline(F.array(F.struct(name.alias("name")))))
    return known.where((F.col("name") != F.col("code")) & (F.col("name") != ""))


def short_codes(spark: SparkSession) -> dict[str, str]:
    """The code in use for withdrawn codes and for three letters where two will do."""
    languages(spark)
    short = {code3: code for code, code3, _, _ in _KNOWN["languages"] if len(code) == 2}
    short |= BIBLIOGRAPHIC | OLD_LANGUAGES
    return {code: OLD_LANGUAGES.get(now, now) for code, now in short.items()}


def language_aliases(iso: DataFrame) -> DataFrame:
    """One code per alias. Precedence: name, 3 letters, 2 letters, native name.

    Native names are known as written and with a capital first letter.
    """
    forms = F.array(
        F.struct(F.col("name").alias("alias"), F.lit(1).alias("prio")),
        F.struct(F.col("code3").alias("alias"), F.lit(2).alias("prio")),
        F.struct(F.col("code").alias("alias"), F.lit(3).alias("prio")),
        F.struct(F.col("native").alias("alias"), F.lit(4).alias("prio")),
        F.struct(
            lookup({v: k for k, v in BIBLIOGRAPHIC.items()}, F.col("code")).alias("alias"),
            F.lit(4).alias("prio"),
        ),
        F.struct(
            F.concat(F.upper(F.substring("native", 1, 1)), F.expr("substring(native, 2)")).alias(
                "alias"
            ),
            F.lit(5).alias("prio"),
        ),
    )
    return (
        iso.select("code", F.inline(forms))
        .where(F.length("alias") > 0)
        .groupBy("alias")
        .agg(F.min(F.struct("prio", "code"))["code"].alias("code"))
    )
