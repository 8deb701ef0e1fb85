"""Plans, activities, streaks, languages, logs."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from convolytics.operators import languages as lg
from convolytics.operators import sessions as se

# Language names and their codes.
NAMES = {
    "English": "en", "Español": "es", "français": "fr", "Deutsch": "de", "русский": "ru",
    "日本語": "ja", "한국어": "ko", "中文": "zh", "العربية": "ar", "हिन्दी": "hi", "বাংলা": "bn",
    "Português": "pt", "Türkçe": "tr", "italiano": "it", "Tiếng Việt": "vi", "ไทย": "th",
    "עברית": "he", "Nederlands": "nl", "Ελληνικά": "el", "čeština": "cs", "Svenska": "sv",
    "Magyar": "hu", "Hawaiian": "haw", "ceb": "ceb", "Filipino": "fil", "jpn": "ja", "ja": "ja", "Spanish": "es", "ger": "de",
}


def test_languages_without_a_short_code(spark):
    names = {"bem": "bem", "Bemba": "bem", "mag": "mag", "Tok Pisin": "tpi", "eng": "en", "Serbian": "sr"}
    df = spark.createDataFrame([(n,) for n in [*names, "mul", "qqq"]], "name string")
    good, bad = lg.match_language(df)
    assert {r.name: r.code for r in good.collect()} == names
    assert sorted(r.name for r in bad.collect()) == ["mul", "qqq"]


def test_language_names(spark):
    df = spark.createDataFrame([(n,) for n in [*NAMES, "Ehnglarsh"]], "name string")
    good, bad = lg.match_language(df)
    assert {r.name: r.code for r in good.collect()} == NAMES
    assert [r.name for r in bad.collect()] == ["Ehnglarsh"]


@pytest.mark.parametrize(
    "tag, want",
    [
        ("en-US", ("en", "US", "en-US")),
        (" EN_us ", ("en", "US", "en-US")),
        ("zh-hans-cn", ("zh", "CN", "zh-Hans-CN")),
        ("en", ("en", None, "en")),
        ("es-419", ("es", "419", "es-419")),
        ("spa_mx", ("es", "MX", "es-MX")),
        ("iw-IL", ("he", "IL", "he-IL")),
        ("cy-UK", ("cy", "GB", "cy-GB")),
        ("haw-US", ("haw", "US", "haw-US")),
    ],
)
def test_tags(spark, tag, want):
    row = lg.parse_bcp47(spark.createDataFrame([(tag,)], "tag string")).first()
    assert (row.language, row.territory, row.bcp47) == want


def test_country(spark):
    tags = lg.parse_bcp47(spark.createDataFrame([("en",), ("en-US",), ("en-QQ",)], "tag string"))
    good, bad = lg.match_country(tags)
    assert [r.tag for r in good.collect()] == ["en-US"]
    assert {r.tag: r.reason for r in bad.collect()} == {"en": "no country", "en-QQ": "unknown country"}


def test_translate_asks_once_and_skips_same_language(spark):
    df = spark.createDataFrame(
        [("hi", "en", "es"), ("hi", "en", "es"), ("ho", "en", "en"), ("yo", "en", "es")],
        "text string, source string, target string",
    )
    memory = spark.createDataFrame([("yo", "en", "es", "ya")], "text string, source string, target string, translated string")
    seen = []

    def backend(asked):
        seen.extend(r.text for r in asked.collect())
        return asked.withColumn("translated", F.lit("hola"))

    done = lg.translate(df, memory, backend)
    assert sorted((r.text, r.translated) for r in done.collect()) == [
        ("hi", "hola"), ("hi", "hola"), ("ho", "ho"), ("yo", "ya")
    ]
    assert seen == ["hi"]


def test_voice(spark):
    df = spark.createDataFrame([("en-US-Wavenet-A", "xx"), (None, "es-MX")], "voice_model string, bcp47 string")
    got = [(r.voice.bcp47, r.voice.model, r.voice.type) for r in se.with_voice(df).collect()]
    assert got == [("en-US", "en-US-Wavenet-A", "Wavenet"), ("es-MX", "es-MX-Standard-A", "Standard")]


def test_streaks(spark):
    day = datetime(2024, 1, 10, 12)
    rows = [("a", f"t{i}", day + timedelta(days=d), "final") for i, d in enumerate([0, 1, 2, 5, 6])]
    rows += [("a", "t9", day + timedelta(days=7), "empty"), ("b", "t", day, "empty")]
    rows += [("c", "x", day, "final"), ("c", "y", day + timedelta(hours=2), "final")]
    df = spark.createDataFrame(rows, "uid string, tid string, ended_at timestamp, status string")
    got = {r.uid: (r["count"], r["last"], r.tid) for r in se.streaks(df).collect()}
    assert got == {
        "a": (2, day + timedelta(days=6), "t4"),
        "c": (1, day + timedelta(hours=2), "y"),
    }
    later = se.streaks(df, F.lit(date(2024, 1, 17)).cast("timestamp"))
    assert {r.uid: r["count"] for r in later.collect()} == {"a": 2, "c": 0}
