"""Prompt files: lines, parsing, templates."""

import pytest
from pyspark.sql import functions as F

from convolytics.operators import prompts as op
from convolytics.sources.prompts import load_prompt_lines, read_prompt_files


def files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")


def lined(spark, lines):
    return spark.createDataFrame([(0, lines)], "file_id int, lines array<string>")


@pytest.mark.parametrize(
    "lines, want",
    [
        ([], []),
        (["", "\\", ""], ["", "\n"]),
        (["one", "", "two"], ["one", "", "two"]),
        (["x\\", "y\\", "", "z"], ["x\ny\n", "z"]),
        (["tail \\ inside", "b"], ["tail \\ inside", "b"]),
        (["two\\\\", "next"], ["two\\\nnext"]),
        (["k\\", "l", "m\\", "n"], ["k\nl", "m\nn"]),
    ],
)
def test_continuations(spark, lines, want):
    good, bad = op.join_continuations(lined(spark, lines))
    assert good.first().lines == want and bad.count() == 0


@pytest.mark.parametrize("lines", [["\\"], ["", "end \\"], ["m\\", "n\\", "o\\"]])
def test_dangling(spark, lines):
    good, bad = op.join_continuations(lined(spark, lines))
    assert good.count() == 0 and bad.count() == 1


PROMPT = """# weather desk
usr: Will it rain in Oslo?
	
ast: Let me see: one moment.
   func: forecast
sys: Answer in Celsius.
# end"""


def test_prompt_file(spark, tmp_path):
    (tmp_path / "weather.txt").write_text(PROMPT)
    read = read_prompt_files(spark, str(tmp_path))
    assert read.first().file_id.endswith("/weather.txt")
    lines = [(r.n, r.line) for r in load_prompt_lines(read).orderBy("n").collect()]
    assert len(lines) == 4 and lines[1] == (3, "ast: Let me see: one moment.")
    good, bad = op.read_prompts(read, functions=["forecast", "other"])
    rows = [(r.pos, r.kind, r.role, r.body) for r in good.orderBy("pos").collect()]
    assert rows == [
        (0, "msg", "usr", "Will it rain in Oslo?"),
        (1, "msg", "ast", "Let me see: one moment."),
        (2, "func", "func", "forecast"),
        (3, "msg", "sys", "Answer in Celsius."),
    ]
    assert bad.count() == 0


@pytest.mark.parametrize(
    "text, reason",
    [
        ("bot: x\nusr: y", "unknown role"),
        ("func: a: b", "a function line has one colon"),
        ("func: other", "unknown function"),
        ("usr: x\\", "the last line ends with a backslash"),
    ],
)
def test_bad_line_rejects_the_prompt(spark, text, reason):
    good, bad = op.read_prompts(files(spark, text, "usr: fine"), functions=["known"])
    assert [r.file_id for r in good.collect()] == [1]
    assert [(r.file_id, r.reason) for r in bad.collect()] == [(0, reason)]


def test_models(spark):
    good, _ = op.read_prompts(files(spark, "gpt-3.5-turbo-0301\nusr: a", "usr: b", "GPT35TURBO\nusr: c"))
    got = {r.file_id: r.model for r in op.prompt_models(good).collect()}
    assert got == {0: "gpt-3.5-turbo-0301", 1: "gpt-3.5-turbo", 2: "gpt-3.5-turbo"}


def rows(spark, body, role="sys"):
    return spark.createDataFrame([(0, 0, "msg", role, body)], "file_id int, pos int, kind string, role string, body string")


def params(spark, **values):
    return spark.createDataFrame([(0, k, v) for k, v in values.items()], "file_id int, var string, value string")


@pytest.mark.parametrize("value", ["7", "a {{ b", "$1 \\ end"])
def test_template(spark, value):
    good, bad = op.substitute(rows(spark, "Use {{MAX}} of {{MAX}} words."), params(spark, MAX=value))
    assert good.first().body == f"Use {value} of {value} words." and bad.count() == 0


@pytest.mark.parametrize(
    "body, values, reason",
    [
        ("Speak {{TONGUE}}.", {"Tongue": "fr"}, "unknown parameter"),
        ("Speak {{TONGUE}}.", {"TONGUE": "fr", "MORE": "z"}, "unknown parameter"),
        ("Speak {{TONGUE}} or {{ OTHER}}.", {"TONGUE": "fr"}, "variable is left"),
        ("Speak up.", {"TONGUE": "fr"}, "unknown parameter"),
        ("Speak {{TONGUE}}.", {}, "missing parameter"),
        ("{{ONE}}{{TWO}}{{ONE}}", {"ONE": "1"}, "variable is left"),
    ],
)
def test_template_rejects(spark, body, values, reason):
    good, bad = op.substitute(rows(spark, body), params(spark, **values))
    assert good.count() == 0 and bad.first().reason == reason


def test_only_system_messages_are_templates(spark):
    good, bad = op.substitute(rows(spark, "{{A}}", "usr"), params(spark))
    assert good.first().body == "{{A}}" and bad.count() == 0
    assert op.guard_templates(rows(spark, "{{A}}", "usr"))[0].count() == 1
    assert op.guard_templates(rows(spark, "{{A}}"))[0].count() == 0


@pytest.mark.parametrize("n", [0, 2, 4, 6])
def test_insert_before_last_four(spark, n):
    base = [f"b{i}" for i in range(n)]
    df = spark.createDataFrame([(base, ["x", "y"])], "b array<string>, m array<string>")
    got = df.select(op.compose(F.col("b"), F.col("m"), "insert")).first()[0]
    assert got == base[:-4] + ["x", "y"] + base[-4:]
