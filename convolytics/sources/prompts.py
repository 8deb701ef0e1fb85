"""Prompt corpora: text files with one instruction or message to a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolytics.functions.scalars import py_strip


def read_prompt_files(spark: SparkSession, location: str) -> DataFrame:
    """Whole files as rows of ``file_id`` (the file path) and ``text``."""
    files = spark.read.text(location, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))


def _is_content(line: Column) -> Column:
    return (line != "") & ~F.startswith(line, F.lit("#"))


def clean_lines(text: Column) -> Column:
    """Stripped lines without blank ones and comments."""
    return F.filter(F.transform(F.split(text, "\n"), py_strip), _is_content)


def load_prompt_lines(files: DataFrame) -> DataFrame:
    """Content lines of prompt files, ``n`` being the line number from 0."""
    lines = files.select("file_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.withColumn("line", py_strip(F.col("line"))).where(_is_content(F.col("line")))
