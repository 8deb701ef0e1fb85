"""Which rarely used terms should each learner's next session practise?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolytics.operators.vocab import (
    extract_terms,
    select_vocabulary,
    summarize_usages,
    usages_of,
)


def next_vocabulary(messages: DataFrame, n: int = 16, max_usg: int = 4) -> DataFrame:
    """From messages to the ``n`` terms per learner and language.

    Two shuffles: uses shrink to one row per term before the first, and to ``n`` rows
    per learner and task before the second.
    """
    said = messages.where(F.col("role") == "usr")
    ledger = summarize_usages(usages_of(extract_terms(said)))
    chosen = select_vocabulary(ledger, n, max_usg)
    return chosen.select(
        "uid", "bcp47", "term", "n_usgs", F.unix_seconds("last").alias("last"), "rank"
    )
