"""Terms of messages, the usage ledger of each learner, and what to practise next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolytics.functions.scalars import terms_of
from convolytics.scale import ordered_parts, rank_rows

LEDGER = ["uid", "bcp47", "term"]
USE = [*LEDGER, "tid", "mid"]
PART_ROWS = 10_000


def extract_terms(messages: DataFrame, body: str = "body") -> DataFrame:
    """One row per distinct term of a message, ``pos`` from 0 by first occurrence."""
    rest = [c for c in messages.columns if c != body]
    return messages.select(*rest, F.posexplode(terms_of(F.col(body))).alias("pos", "term"))


def usages_of(term_rows: DataFrame) -> DataFrame:
    """Uses of terms by the learner: one per message and term."""
    return term_rows.where(F.col("role") == "usr").select(
        *USE, F.lit(None).cast("boolean").alias("used_correctly"),
        F.col("created_at").alias("when"),
    )


def distinct_uses(usages: DataFrame) -> DataFrame:
    """One row per use; of repeated reports the earliest counts."""
    first = F.min(F.struct("when", "used_correctly")).alias("_u")
    return usages.groupBy(*USE).agg(first).select(*USE, "_u.used_correctly", "_u.when")


def summarize_usages(usages: DataFrame) -> DataFrame:
    """Ledger without the list of uses: count, first and last per term."""
    return usages.groupBy(*LEDGER).agg(
        F.count(F.lit(1)).alias("n_usgs"),
        F.min("when").alias("first"),
        F.max("when").alias("last"),
    )


def build_user_vocab(usages: DataFrame, part_rows: int = PART_ROWS, **scale: int) -> DataFrame:
    """Ledger documents: uses in time order with first and last use of the term.

    A term used more than ``part_rows`` times goes on in further parts.
    """
    use = F.struct("tid", "mid", "used_correctly", "when")
    parts = ordered_parts(
        usages, LEDGER, [F.col("when"), F.col("tid"), F.col("mid")], use, part_rows, "usgs",
        **scale,
    )
    # First and last of the term stand on each of its parts; parts of a term are few.
    term = Window.partitionBy(*LEDGER)
    return parts.withColumns(
        {
            "first": F.min(F.element_at("usgs", 1)["when"]).over(term),
            "last": F.max(F.element_at("usgs", -1)["when"]).over(term),
        }
    )


def merge_user_vocab(
    old: DataFrame, new_usages: DataFrame, part_rows: int = PART_ROWS, **scale: int
) -> DataFrame:
    """Ledger documents of old and new uses together. Merging twice changes nothing."""
    known = old.select(*LEDGER, F.inline("usgs"))
    every = known.select(*USE, "used_correctly", "when").unionByName(
        new_usages.select(*USE, "used_correctly", "when")
    )
    return build_user_vocab(distinct_uses(every), part_rows, **scale)


def usage_stats(usages: DataFrame, by: Sequence[str] = LEDGER) -> DataFrame:
    """Count, correct, incorrect and share correct. Unknown flags count in ``n`` only."""
    correct = F.count_if(F.col("used_correctly"))
    return usages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        correct.alias("correct"),
        F.count_if(~F.col("used_correctly")).alias("incorrect"),
        F.try_divide(correct, F.count(F.lit(1))).alias("pct_correct"),
    )


def flag_first_use(usages: DataFrame) -> DataFrame:
    """Add ``is_first``: the earliest use of a term by a learner."""
    spot = F.struct("when", "tid", "mid")
    first = usages.groupBy(*LEDGER).agg(F.min(spot).alias("_first"))
    joined = usages.join(first, LEDGER)
    return joined.withColumn("is_first", F.col("_first") == spot).drop("_first")


def new_terms(usages: DataFrame, level: str = "message") -> DataFrame:
    """How many terms a message (or transcript) brought in for the first time.

    Only first uses are left after one aggregation; messages without any have no row.
    """
    first = usages.groupBy(*LEDGER).agg(
        F.min(F.struct("when", "tid", "mid")).alias("_f")
    )
    spot = ["tid", "mid"] if level == "message" else ["tid"]
    return (
        first.select("uid", "bcp47", *[F.col(f"_f.{c}").alias(c) for c in spot])
        .groupBy("uid", "bcp47", *spot)
        .agg(F.count(F.lit(1)).alias("n_new"))
    )


def select_vocabulary(
    ledger: DataFrame,
    n: int = 16,
    max_usg: int = 4,
    as_of: Column | None = None,
    keys: Sequence[str] = ("uid", "bcp47"),
) -> DataFrame:
    """The next terms to practise: rarely used ones, most recent first.

    Terms last used after ``as_of`` and terms with ``max_usg`` uses or more are left
    out. Fewer than ``n`` terms come back all in ledger order, which is (first, term).
    Either way the newest ``n`` are the result, so each task sends at most ``n`` rows
    of a learner to the shuffle.
    """
    eligible = ledger.where(F.col("n_usgs") < max_usg)
    if as_of is not None:
        eligible = eligible.where(F.col("last") <= as_of)
    group = Window.partitionBy(*keys)
    newest = group.orderBy(F.col("last").desc(), "first", "term")
    kept = eligible.withColumn("_newest", F.row_number().over(newest)).where(
        F.col("_newest") <= n
    )
    in_ledger = F.row_number().over(group.orderBy("first", "term"))
    return (
        kept.withColumns({"_n": F.count(F.lit(1)).over(group), "_ledger": in_ledger})
        .withColumn("rank", F.when(F.col("_n") < n, F.col("_ledger")).otherwise(F.col("_newest")))
        .drop("_n", "_ledger", "_newest")
    )


def vocab_size_audit(user_vocab: DataFrame, limit: int = 800 * 1024) -> DataFrame:
    """JSON bytes of each learner's ledger per language, flagged over ``limit``."""
    text = F.to_json(F.struct("term", "usgs", "first", "last"))
    return (
        user_vocab.groupBy("uid", "bcp47")
        .agg(F.sum(F.octet_length(text)).alias("bytes"))
        .withColumn("too_big", F.col("bytes") > limit)
    )


def paginate(ledger: DataFrame, page_size: int = 100, **scale: int) -> DataFrame:
    """Add ``page`` (from 0): a learner's terms in ledger order, ``page_size`` to a page."""
    ranked = rank_rows(ledger, ["uid", "bcp47"], [F.col("first"), F.col("term")], "_rn", **scale)
    return ranked.withColumn("page", F.floor(F.col("_rn") / page_size)).drop("_rn")
