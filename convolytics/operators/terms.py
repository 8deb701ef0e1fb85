"""Term annotations: replies to terms, repair, soft matching, joining back."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolytics.functions.scalars import let, once
from convolytics.scale import renamed
from convolytics.scale import same_keys as same_words
from convolytics.session import cut

MID = ["uid", "tid", "mid"]
# Letters from common to rare in western European text; only the speed depends on it.
COMMON_LETTERS = "enitrasohludcmgpbfvwkzyjxq"
#: Texts up to this length are compared in the JVM.
LONGEST = 64
#: Up to so many words of a message all meet; in longer ones, those that share a mark.
MANY_WORDS = 2_000
SIZE_DIFFERS = "number of terms differs"


def entry_keys(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["key"])


def last_wins(entries: Column) -> Column:
    """Entries with each key once, with its last value."""
    keys = F.array_distinct(entry_keys(entries))
    last = F.transform(
        keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)
    )
    return F.when(F.size(keys) == F.size(entries), entries).otherwise(last)


def json_entries(reply: Column, value_type: str = "string") -> Column:
    """Entries of a JSON object in order; of a repeated key the last value counts.

    NULL when the text is not a JSON object.
    """
    return let(F.map_entries(F.from_json(reply, f"map<string,{value_type}>")), last_wins)


def stripped(entries: Column, strip) -> Column:
    return F.transform(
        entries, lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).alias("value"))
    )


def term_diff(df: DataFrame, terms: str = "terms", reply: str = "reply_terms") -> DataFrame:
    """Terms that only the request or only the reply has."""
    return df.withColumns(
        {
            "missing": F.array_except(terms, reply),
            "surplus": F.array_except(reply, terms),
        }
    )


def same_keys(terms: Column, entries: Column) -> Column:
    keys = entry_keys(entries)
    return (F.size(F.array_except(terms, keys)) == 0) & (F.size(F.array_except(keys, terms)) == 0)


def by_position(terms: Column, entries: Column) -> Column:
    return F.zip_with(
        terms, entries, lambda t, e: F.struct(t.alias("key"), e["value"].alias("value"))
    )


def repaired(terms: Column, entries: Column) -> Column:
    """Entries with the requested terms as keys; NULL for another number of keys."""
    return F.when(same_keys(terms, entries), entries).when(
        F.size(terms) == F.size(entries), by_position(terms, entries)
    )


def repair_keys(
    df: DataFrame, terms: str = "terms", entries: str = "entries"
) -> tuple[DataFrame, DataFrame]:
    """Make reply keys equal the requested terms.

    Same keys stay. Other keys in the same number are replaced by position; another
    number of keys is a reject.
    """
    fits = F.size(terms) == F.size(entries)
    good = df.where(fits).withColumn(entries, repaired(F.col(terms), F.col(entries)))
    return good, df.where(~fits).withColumn("reason", F.lit(SIZE_DIFFERS))


def annotate(
    terms: DataFrame,
    fields: dict[str, DataFrame],
    keys: Sequence[str] = MID,
    default: str | None = None,
) -> DataFrame:
    """Add one column per field to term rows, from rows of keys, ``term`` and ``value``.

    Terms and all annotations meet in one aggregation on (keys, term), however many
    fields there are. A repeated term keeps its last row, a repeated annotation the
    one with the highest ``pos`` (when there is such a column).
    """
    spot = [*keys, "term"]
    # The position goes first, so that the largest row is the last one.
    payload = sorted((c for c in terms.columns if c not in spot), key=lambda c: c != "pos")
    blocks = [terms.select(*spot, F.struct(*payload).alias("_row"), F.lit(None).cast("string").alias("_field"),
                           F.lit(None).cast("string").alias("value"), F.lit(0).alias("_seq"))]
    for name, df in fields.items():
        seq = F.col("pos") if "pos" in df.columns else F.lit(0)
        blocks.append(
            df.select(*spot, F.lit(None).cast(blocks[0].schema["_row"].dataType).alias("_row"),
                      F.lit(name).alias("_field"), "value", seq.cast("int").alias("_seq"))
        )
    return gathered(reduce(DataFrame.unionByName, blocks), list(fields), keys, default)


def gathered(
    rows: DataFrame, fields: Sequence[str], keys: Sequence[str], default: str | None = None
) -> DataFrame:
    """One row per (keys, term) that has a ``_row``, with the values of each ``_field``."""
    spot = [*keys, "term"]
    at = {f: F.when(F.col("_field") == f, F.col("_seq")) for f in fields}
    values = [F.max_by("value", at[f]).alias(f"_f_{f}") for f in fields]
    grouped = rows.groupBy(*spot).agg(F.max("_row").alias("_row"), *values)
    out = [F.col(f"_f_{f}") if default is None else F.coalesce(f"_f_{f}", F.lit(default)) for f in fields]
    return grouped.where(F.col("_row").isNotNull()).select(
        *spot, "_row.*", *[c.alias(f) for c, f in zip(out, fields)]
    )


def annotate_terms(
    terms: DataFrame, udefns: DataFrame, poss: DataFrame, keys: Sequence[str] = MID
) -> DataFrame:
    """Message vocabulary: micro-definition and part of speech, NULL when absent."""
    return annotate(terms, {"udefn": udefns, "part_of_speech": poss}, keys)


def build_curriculum(
    terms: DataFrame,
    defns: DataFrame,
    udefns: DataFrame,
    roots: DataFrame,
    poss: DataFrame,
    conjugations: DataFrame,
    keys: Sequence[str] = MID,
) -> DataFrame:
    """Curriculum rows, ``''`` where there is no annotation; conjugation of verbs only."""
    fields = {
        "defn": defns, "udefn": udefns, "root": roots, "part_of_speech": poss,
        "conju": conjugations,
    }
    return verbs_only(annotate(terms, fields, keys, default=""))


def verbs_only(rows: DataFrame) -> DataFrame:
    """Curriculum rows without the conjugation of what is no verb."""
    verb = F.col("part_of_speech") == "verb"
    return rows.withColumn("conju", F.when(verb, F.col("conju")).otherwise(F.lit("")))


def _longest(x: Column, y: Column) -> Column:
    """The longest text that both have, as an array of at most one (n, i, j): its length and
    where it begins (from 1); of equally long ones the first in ``x``, then in ``y``."""
    size = F.least(F.length(x), F.length(y))

    def look(found: Column, n: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.contains(y, F.substring(x, i, n))
        )
        here = F.transform(
            F.slice(starts, F.lit(1), F.lit(1)),
            lambda i: F.struct(
                n.alias("n"), i.alias("i"), F.position(F.substring(x, i, n), y).alias("j")
            ),
        )
        return F.when(F.size(found) > 0, found).otherwise(here)

    nothing = F.array().cast("array<struct<n:int,i:int,j:int>>")
    return F.aggregate(F.sequence(size, F.lit(1), F.lit(-1)), nothing, look)


def block_ratio(a: Column, b: Column, min_ratio: float = 0.0) -> Column:
    """Share of matching blocks of two texts: 2 * matched / (len(a) + len(b)).

    The longest common block is matched, then the texts left of it and those right of it, and
    so on. Pairs are given up (a value below ``min_ratio``) once what is matched and the most
    that the open pieces can add stay under it. At least one text is not empty.
    """
    total = F.length(a) + F.length(b)
    pieces = "array<struct<x:string,y:string>>"

    def sides(e: Column) -> Column:
        b = F.get(e["l"], F.lit(0))
        both = F.array(
            F.struct(
                F.substring(e["x"], F.lit(1), b["i"] - 1).alias("x"),
                F.substring(e["y"], F.lit(1), b["j"] - 1).alias("y"),
            ),
            F.struct(
                F.substring(e["x"], b["i"] + b["n"], F.length(e["x"])).alias("x"),
                F.substring(e["y"], b["j"] + b["n"], F.length(e["y"])).alias("y"),
            ),
        )
        return F.filter(both, lambda p: (p["x"] != "") & (p["y"] != ""))

    def level(state: Column, _: Column) -> Column:
        found = F.filter(
            F.transform(
                state["open"],
                lambda p: F.struct(
                    p["x"].alias("x"), p["y"].alias("y"), _longest(p["x"], p["y"]).alias("l")
                ),
            ),
            lambda e: F.size(e["l"]) > 0,
        )
        after = let(
            found,
            lambda f: F.struct(
                F.flatten(F.transform(f, sides)).alias("open"),
                F.aggregate(f, state["m"], lambda m, e: m + F.get(e["l"], F.lit(0))["n"]).alias("m"),
            ),
        )
        return F.when(F.size(state["open"]) == 0, state).otherwise(let(after, hopeful))

    def hopeful(state: Column) -> Column:
        most = F.aggregate(
            state["open"], state["m"], lambda m, p: m + F.least(F.length(p["x"]), F.length(p["y"]))
        )
        enough = 2 * most >= F.lit(min_ratio) * total - F.lit(1e-9)
        return F.struct(
            F.when(enough, state["open"]).otherwise(F.array().cast(pieces)).alias("open"),
            state["m"].alias("m"),
        )

    start = F.struct(
        F.array(F.struct(a.alias("x"), b.alias("y"))).cast(pieces).alias("open"),
        F.lit(0).alias("m"),
    )
    # Each level matches a character at least, so there are no more levels than characters.
    levels = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    done = F.aggregate(levels, start, level, lambda state: state["m"])
    some = (a != "") & (b != "")
    return F.when(some, F.try_divide(2 * F.when(some, done), total)).otherwise(F.lit(0.0))


def within_ratio() -> Column:
    """The ratio of words of which one stands in the other, else NULL.

    It is their longest common block, and nothing is left of it.
    """
    la, lb = F.length("term"), F.length("reply_term")
    within = F.contains(F.col("term"), F.col("reply_term")) | F.contains(F.col("reply_term"), F.col("term"))
    word = F.greatest(la, lb) <= LONGEST
    return F.when(word & within, F.try_divide(2 * F.least(la, lb), la + lb))


@F.pandas_udf(T.DoubleType())
def _long_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = zip(a, b, strict=True)
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in pairs], dtype="float64")


def rated(pairs: DataFrame, min_ratio: float) -> DataFrame:
    """``pairs`` (term, reply_term) with ``ratio``, those of at least ``min_ratio``.

    Each pair is scored once: the filter on a plain column would go below the ``distinct`` of the
    pairs and score them all. Words stay in the JVM. A text of more than ``LONGEST`` characters is no word: such pairs go
    to Python, where the search for blocks takes the product of the lengths and not more.
    """
    word = (F.length("term") <= LONGEST) & (F.length("reply_term") <= LONGEST)
    short = once(pairs.where(word), ratio=block_ratio(F.col("term"), F.col("reply_term"), min_ratio))
    long = pairs.where(~word).withColumn("ratio", _long_ratio.asNondeterministic()("term", "reply_term"))
    return short.unionByName(long).where(F.col("ratio") >= min_ratio)


def _marks(df: DataFrame, text: str, as_: str, min_ratio: float) -> DataFrame:
    """Add the marks of a text and the first few that a partner must share one of.

    Marks are characters with their running number in the text ('l1', 'l2'). Texts
    with ratio r share at least r * (len(a) + len(b)) / 2 of them, and a partner has
    at least len * r / (2 - r) characters. So in any fixed order of marks, the first
    len - need + 1 of both texts have one in common. High numbers and rare letters
    come first, so that few texts meet.
    """
    whole = F.col(text)

    def numbered(c: Column, i: Column) -> Column:
        before = F.substring(whole, F.lit(1), i)
        n = i - F.length(F.replace(before, c, F.lit("")))
        common = F.position(c, F.lit(COMMON_LETTERS))
        rarity = F.when(common == 0, len(COMMON_LETTERS) + 1).otherwise(common)
        return F.struct(n.alias("n"), rarity.alias("r"), c.alias("c"))

    chars = F.transform(F.split(whole, ""), numbered)
    marks = F.transform(
        F.sort_array(chars, asc=False), lambda m: F.concat(m["c"], m["n"].cast("string"))
    )
    n = F.length(text)
    # A small margin keeps rounding of the bound from losing a pair at the threshold.
    need = F.ceil(n * F.lit(min_ratio / (2.0 - min_ratio)) - F.lit(1e-9)).cast("int")
    with_marks = df.where(n > 0).withColumn(f"{as_}_marks", marks)
    return with_marks.withColumn(f"{as_}_first", F.slice(f"{as_}_marks", F.lit(1), n - need + 1))


def _marked(df: DataFrame, text: str, as_: str, min_ratio: float) -> DataFrame:
    """``_marks`` of every row, computed once for each distinct text."""
    words = renamed(_marks(df.select(text).distinct(), text, as_, min_ratio), [text])
    return df.join(words, same_words(df, words, [text])).drop(f"r_{text}")


def _letters(text: str) -> Column:
    """64 bits of a text: one for each character, another one for a character that comes again.

    A bit that only one of two texts has stands for a character that the other one lacks.
    """
    whole = F.col(text)

    def bit(c: Column, i: Column) -> Column:
        again = F.when(F.position(c, whole) <= i, F.lit(32)).otherwise(F.lit(0))
        place = (F.ascii(c) + again).bitwiseAND(F.lit(63))
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    bits = F.transform(F.split(whole, ""), bit)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda all_, b: all_.bitwiseOR(b))


def _lengths(min_ratio: float) -> tuple[Column, Column]:
    """Length of both words of a pair together, and twice the characters that must match."""
    both = F.col("a_n") + F.col("b_n")
    return both, F.lit(min_ratio) * both - F.lit(1e-9)


def _hopeful(min_ratio: float) -> Column:
    """Whether a pair may reach the ratio, by lengths and ``_letters``: numbers, no texts."""
    _, floor = _lengths(min_ratio)
    lacks = [
        2 * (F.col(n) - F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))) >= floor
        for n, x, y in (("a_n", "a_bits", "b_bits"), ("b_n", "b_bits", "a_bits"))
    ]
    return (2 * F.least("a_n", "b_n") >= floor) & lacks[0] & lacks[1]


def _checked(pairs: DataFrame, min_ratio: float) -> DataFrame:
    """Pairs that are equal but for the case (``exact``), or near enough by edit distance.

    What matches stands in both texts in order, so that all else can be deleted and inserted:
    the distance is no more than the number of characters that do not match.
    """
    both, floor = _lengths(min_ratio)
    most = F.floor(both - floor).cast("int")
    near = F.call_function("levenshtein", F.col("term"), F.col("reply_term"), most) >= 0
    exact = F.lower("term") == F.lower("reply_term")
    # As columns of their own, or the texts would be read for each pair that is met.
    return once(pairs, exact=exact, _near=exact | near).where("_near")


def _left_over(pairs: DataFrame) -> DataFrame:
    """Pairs without those of a reply that is some term of its message, but for the case."""
    taken = F.max("exact").over(Window.partitionBy("_k", F.lower("reply_term")))
    found = pairs.select("_k", "term", "reply_term", "exact", taken.alias("_taken"))
    return found.where(F.col("exact") | ~F.col("_taken")).drop("_taken")


def _all_met(words: DataFrame, min_ratio: float) -> DataFrame:
    """Pairs equal but for the case (``exact``) or that may reach the ratio, each once.

    All words of a message meet in the task that holds the message.
    """
    a, b = _sides(words.repartition("_k"))
    met = a.join(b, "_k").where((F.col("a_same") == F.col("b_same")) | _hopeful(min_ratio))
    return _left_over(_checked(met, min_ratio))


def _sides(words: DataFrame) -> list[DataFrame]:
    """Distinct terms and replies of messages, with the numbers that pairs are chosen by."""
    return [
        words.where(F.col("asked") == asked).select("_k", F.col("text").alias(name)).distinct()
        .withColumns({
            f"{as_}_same": F.xxhash64(F.lower(name)),
            f"{as_}_n": F.length(name),
            f"{as_}_bits": _letters(name),
        })
        for asked, name, as_ in ((True, "term", "a"), (False, "reply_term", "b"))
    ]


def _mark_met(words: DataFrame, min_ratio: float) -> DataFrame:
    """``_all_met`` by words that share a mark, for messages of any number of words."""
    a, b = _sides(words)
    numbers = ["_k", "term", "reply_term", "a_n", "b_n"]
    same = a.join(b, [a["_k"] == b["_k"], a["a_same"] == b["b_same"]]).drop(b["_k"]).select(*numbers)
    a = _marked(a, "term", "a", min_ratio).withColumn("_mark", F.explode("a_first"))
    b = _marked(b, "reply_term", "b", min_ratio).withColumn("_mark", F.explode("b_first"))
    # A pair that shares several first marks is kept at the first of them only.
    first = F.element_at(F.array_intersect("a_first", "b_first"), 1) == F.col("_mark")
    close = a.join(b, ["_k", "_mark"]).where(
        (F.col("a_same") != F.col("b_same")) & _hopeful(min_ratio) & first
    )
    return _left_over(_checked(same.unionByName(close.select(*numbers)), min_ratio))


def _candidates(words: DataFrame, min_ratio: float) -> DataFrame:
    """Pairs of a message that are ``exact`` or may reach the ratio, each once.

    ``words`` is a written table of messages ``_k``, ``text`` and whether it is ``asked``. Where a
    message has over ``MANY_WORDS`` rows, only words that share a mark meet.
    """
    sizes = words.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    long = cut(sizes.where(F.col("_n") > MANY_WORDS).select("_k"))
    if long.isEmpty():
        return _all_met(words, min_ratio)
    short, rest = (words.join(long, "_k", how) for how in ("left_anti", "left_semi"))
    return _all_met(short, min_ratio).unionByName(_mark_met(rest, min_ratio))


def soft_match(
    terms: DataFrame, reply: DataFrame, min_ratio: float = 0.75, keys: Sequence[str] = MID
) -> DataFrame:
    """Match reply terms to requested terms of the same message.

    Messages have most words in common, so candidate pairs are made distinct first, unless one
    word stands in the other: each pair is scored once, whatever the number of messages it
    comes up in.

    Equal ignoring case comes first (ratio 1). Terms still without a match take the most
    similar of the left reply terms, at least ``min_ratio`` alike, ties going to the
    smaller text. Candidates pass tests that lose no pair (``_hopeful``; ``_marks`` where a
    message has very many words).
    """
    if not 0 < min_ratio <= 1:
        raise ValueError("min_ratio is over 0 and at most 1")
    keys = list(keys)
    # Keys in one column, in which NULL equals NULL.
    asked, given = (
        df.select(F.struct(*keys).alias("_k"), F.col("term").alias("text"), F.lit(is_term).alias("asked"))
        for df, is_term in ((terms, True), (reply, False))
    )
    pairs = cut(
        _candidates(cut(asked.unionByName(given)), min_ratio).withColumn(
            "ratio", F.when(F.col("exact"), F.lit(1.0)).otherwise(within_ratio())
        )
    )
    words = ["term", "reply_term"]
    known = pairs.where(F.col("ratio") >= min_ratio).drop("exact")
    open_ = pairs.where(F.col("ratio").isNull()).select("_k", *words)
    scored = renamed(rated(open_.select(*words).distinct(), min_ratio), words)
    found = open_.join(scored, same_words(open_, scored, words)).select(*known.columns)
    # Only words that are equal but for the case have 1, as texts that are the same are.
    best = F.min(F.struct((-F.col("ratio")).alias("r"), "reply_term")).alias("_b")
    return (
        known.unionByName(found)
        .groupBy("_k", "term")
        .agg(best)
        .select("_k.*", "term", "_b.reply_term", (-F.col("_b.r")).alias("ratio"))
    )
