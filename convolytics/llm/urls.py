"""URL filters by a Bloom filter cascade (operator 3). DataFrame functions only.

The keys of a url are its host and the parent domains, each with the prefixes of its path
that are as long as some listed path. A rule fits if its key is listed, the longest wins.

Whether a key is listed is read off a cascade of Bloom filters: level 1 holds the listed
keys; level 2 the other keys of the corpus that level 1 lets through; level 3 the listed
keys that level 2 lets through, and so on until nothing is left. For every key of the corpus
the first level that doesn't hold it gives the exact answer, without a join. The rate of
level 1 is chosen so that about as many other keys get through as keys are listed, which
bounds all levels by the length of the list, however many urls there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.llm.common import keep

#: Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Hosts that are blocked, with their subdomains, where no rule fits.
BLOCKED_HOSTS = tuple(
    f"{name}.example.{top}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)
#: Listed keys up to which the filters go into the plan (about 4 MB); more keys are joined.
MAX_LISTED = 500_000
#: A mark between a list's name and its keys.
SEP = "\x1f"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: Sequence[int], name: str) -> Column:
    """name, host suffix and path prefix of every key, longest first (a longer host first)."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = [F.when(F.char_length(path) >= n, path.substr(1, n)) for n in sorted(lengths)]
    pairs = F.flatten(
        F.transform(
            suffixes,
            lambda h: F.transform(
                F.array_compact(F.array(*prefixes)), lambda p: F.struct(h.alias("h"), p.alias("p"))
            ),
        )
    )
    size = lambda x: F.char_length(x["h"]) + F.char_length(x["p"])
    ordered = F.array_sort(
        pairs,
        lambda x, y: F.when(size(x) != size(y), size(y) - size(x)).otherwise(
            F.char_length(y["h"]) - F.char_length(x["h"])
        ),
    )
    return F.transform(ordered, lambda x: F.concat(F.lit(name + SEP), x["h"], F.lit(SEP), x["p"]))


def _place(key: Column, level: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * 64 + probe)), F.lit(bits).cast("long"))


class Filter:
    """One level: bits as an array of longs in the plan."""

    def __init__(self, keys: DataFrame, level: int, n: int, rate: float):
        self.level = level
        self.probes = max(1, round(-math.log2(rate)))
        self.bits = max(64, math.ceil(n * self.probes / math.log(2)))
        place = F.explode(
            F.array(*[_place(F.col("key"), level, i, self.bits) for i in range(self.probes)])
        )
        words = (
            keys.select(place.alias("b"))
            .groupBy(F.floor(F.col("b") / 64).cast("int").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
            .collect()
        )  # at most bits / 64 rows, bounded by MAX_LISTED
        values = [0] * (self.bits // 64 + 1)
        for w in words:
            values[w["w"]] = w["v"]
        self.words = str(values)

    def holds(self, key: Column) -> Column:
        words = F.from_json(F.lit(self.words), "array<bigint>")  # folded to a constant
        hits = []
        for i in range(self.probes):
            place = _place(key, self.level, i, self.bits)
            word = F.get(words, F.floor(place / 64).cast("int"))
            hits.append(F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1)
        out = hits[0]
        for h in hits[1:]:
            out = out & h
        return out


class Cascade:
    """Exact membership of the keys of ``universe`` (column key, distinct) in ``listed`` (key)."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        listed = keep(listed.select("key").where("key is not null").distinct(), "url-listed")
        self.n = listed.count()
        if self.n > MAX_LISTED:
            raise OverflowError(f"{self.n} listed keys; join lists of more than {MAX_LISTED}")
        self.levels: list[Filter] = []
        if not self.n:
            return
        others = universe.join(F.broadcast(listed), "key", "left_anti")
        total = max(1, universe.count())
        rate = min(0.5, self.n / total / math.sqrt(2))
        inside, outside = listed, others
        while True:
            n = self.n if not self.levels else inside.count()
            if not n:
                break
            self.levels.append(Filter(inside, len(self.levels), n, rate if not self.levels else 0.5))
            through = keep(outside.where(self.levels[-1].holds(F.col("key"))), "url-through")
            inside, outside = through, inside

    def listed(self, key: Column) -> Column:
        """Whether ``key`` (of the universe) is listed: an odd number of levels hold it in turn."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            # Missing here: not listed at odd levels of the count from one, listed at even ones.
            out = F.when(self.levels[level].holds(key), out).otherwise(F.lit(level % 2 == 1))
        return out


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    blocked_hosts: Sequence[str] = BLOCKED_HOSTS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url).

    host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: then up to ``?``, ``#`` or the end; both empty without a url or a ``://``. rule:
    host and path of the longest rule (host and path together, then the longer host) whose
    host is the url's or a parent domain of it and whose path begins the url's, else null.
    verdict: the rule's; without one ``block`` if the host or a parent domain is among
    ``blocked_hosts``, else ``allow``. Of a rule given twice the last verdict holds. Repeated
    rows and null ids get a row each; an empty table gives an empty result; other columns are
    not read.
    """
    spark = pages.sparkSession
    lists = {
        "allow": [h + SEP + p for h, p, v in rules if v == "allow"],
        "block": [h + SEP + p for h, p, v in rules if v == "block"],
        "hosts": [h + SEP for h in blocked_hosts],
    }
    lengths = sorted({len(p) for _, p, _ in rules})
    parts = pages.select(
        pages["page_id"], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path")
    )
    longest = max(lengths, default=0)
    seen = keep(
        parts.select("host", F.substring("path", 1, longest).alias("path")).distinct(), "url-keys"
    )
    rule_keys = keys_of(F.col("host"), F.col("path"), lengths, "rule") if lengths else F.array()
    host_keys = keys_of(F.col("host"), F.lit(""), [0], "hosts")
    verdicts = {(h, p): v for h, p, v in rules}
    names = [[f"rule{SEP}{h}{SEP}{p}"] for h, p in verdicts]
    names += [[f"hosts{SEP}{x}"] for x in lists["hosts"]]
    listed = spark.createDataFrame(names or [], "key string")
    universe = keep(
        seen.select(F.explode(F.concat(rule_keys.cast("array<string>"), host_keys)).alias("key"))
        .distinct(),
        "url-universe",
    )
    cascade = Cascade(universe, listed)
    # Allow rules in a cascade of their own: the verdict of a listed key is a membership too.
    allowed = Cascade(
        listed.where(F.col("key").startswith("rule" + SEP)),
        spark.createDataFrame(
            [[f"rule{SEP}{h}{SEP}{p}"] for (h, p), v in verdicts.items() if v == "allow"], "key string"
        ),
    )
    rule = F.get(F.filter(rule_keys.cast("array<string>"), cascade.listed), F.lit(0))
    blocked = F.exists(host_keys, cascade.listed)
    found = parts.select("page_id", "host", "path", rule.alias("_key"), blocked.alias("_blocked"))
    verdict = F.when(
        F.col("_key").isNotNull(), F.when(allowed.listed(F.col("_key")), "allow").otherwise("block")
    ).otherwise(F.when(F.col("_blocked"), "block").otherwise("allow"))
    named = F.replace(F.replace(F.col("_key"), F.lit("rule" + SEP), F.lit("")), F.lit(SEP), F.lit(""))
    return found.select("page_id", "host", "path", named.alias("rule"), verdict.alias("verdict"))
