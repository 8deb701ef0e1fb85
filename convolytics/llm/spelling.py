"""Spelling variants by a trie-node pair dictionary (operator 12).

Every distinct word is a path in a trie and, read from its end, in a second one. All nodes
of both tries are numbered, so that the first i code points of a word are one integer and its
last j code points another. A word of length L then gives

* *skips*: for each place i the pair (node of what stands before i, node of what follows i);
* *splits*: for each i in 0..L the pair (node of the first i, node of all the rest).

Two words that share a skip pair differ by one replaced code point. A skip pair that equals a
split pair joins a word to the word that it becomes without that code point. Pairs of integers
are equal only where the strings are, so neighbours are exact and nothing is verified again.

Nodes are numbered in tasks: words that agree in their first ``SHARED`` code points meet in one
task in sorted order, where a node is new if it lies beyond what a word shares with the one
before; shallower nodes have numbers of their own that follow from their code points. A task
holds one word and its node numbers, however long words are.

A pair holds at most one split (the pair spells out that word) and at most one skip per letter
of the alphabet, so a group is never larger than the alphabet and no pair of rows is emitted:
each member learns the number of the others and the best of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolytics.llm.common import keep, text_column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a run; 90 are left once A-Z are lower-cased, the most that a group can hold.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A near word is the form of a word if it occurs so many times as often.
TIMES = 10
#: One run in so many loses a code point (see ``words``).
DROPPED = 31
#: Words that agree in so many code points are numbered by one task (fewer than LEAST_LENGTH).
SHARED = 5


def words(documents: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, at least ``LEAST_LENGTH`` long.

    Of runs whose crc32 of ``<doc_id>:<run>`` is a multiple of ``DROPPED`` one code point is
    left out, at the place that the same number names.
    """
    runs = documents.select(
        F.coalesce(documents["doc_id"].cast("string"), F.lit("")).alias("doc"),
        F.explode(
            F.regexp_extract_all(
                text_column(documents, "text"), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}+"), F.lit(0)
            )
        ).alias("run"),
    )
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(
        F.substring(F.col("run"), F.lit(1), at),
        F.substring(F.col("run"), at + 2, F.char_length("run")),
    )
    word = F.when(F.col("h") % DROPPED == 0, shorter).otherwise(F.col("run"))
    return (
        runs.select(word.alias("word"))
        .where(F.char_length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)


def _shallow(codes: np.ndarray) -> list[int]:
    """Numbers of the nodes of depth 0 .. SHARED - 1: their letters, a byte each, after a one."""
    out = [1]
    for code in codes[: SHARED - 1].tolist():
        out.append(out[-1] << 8 | code)
    return out


def node_rows(backward: bool, wanted: list[str]):
    """Map sorted rows with a column word to the columns ``wanted`` and nodes (array<long>).

    ``nodes[i]`` is the number of the first (backward: last) i code points.
    """

    def run(batches):
        context = TaskContext.get()
        counter = ((context.partitionId() if context else 0) + 1) << 42
        before, numbers = np.zeros(0, np.int64), np.zeros(1, np.int64)
        for batch in batches:
            lists, sizes = [], []
            for word in batch.column("word").to_pylist():
                codes = _codes(word[::-1] if backward else word)
                least = min(len(codes), len(before))
                other = np.flatnonzero(codes[:least] != before[:least])
                shared = int(other[0]) if len(other) else least
                mine = np.empty(len(codes) + 1, np.int64)
                if shared < SHARED:
                    mine[:SHARED] = _shallow(codes)
                    shared = SHARED - 1
                else:
                    mine[: shared + 1] = numbers[: shared + 1]
                new = len(codes) - shared
                mine[shared + 1 :] = np.arange(counter, counter + new)
                counter += new
                before, numbers = codes, mine
                lists.append(mine)
                sizes.append(len(mine))
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            nodes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in wanted], nodes], [*wanted, "nodes"]
            )

    return run


def _numbered(table: DataFrame, backward: bool) -> DataFrame:
    """``table`` with the nodes of its words in one direction."""
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    way = F.reverse("word") if backward else F.col("word")
    key = F.substring(way, 1, SHARED)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return (
        table.repartition(parts, key)
        .sortWithinPartitions(way)
        .mapInArrow(node_rows(backward, table.columns), f"{schema}, nodes array<long>")
    )


def pair_rows(batches):
    """Map (word, id, n, prefixes, nodes) to (p, s, id, n, skip, first).

    ``first`` marks skips of the first of equal letters in a row: leaving out any of these
    gives the same word, which then counts once.
    """
    for batch in batches:
        columns = {c: batch.column(c) for c in ("id", "n", "prefixes", "nodes")}
        p = columns["prefixes"].flatten().to_numpy(zero_copy_only=False)
        nodes = columns["nodes"].flatten().to_numpy(zero_copy_only=False)
        sizes = columns["nodes"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(sizes):
            continue
        # Row r stands for place i of word w, which has sizes[w] - 1 letters.
        w = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes
        i = np.arange(len(w)) - begin[w]
        rest = begin[w] + sizes[w] - 1 - i
        inner = np.flatnonzero(i < sizes[w] - 1)
        codes = _codes("".join(batch.column("word").to_pylist()))
        first = np.ones(len(codes), bool)
        first[1:] = codes[1:] != codes[:-1]
        first |= i[inner] == 0
        both = np.concatenate([w[inner], w])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([p[inner], p])),
                pa.array(np.concatenate([nodes[rest[inner] - 1], nodes[rest]])),
                columns["id"].take(pa.array(both)),
                columns["n"].take(pa.array(both)),
                pa.array(np.arange(len(both)) < len(inner)),
                pa.array(np.concatenate([first, np.zeros(len(w), bool)])),
            ],
            ["p", "s", "id", "n", "skip", "first"],
        )


def near(table: DataFrame) -> DataFrame:
    """(id, n_near, best struct<less, id>) of words (word, id, n) that have near words.

    ``best`` is the near word of largest n; ``less`` is -n. Of equal n the least id is best.
    """
    forward = keep(
        _numbered(table, False).withColumnRenamed("nodes", "prefixes"), "spelling-prefixes"
    )
    pairs = keep(
        _numbered(forward, True).mapInArrow(
            pair_rows, "p long, s long, id long, n long, skip boolean, first boolean"
        ),
        "spelling-pairs",
    )
    own = F.struct((-F.col("n")).alias("less"), F.col("id").alias("id"))
    member = F.struct((-F.col("n")).alias("less"), F.col("id").alias("id"), F.col("first").alias("first"))
    groups = (
        pairs.groupBy("p", "s")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("skip"), member))).alias("skips"),
            F.min(F.when(~F.col("skip"), own)).alias("split"),
            F.count_if("first").alias("firsts"),
            F.min(F.when(F.col("first"), own)).alias("longer"),
        )
        .where("size(skips) > 1 or (split is not null and firsts > 0)")
    )
    plain = lambda m: F.struct(m["less"].alias("less"), m["id"].alias("id"))

    def seen(m, i):
        """What a word learns from the others that share one of its skips."""
        other = F.get("skips", F.when(i == 0, F.lit(1)).otherwise(F.lit(0)))
        shorter = F.when(m["first"], F.col("split"))
        best = F.array_min(F.array_compact(F.array(F.when(other.isNotNull(), plain(other)), shorter)))
        count = F.size("skips") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)
        return F.struct(m["id"].alias("id"), count.cast("long").alias("c"), best.alias("best"))

    own_view = F.struct(
        F.col("split.id").alias("id"), F.col("firsts").alias("c"), F.col("longer").alias("best")
    )
    views = groups.select(
        F.explode(F.concat(F.transform("skips", seen), F.array(own_view))).alias("v")
    ).select("v.*")
    return (
        views.where("id is not null and c > 0")
        .groupBy("id")
        .agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): where each word of ``forms`` (id, form) ends.

    Each round doubles the steps taken. A form occurs ``TIMES`` times as often as its word, so
    that chains are short (19 steps at most for 64-bit counts) and have no circles.
    """
    state = keep(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = state.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = keep(state.join(further, "root", "left"), "spelling-roots")
        if moved.where("next is not null").isEmpty():
            return state
        state = moved.select("id", F.coalesce("next", "root").alias("root"))


def variants(documents: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root): one row per distinct word of ``documents``.

    Words are those of ``words`` with at least ``LEAST_COUNT`` occurrences. Near words differ by
    one inserted, deleted or replaced code point; ``form`` is the near word with the largest n
    (of equal ones the least in code-point order) if it occurs at least ``TIMES`` times as
    often, else null; ``root`` is the end of the chain of forms, the word itself without one.

    Null and empty texts have no words. A null doc_id counts as the empty text in the crc32;
    repeated rows count each. An empty table gives no rows. Columns other than doc_id and text
    are not read.
    """
    # Numbers of sorted ranges rise with the words, so an id orders words by code points.
    counted = keep(words(documents).where(F.col("n") >= LEAST_COUNT), "spelling-counts")
    table = keep(
        counted.repartitionByRange("word")
        .sortWithinPartitions("word")
        .withColumn("id", F.monotonically_increasing_id()),
        "spelling-words",
    )
    found = keep(
        table.join(near(table), "id", "left").select(
            "id",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best.id")).alias("form_id"),
        ),
        "spelling-near",
    )
    chains = found.where("form_id is not null").select("id", F.col("form_id").alias("form"))
    named = table.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ends = roots(chains).join(
        table.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root"
    )
    return (
        found.join(named, "form_id", "left")
        .join(ends.select("id", "root_word"), "id", "left")
        .select(
            "word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root")
        )
    )
