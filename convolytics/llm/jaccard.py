"""N-gram Jaccard join by vertical partitioning (operator 8).

The global order of n-grams is the order of their 64-bit hashes. It is cut into
fragments, so that a document's set falls into one segment per fragment.

* *Candidates.* Two sets of sizes a, b at the threshold differ in at most
  k = floor((a + b) * (1 - t) / (1 + t)) n-grams. With k + 1 + q fragments at least q + 1
  segments are then identical, and the strongest of them is not among the q weakest of
  either set (fewest n-grams first: an order of the content alone). So a document sends
  the hashes of all but its q weakest segments, and no pair is lost. Segments mix n-grams
  of all places of a text: texts that share one passage hardly ever share a segment.
  The number of fragments follows the size: one cut per size class, and one per border of
  two classes for the pairs that lie across it.
* *Filter.* A parity sketch (each n-gram flips one of its bits) differs in at most as many
  bits as the sets differ in n-grams, so it drops pairs without losing one: 256 bits where
  candidates are found, 2048 bits before n-grams of a candidate pair are moved.
* *Counts.* The overlap of a candidate is counted in each fragment separately and summed.
* *Components.* Equal sets are one class from the start. Pairs are looked at in two passes:
  first the edges of a least spanning tree of each group of equal segments (never more than
  the group's rows), then every candidate pair that lies across components of true links.
  What the second pass leaves out is connected already, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolytics.llm import words as W
from convolytics.llm.common import components, keep, sized, text_column, tidy

NGRAM = 4
PERCENT = 85
#: Fragments in which the overlap of a candidate pair is counted.
COUNT_FRAGMENTS = 8
#: Size classes grow by this factor (a trade between weak segments and repeated ones).
GROWTH = 1.5
#: Longs in the sketch of a text that is in a candidate pair (2048 bits).
WIDE = 32
WIDE_COLUMNS = [f"w{i}" for i in range(WIDE)]
#: The spanning tree of a larger group is made of blocks; the second pass covers the rest.
BLOCK = 2048
SKETCH = ["s0", "s1", "s2", "s3"]


def edges_of_classes(top: int) -> list[int]:
    out = [1, 2, 3, 4]
    while out[-1] <= top:
        out.append(int(out[-1] * GROWTH))
    return out


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word n-grams of each row, sorted; A-Z lower-cased.

    A row with fewer than n words has one n-gram, its whole sequence; one without words none.
    """
    data = W.LOWER[data]
    starts, ends, rows = W.words(data, offsets)
    if len(starts) == 0:
        return rows, np.zeros(0, np.uint64)
    hashes = W.span_hashes(W.BYTE[data], starts, ends)
    first = W.row_starts(rows, len(offsets) - 1)
    counts = np.diff(first)
    full = W.window_hashes(hashes, n)
    same = rows[: len(full)] == rows[len(rows) - len(full) :]
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = W.span_hashes(hashes, first[short], first[short + 1]) ^ np.uint64(0x5851F42D4C957F2D)
    rows = np.concatenate([rows[: len(full)][same], short])
    grams = np.concatenate([full[same], whole])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[new], grams[new]


def _profiles(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that are not empty: hash of the set, parity sketch (4 numbers)."""
    total = np.add.reduceat(W.mix(grams), first)
    bit = np.uint64(1) << (grams & np.uint64(63))
    part = (grams >> np.uint64(6)) & np.uint64(3)
    sketch = [
        np.bitwise_xor.reduceat(np.where(part == np.uint64(i), bit, np.uint64(0)), first)
        for i in range(4)
    ]
    return W.mix(total), np.stack(sketch, axis=1)


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of slices of a batch of (doc_id, text)."""
    data, offsets = W.utf8(batch.column(1))
    for low, high in W.slices(offsets, W.SLICE_BYTES // 2):
        ids = batch.column(0).slice(low, high - low)
        yield ids, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def profile_rows(n: int):
    """Map (doc_id, text) to (doc_id, n, cls, s0..s3): set size, set hash, sketch."""

    def run(batches):
        for batch in batches:
            for ids, data, offsets in _rows_of(batch):
                rows, grams = ngrams(data, offsets, n)
                first = W.row_starts(rows, len(ids))
                sizes = np.diff(first)
                cls = np.zeros(len(ids), np.uint64)
                sketch = np.zeros((len(ids), 4), np.uint64)
                some = sizes > 0
                if some.any():
                    cls[some], sketch[some] = _profiles(grams, first[:-1][some])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes.astype(np.int64)), pa.array(cls.view(np.int64))]
                    + [pa.array(sketch[:, i].copy().view(np.int64)) for i in range(4)],
                    ["doc_id", "n", "cls", *SKETCH],
                )

    return tidy(run)


def _allowed(total: np.ndarray, percent: int) -> np.ndarray:
    """The most n-grams in which two sets of ``total`` n-grams together may differ."""
    return total * (100 - percent) // (100 + percent)


def _instances(sizes: np.ndarray, percent: int):
    """(instance, k) of each size: its class, the border above it, the border below it; -1: none."""
    edges = np.array(edges_of_classes(int(sizes.max(initial=1))), np.int64)
    j = np.searchsorted(edges, sizes, side="right") - 1
    yield 3 * j, _allowed(2 * (edges[j + 1] - 1), percent)
    for border, kind in ((edges[j + 1], 1), (edges[j], 2)):
        largest = (border - 1) * 100 // percent
        k = _allowed(border - 1 + largest, percent)
        near = (100 * sizes >= percent * border) & (sizes <= largest)
        # The border between classes j and j + 1 has one name on either side.
        yield np.where(near, 3 * (j + (kind == 1)) + 1, -1), k


def _segments(rows, grams, sizes, percent):
    """Hashes of the segments that each row sends: (row, hash)."""
    out_rows, out_hashes = [], []
    for instance, k in _instances(sizes, percent):
        q = -(-k // 8)
        fragments = np.where(instance >= 0, k + 1 + q, 0)
        use = instance[rows] >= 0
        if not use.any():
            continue
        r, g = rows[use], grams[use]
        place = ((g >> np.uint64(32)) * fragments[r].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (place[1:] != place[:-1])
        at = np.flatnonzero(new)
        r, place = r[at], place[at]
        count = np.diff(np.append(at, len(g)))
        content = np.add.reduceat(W.mix(g), at)
        salt = W.mix(instance[r].astype(np.uint64) * np.uint64(1 << 32) + place)
        content = W.mix(content ^ salt)
        # Weakest first: empty segments, then the fewest n-grams, then by content.
        order = np.lexsort((content, count, r))
        first = W.row_starts(r, len(sizes))
        empty = fragments - np.diff(first)
        spare = np.maximum(q - empty, 0)
        rank = np.arange(len(r)) - first[r]
        sent = rank >= spare[r]
        out_rows.append(r[sent])
        out_hashes.append(content[order][sent])
        # More empty segments than spare ones: only these can be all that a pair shares.
        bare = np.flatnonzero((instance >= 0) & (empty > q) & (sizes > 0))
        out_rows.append(bare)
        out_hashes.append(W.mix(instance[bare].astype(np.uint64) ^ np.uint64(0x6A09E667F3BCC909)))
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out_hashes)


def segment_rows(n: int, percent: int):
    """Map (doc_id, text) to (sig, doc_id); copies within a task send their segments once."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for ids, data, offsets in _rows_of(batch):
                rows, grams = ngrams(data, offsets, n)
                if len(rows) == 0:
                    continue
                first = W.row_starts(rows, len(ids))
                sizes = np.diff(first)
                some = np.flatnonzero(sizes)
                total = np.add.reduceat(W.mix(grams), first[:-1][some])
                fresh = np.zeros(len(ids), bool)
                for row, size, cls in zip(some, sizes[some].tolist(), total.tolist(), strict=True):
                    if (size, cls) not in seen:
                        seen.add((size, cls))
                        fresh[row] = True
                pick = fresh[rows]
                kept = np.where(fresh, sizes, 0)
                row, sig = _segments(rows[pick], grams[pick], kept, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), ids.take(pa.array(row))], ["sig", "doc_id"]
                )

    return tidy(run)


def _near(n, m, sketch, other, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes and sketches allow the threshold, and the sketches' difference."""
    far = np.bitwise_count(sketch ^ other).sum(axis=1, dtype=np.int64)
    small, large = np.minimum(n, m), np.maximum(n, m)
    return (far <= _allowed(n + m, percent)) & (100 * small >= percent * large), far


def _spanning(nodes: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, percent: int):
    """Edges of a least spanning forest over pairs that size and sketch allow."""
    n = len(nodes)
    best = np.full(n, 1 << 30)
    link = np.full(n, -1)
    left = np.ones(n, bool)
    out = []
    at = 0
    for _ in range(n):
        left[at] = False
        if link[at] >= 0:
            out.append((nodes[link[at]], nodes[at]))
        ok, far = _near(sizes, sizes[at], sketch, sketch[at], percent)
        better = left & ok & (far < best)
        best[better], link[better] = far[better], at
        waiting = np.flatnonzero(left)
        if len(waiting) == 0:
            break
        at = waiting[np.argmin(best[waiting])]
    return out


def tree_rows(percent: int):
    """Map rows sorted by sig (sig, node, n, s0..s3) to edges (a, b) of spanning forests."""

    def edges(parts):
        nodes, sizes, sketch = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _spanning(nodes, sizes, sketch, percent)

    def run(batches):
        sig, parts, held = None, [], 0
        found: set[tuple[int, int]] = set()
        for batch in batches:
            table = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            sketch = np.stack([batch.column(i).to_numpy() for i in range(3, 7)], axis=1)
            sketch = sketch.view(np.uint64)
            cuts = np.flatnonzero(np.diff(table[0])) + 1
            first, last = np.append(0, cuts), np.append(cuts, len(table[0]))
            # Most groups are two rows: those that lie inside the batch go together.
            two = (last - first == 2) & (np.arange(len(first)) > 0) & (last < len(table[0]))
            at = first[two]
            if len(at):
                ok = _near(table[2][at], table[2][at + 1], sketch[at], sketch[at + 1], percent)[0]
                if ok.any():
                    yield _pairs(np.stack([table[1][at[ok]], table[1][at[ok] + 1]], axis=1))
            for low, high in zip(first[~two].tolist(), last[~two].tolist(), strict=True):
                while low < high:
                    if held and (table[0][low] != sig or held >= BLOCK):
                        if held > 1:
                            found.update(edges(parts))
                        parts, held = [], 0
                    sig = table[0][low]
                    upto = min(high, low + BLOCK - held)
                    parts.append((table[1][low:upto], table[2][low:upto], sketch[low:upto]))
                    held += upto - low
                    low = upto
            if len(found) > 100_000:
                yield _pairs(found)
                found = set()
        if held > 1:
            found.update(edges(parts))
        if found:
            yield _pairs(found)

    return tidy(run)


def _pairs(found) -> pa.RecordBatch:
    rows = found if isinstance(found, np.ndarray) else np.array(sorted(found), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows.min(axis=1)), pa.array(rows.max(axis=1))], ["a", "b"]
    )


def wide_rows(n: int):
    """Map (doc_id, text) to (node, n, wide): set size and a wide parity sketch."""

    def run(batches):
        for batch in batches:
            for ids, data, offsets in _rows_of(batch):
                rows, grams = ngrams(data, offsets, n)
                wide = np.zeros(len(ids) * WIDE, np.uint64)
                at = rows * WIDE + ((grams >> np.uint64(6)) & np.uint64(WIDE - 1)).astype(np.int64)
                np.bitwise_xor.at(wide, at, np.uint64(1) << (grams & np.uint64(63)))
                sizes = np.bincount(rows, minlength=len(ids)).astype(np.int64)
                flat = pa.array(np.arange(0, len(wide) + 1, WIDE, dtype=np.int32))
                lists = pa.ListArray.from_arrays(flat, pa.array(wide.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), lists], ["node", "n", "wide"])

    return tidy(run)


def wide_columns(n: int):
    """``wide_rows`` with the sketch in columns w0, w1, ..., for use in a join's condition."""
    rows = wide_rows(n)

    def run(batches):
        for batch in rows(batches):
            flat = batch.column(2).values.to_numpy().reshape(-1, WIDE)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(flat[:, i].copy()) for i in range(WIDE)]],
                ["node", *WIDE_COLUMNS],
            )

    return tidy(run)


def gram_rows(n: int):
    """Map (doc_id, text) to (node, grams): one sorted list per counting fragment."""

    def run(batches):
        for batch in batches:
            for ids, data, offsets in _rows_of(batch):
                rows, grams = ngrams(data, offsets, n)
                part = rows * COUNT_FRAGMENTS + (grams >> np.uint64(61)).astype(np.int64)
                inner = W.row_starts(part, len(ids) * COUNT_FRAGMENTS)
                lists = pa.ListArray.from_arrays(
                    pa.array(inner.astype(np.int32)), pa.array(grams.view(np.int64))
                )
                outer = pa.array(np.arange(0, len(lists) + 1, COUNT_FRAGMENTS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(outer, lists)], ["node", "grams"]
                )

    return tidy(run)


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` that are an end of a pair, one per doc_id."""
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    return texts.join(sized(keep(ends.distinct(), "jaccard-ids")), "doc_id", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose texts' sets reach the threshold, counted exactly.

    Wide sketches travel first, n-grams only for the pairs that these let through.
    """
    wide = _texts_of(pairs, texts).mapInArrow(wide_rows(n), "node long, n long, wide array<long>")
    wide = keep(wide.dropDuplicates(["node"]), "jaccard-wide")
    sketched = pairs.join(wide.toDF("a", "na", "wa"), "a").join(wide.toDF("b", "nb", "wb"), "b")
    far = F.aggregate(
        F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    may = far * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    near = keep(sketched.where(may).select("a", "b"), "jaccard-near")
    sets = _texts_of(near, texts).mapInArrow(gram_rows(n), "node long, grams array<array<long>>")
    sets = keep(sets.dropDuplicates(["node"]), "jaccard-sets")
    joined = near.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    size = lambda g: F.aggregate(g, F.lit(0), lambda acc, x: acc + F.size(x))
    partial = F.zip_with("ga", "gb", lambda x, y: F.size(F.array_intersect(x, y)))
    both = F.aggregate(partial, F.lit(0), lambda acc, x: acc + x)
    counted = joined.select(
        "a", "b", both.cast("long").alias("i"), (size("ga") + size("gb")).cast("long").alias("t")
    )
    return counted.where(f"100 * i >= {percent} * (t - i)").select("a", "b")


def linked(documents: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``documents`` (doc_id, text).

    Two rows link if 100 * |intersection| >= percent * |union| of their sets of distinct
    word n-grams; component_id is the least doc_id that links reach. Rows without words
    (null or empty text) are components of their own. Rows that share a doc_id share its
    component (a doc_id is meant to name one text); a row without doc_id has no component
    (null) and links nothing. An empty
    table gives an empty result. Other columns are not read.
    """
    texts = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"),
        text_column(documents, "text").alias("text"),
    )
    profile = keep(
        texts.mapInArrow(
            profile_rows(n),
            "doc_id long, n long, cls long, s0 long, s1 long, s2 long, s3 long",
        ),
        "jaccard-profiles",
    )
    known = profile.where("doc_id is not null and n > 0")
    classes = known.groupBy("cls", "n").agg(
        F.min("doc_id").alias("node"), *[F.first(s).alias(s) for s in SKETCH]
    )
    classes = keep(classes, "jaccard-classes")
    owner = keep(
        known.select("doc_id", "cls", "n")
        .join(classes, ["cls", "n"])
        .select("doc_id", "node", "n", *SKETCH),
        "jaccard-owners",
    )
    group = Window.partitionBy("sig")
    sent = texts.where("doc_id is not null").mapInArrow(
        segment_rows(n, percent), "sig long, doc_id long"
    )
    shared = sent.withColumn("_c", F.count(F.lit(1)).over(group)).where("_c > 1").drop("_c")
    shared = keep(shared, "jaccard-shared")
    members = shared.join(owner, "doc_id").drop("doc_id").distinct()
    members = keep(
        members.withColumn("_c", F.count(F.lit(1)).over(group)).where("_c > 1").drop("_c"),
        "jaccard-members",
    )
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tree = (
        members.repartition(parts, "sig")
        .sortWithinPartitions("sig", "n", "node")
        .select("sig", "node", "n", *SKETCH)
        .mapInArrow(tree_rows(percent), "a long, b long")
        .distinct()
    )
    links = keep(verified(keep(tree, "jaccard-tree"), texts, n, percent), "jaccard-links")
    found = keep(components(links), "jaccard-found")
    across = keep(_across(members, found, texts, n, percent), "jaccard-across")
    more = verified(across, texts, n, percent)
    # A class is tied to all its rows, so that repeated ids meet as well.
    own = owner.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    final = components(links.union(more).union(own))
    return (
        profile.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "doc_id").alias("component_id"),
        )
    )


def representatives(documents: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row of each component of near copies, all columns as they are.

    The row with the least doc_id stays (of several, the one with the least text hash); rows
    without words or without doc_id stay all.
    """
    found = linked(documents, n, percent)
    gone = keep(
        found.where("doc_id is not null and component_id <> doc_id")
        .select(F.col("doc_id").alias("_id"))
        .distinct(),
        "jaccard-gone",
    )
    kept = documents.join(
        sized(gone), documents["doc_id"].cast("long") == gone["_id"], "left_anti"
    )
    # Rows that repeat a doc_id are one group as well.
    again = keep(
        known_ids(kept).groupBy("_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_id"),
        "jaccard-again",
    )
    if again.isEmpty():
        return kept
    again = sized(again)
    ids = kept["doc_id"].cast("long")
    single = kept.join(again, ids == again["_id"], "left_anti")
    twice = kept.join(again, ids == again["_id"], "left_semi").select(
        F.struct(*[kept[c] for c in documents.columns]).alias("_r"),
        F.sha2(text_column(kept, "text"), 256).alias("_h"),
        ids.alias("_k"),
    )
    one = twice.groupBy("_k").agg(F.min_by("_r", "_h").alias("_r"))
    return single.unionByName(one.select("_r.*"))


def known_ids(documents: DataFrame) -> DataFrame:
    return documents.select(documents["doc_id"].cast("long").alias("_id")).where("_id is not null")


def _far(columns: list[str]) -> F.Column:
    """In how many bits two sketches differ, one in ``columns``, one in ``l_`` columns."""
    return reduce(
        lambda x, y: x + y, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"l_{c}"))) for c in columns]
    )


def _across(
    members: DataFrame, found: DataFrame, texts: DataFrame, n: int, percent: int
) -> DataFrame:
    """Candidate pairs whose ends lie in different components.

    In each group the rows outside its largest component meet all rows, so that a group
    that is one component but for a few rows costs no more than these rows times the group.
    Rows of such groups have wide sketches here: what leaves the join are pairs that these let
    through as well, nearly all of them links, and not all pairs of a group of near misses.
    """
    comp = members.join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    counts = comp.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = (
        counts.groupBy("sig")
        .agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("k"))
        .where("k > 1")
        .select("sig", F.col("top.component").alias("largest"))
    )
    comp = keep(comp.join(mixed, "sig"), "jaccard-mixed")
    nodes = comp.select(F.col("node").alias("a"), F.col("node").alias("b"))
    schema = ", ".join(["node long", *[f"{c} long" for c in WIDE_COLUMNS]])
    wide = _texts_of(nodes, texts).mapInArrow(wide_columns(n), schema)
    comp = keep(comp.join(wide.dropDuplicates(["node"]), "node"), "jaccard-sketched")
    left = comp.where("component <> largest").withColumnsRenamed(
        {c: f"l_{c}" for c in ["node", "n", "component", *SKETCH, *WIDE_COLUMNS]}
    ).drop("largest")
    small, large = F.least("n", "l_n"), F.greatest("n", "l_n")
    allowed = (small + large) * (100 - percent)
    once = (F.col("component") == F.col("largest")) | (F.col("node") < F.col("l_node"))
    pair = (
        (F.col("component") != F.col("l_component"))
        & once
        & (100 * small >= percent * large)
        & (_far(SKETCH) * (100 + percent) <= allowed)
        & (_far(WIDE_COLUMNS) * (100 + percent) <= allowed)
    )
    right = comp.withColumnRenamed("sig", "r_sig")
    return (
        left.join(right, (F.col("sig") == F.col("r_sig")) & pair)
        .select(F.least("node", "l_node").alias("a"), F.greatest("node", "l_node").alias("b"))
        .distinct()
    )
