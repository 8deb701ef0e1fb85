"""Benchmark decontamination by SimHash of item-sized windows (operator 5).

Windows of an item's length (to within a tenth below it) slide over each text. The
fingerprint of a window is the 64-bit SimHash of its word pairs, each counted as often as
it occurs; it comes from running sums of bits, so a window costs the same at any length.
Windows step by a sixteenth of their length at most, and the last window of each row is one
of them: no window follows there that would be nearer to a copy at the end.

A multi-index finds fingerprints near an item's: they are cut into four blocks of 16 bits,
and if two fingerprints differ in at most ``RADIUS`` bits, one of the blocks differs in at
most ``RADIUS // 4``. All block values that near to an item's are marked in a table, so
that no fingerprint within the radius is missed. What the table lets through is compared in
full, and the windows around a hit are verified by the exact weighted Jaccard similarity of
their five-word shingles (weight: how often a shingle occurs).

A row with fewer words than an item, but enough of them for the limit, is one window of its
own: its fingerprint is compared with those of whole items, and the row is verified whole.

The benchmark is the query set: its index goes to the tasks in blocks of bounded size, one
pass over the documents for each.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolytics.llm import words as W
from convolytics.llm.common import keep, text_column, tidy

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
#: For rows shorter than an item: one fingerprint each, so a wider radius costs little.
ROW_RADIUS = 20
#: Items per pass over the documents; bounds the index in each task.
ITEMS_PER_PASS = 5_000
RESULT = "doc_id long, item_id long, start long, end long, similarity double"


def _lanes(grams: np.ndarray, wide: bool) -> np.ndarray:
    """The 64 bits of each hash as bytes (or pairs of bytes), eight (four) to a number."""
    bits = np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.astype(np.uint16) if wide else bits).view(np.uint64)


def _prints(counts: np.ndarray, total: int, wide: bool) -> np.ndarray:
    """Fingerprints from counted bits: 1 where a bit is set in more than half of ``total``."""
    if wide:
        return np.packbits(counts.view(np.uint16) > total // 2, axis=1, bitorder="little").view(
            np.uint64
        ).ravel()
    # A bias lifts the counts over the half into the sign bits, which meet in a product's top byte.
    signs = counts + np.uint64((127 - total // 2) * 0x0101010101010101)
    signs >>= np.uint64(7)
    signs &= np.uint64(0x0101010101010101)
    signs *= np.uint64(0x0102040810204080)
    return (signs >> np.uint64(56)).astype(np.uint8).view(np.uint64).ravel()


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return W.mix(hashes[:-1] + (hashes[1:] << np.uint64(1)) + np.uint64(0x1B873593))


def _wide(size: int) -> bool:
    """Whether the bit counts of a window need more than a byte."""
    return size > 250


def simhash(hashes: np.ndarray) -> int:
    """The fingerprint of a whole word list (one word: its own hash)."""
    if len(hashes) == 1:
        return int(hashes[0])
    counts = _lanes(pairs(hashes), True).view(np.uint16).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts > (len(hashes) - 1) // 2, bitorder="little").view(np.uint64)[0])


def shingles(hashes: list[int]) -> Counter:
    n = min(SHINGLE, len(hashes))
    return Counter(tuple(hashes[i : i + n]) for i in range(len(hashes) - n + 1))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    data, offsets = W.utf8(pa.array(texts, pa.string()))
    starts, ends, rows = W.words(data, offsets)
    hashes = W.span_hashes(W.BYTE[data], starts, ends)
    return np.split(hashes, W.row_starts(rows, len(texts))[1:-1]) if texts else []


def window_size(length: int) -> int:
    """The window for items of ``length`` words: the greatest of 1 .. 15, 16, 17, 18, 19, 20,
    22, 24, ... (steps of a tenth) that is not longer."""
    size = 1
    while (longer := max(size + 1, int(size * 1.1))) <= length:
        size = longer
    return size


class Index:
    """Items by window: fingerprints, the marks of near block values, shingles.

    An item somewhat longer than its window is looked up by the words in its middle.
    """

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS):
        self.radius = radius
        near = radius // 4
        masks = [sum(1 << b for b in c) for k in range(near + 1) for c in combinations(range(16), k)]
        masks = np.array(masks, np.uint16)
        by_size: dict[int, list] = {}
        whole = []
        for (item, _), hashes in zip(items, word_hashes([t for _, t in items]), strict=True):
            if len(hashes):
                by_size.setdefault(window_size(len(hashes)), []).append((item, hashes))
            if len(hashes) > SHINGLE:
                whole.append((len(hashes), item, simhash(hashes), shingles(hashes.tolist())))
        whole.sort(key=lambda x: x[0])
        self.whole = [(item, wanted) for _, item, _, wanted in whole]
        self.lengths = np.array([n for n, *_ in whole], np.int64)
        self.prints = np.array([p for _, _, p, _ in whole], np.uint64)
        self.groups = []
        for size, group in sorted(by_size.items()):
            skips = [(len(h) - size) // 2 for _, h in group]
            middles = [h[k : k + size] for (_, h), k in zip(group, skips, strict=True)]
            prints = np.array([simhash(h) for h in middles], np.uint64)
            marks = np.zeros((4, 1 << 16), bool)
            for block in range(4):
                part = ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.uint16)
                marks[block][(part[:, None] ^ masks[None, :]).ravel()] = True
            found = [(i, k, len(h), shingles(h.tolist())) for (i, h), k in zip(group, skips, strict=True)]
            self.groups.append((size, prints, marks, found))

    def candidates(self, hashes: np.ndarray, first: np.ndarray):
        """(item, word place) of windows within the radius; a window may cross rows."""
        sums = {}
        grams = pairs(hashes) if len(hashes) > 1 else hashes[:0]
        for size, prints, marks, items in self.groups:
            step = max(1, size // 16)
            last = len(hashes) - size
            if last < 0:
                continue
            ends = first[1:][np.diff(first) >= size] - size
            ends = ends[ends % step > 0]
            if size == 1:
                found = hashes
            else:
                wide = _wide(size)
                if wide not in sums:
                    lanes = _lanes(grams, wide)
                    # Sums run over; their differences over a window do not.
                    sums[wide] = np.zeros((len(lanes) + 1, lanes.shape[1]), np.uint64)
                    np.cumsum(lanes, axis=0, out=sums[wide][1:])
                grid = last // step + 1
                found = np.empty(grid + len(ends), np.uint64)
                for low in range(0, grid, 4096):
                    high = min(low + 4096, grid)
                    begin = sums[wide][low * step : (high - 1) * step + 1 : step]
                    end = sums[wide][low * step + size - 1 : (high - 1) * step + size : step]
                    found[low:high] = _prints(end - begin, size - 1, wide)
                if len(ends):
                    counts = sums[wide][ends + size - 1] - sums[wide][ends]
                    found[grid:] = _prints(counts, size - 1, wide)
            grid = len(found) - len(ends)
            hit = np.zeros(len(found), bool)
            for block in range(4):
                part = (found >> np.uint64(16 * block)) & np.uint64(0xFFFF)
                hit |= marks[block].take(part.view(np.int64))
            at = np.flatnonzero(hit)
            found = found[at]
            for item, fingerprint in zip(items, prints, strict=True):
                close = np.bitwise_count(found ^ fingerprint) <= self.radius
                for k in at[close].tolist():
                    yield item, size, k * step if k < grid else int(ends[k - grid])

    def short_rows(self, hashes: np.ndarray, first: np.ndarray):
        """(row, item_id, similarity) of rows that have fewer words than an item."""
        sizes = np.diff(first)
        # A row has at most all of its shingles in common with the item.
        most = ((sizes - SHINGLE + 1) / SIMILARITY + 1e-9).astype(np.int64) + SHINGLE - 1
        low = np.searchsorted(self.lengths, sizes, side="right")
        high = np.searchsorted(self.lengths, most, side="right")
        for row in np.flatnonzero((sizes >= SHINGLE) & (low < high)).tolist():
            own = hashes[first[row] : first[row + 1]]
            there = slice(low[row], high[row])
            distance = np.bitwise_count(self.prints[there] ^ np.uint64(simhash(own)))
            near = np.flatnonzero(distance <= ROW_RADIUS)
            if not len(near):
                continue
            have = shingles(own.tolist())
            for item, wanted in (self.whole[there.start + k] for k in near):
                if wanted.keys().isdisjoint(have):
                    continue
                s = similarity(have, wanted)
                if s >= SIMILARITY:
                    yield row, item, s

    def matches(self, hashes: np.ndarray, first: np.ndarray):
        """(row, item_id, start, end, similarity): the best window of each row and item."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        looked: set[tuple[int, int]] = set()
        words = hashes.tolist()
        for (item, skip, length, wanted), size, place in self.candidates(hashes, first):
            around = max(1, size // 8)
            low, high = place - skip - around, place - skip + around
            n = min(SHINGLE, length)
            row = max(0, int(np.searchsorted(first, max(low, 0), side="right")) - 1)
            have = words[max(low, 0) : high + length]
            have = [tuple(have[i : i + n]) for i in range(len(have) - n + 1)]
            if wanted.keys().isdisjoint(have):
                continue
            while row < len(first) - 1 and first[row] <= high:
                for p in range(max(first[row], low), min(first[row + 1] - length, high) + 1):
                    if (item, p) in looked:
                        continue
                    looked.add((item, p))
                    s = similarity(shingles(words[p : p + length]), wanted)
                    if s >= SIMILARITY and (s, -p) > best.get((row, item), (0.0, 0)):
                        best[row, item] = (s, -p, length)
                row += 1
        for row, item, s in self.short_rows(hashes, first):
            # Items of other lengths may have the same id.
            if (s, -first[row]) > best.get((row, item), (0.0, 0)):
                best[row, item] = (s, -int(first[row]), int(first[row + 1] - first[row]))
        for (row, item), (s, p, length) in best.items():
            start = -p - int(first[row])
            yield row, item, start, start + length, s


def leak_rows(items: list[tuple[int, str]]):
    """Map (doc_id, text) to the benchmark items found in it."""
    held: list[Index] = []

    def run(batches):
        if not held:
            held.append(Index(items))
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            ids = batch.column(0)
            for low, high in W.slices(offsets, W.SLICE_BYTES // 4):
                part = data[offsets[low] : offsets[high]]
                starts, ends, rows = W.words(part, offsets[low : high + 1] - offsets[low])
                hashes = W.span_hashes(W.BYTE[part], starts, ends)
                first = W.row_starts(rows, high - low)
                out = list(held[0].matches(hashes, first))
                if out:
                    row, *rest = zip(*out, strict=True)
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(low, high - low).take(pa.array(row))]
                        + [pa.array(c, k) for c, k in zip(rest, kinds, strict=True)],
                        ["doc_id", "item_id", "start", "end", "similarity"],
                    )

    return tidy(run)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, similarity): where a benchmark item lies in a document.

    One row per document row and item: the window of the item's length (in words,
    lower-cased) with the greatest similarity, at least 0.8; the first of equal ones. A row
    with fewer words than the item is one window. An item of fewer than five words is one shingle. Null or empty items and texts match
    nothing; equal items are reported each. Rows without doc_id are reported with null. Empty
    tables give an empty result. Other columns are not read.
    """
    spark = documents.sparkSession
    texts = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"),
        F.lower(text_column(documents, "text")).alias("text"),
    )
    items = keep(
        benchmark.select(
            benchmark["item_id"].cast("long").alias("item_id"),
            F.lower(text_column(benchmark, "text")).alias("text"),
        ).where(F.trim("text") != ""),
        "leak-items",
    )
    out = spark.createDataFrame([], RESULT)
    for block in _blocks(items):
        found = texts.mapInArrow(leak_rows(block), RESULT)
        out = found if out.isLocal() else out.unionByName(found)
    return out


def _blocks(items: DataFrame):
    """The items, at most ``ITEMS_PER_PASS`` at a time, ordered by a hash of the text."""
    last = None
    ordered = items.withColumn("_k", F.sha2(F.concat_ws("|", "item_id", "text"), 256))
    while True:
        rest = ordered if last is None else ordered.where(F.col("_k") > last)
        rows = rest.orderBy("_k").limit(ITEMS_PER_PASS).collect()
        if not rows:
            return
        # Rows that repeat wholly have one key and one result each way.
        yield [(r.item_id, r.text) for r in {r["_k"]: r for r in rows}.values()]
        last = rows[-1]["_k"]


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark item, all columns as they are."""
    found = keep(leaks(documents, benchmark).select("doc_id").distinct(), "leak-ids")
    return documents.join(found.where("doc_id is not null"), "doc_id", "left_anti").select(
        *[documents[c] for c in documents.columns]
    )
