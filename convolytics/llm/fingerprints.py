"""Document fingerprints from closed syncmers (operator 2).

A k-mer of bytes is an anchor if the least hash of its inner substrings lies at one of its
edges. Whether it is depends on the k-mer alone, so equal stretches of two texts have the
same anchors wherever they stand. Of the anchors of a text the one with the least hash in
each of 64 parts of the hash range is kept with its place: that is the fingerprint.

Two fingerprints are matched by place: of the parts with equal anchors the longest chain
counts whose places rise in both texts. Its share of the parts used, as an estimate of the
Jaccard index j, gives the likeness 2j / (1 + j): half of two equally long texts in common
is about 0.5.

Each document is also compared with an edited copy, whose second half is the beginning of
the document with the next smaller doc_id. Rows are dealt out by ranges of doc_id; a copy
of the first row of a range follows the last row of the range before it.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolytics.llm import words as W
from convolytics.llm.common import text_column

K = 21
S = 5
PARTS = 64
LEAST_ID = -(1 << 63)
_ANCHOR = np.dtype([("part", "u1"), ("hash", "<u4"), ("place", "<u4")])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of the closed syncmers of each text.

    A text without any has its whole content as one anchor; an empty text has none.
    """
    n = len(offsets) - 1
    inner = len(data) - S + 1
    row = at = np.zeros(0, np.int64)
    hashes = np.zeros(0, np.uint64)
    if inner >= K - S + 1:
        code = np.zeros(inner, np.uint64)
        for i in range(S):
            code = (code << np.uint64(8)) | data[i : i + inner].astype(np.uint64)
        inside = W.mix(code)
        low, width, need = inside, 1, K - S + 1
        while width < need:
            step = min(width, need - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        m = len(low)
        at = np.flatnonzero((low == inside[:m]) | (low == inside[K - S : K - S + m]))
        row = np.searchsorted(offsets, at, side="right") - 1
        whole = at + K <= offsets[row + 1]
        at, row = at[whole], row[whole]
    if len(data):
        values = W.BYTE[data]
        hashes = W.span_hashes(values, at, at + K)
        bare = np.flatnonzero((np.bincount(row, minlength=n) == 0) & (np.diff(offsets) > 0))
        row = np.concatenate([row, bare])
        hashes = np.concatenate([hashes, W.span_hashes(values, offsets[bare], offsets[bare + 1])])
        at = np.concatenate([at, offsets[bare]])
    return row, at - offsets[row], hashes


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """The kept anchors (part, hash, place) of each text, by part."""
    out = []
    at = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
    for low, high in W.slices(at):
        data = np.frombuffer(b"".join(texts[low:high]), np.uint8)
        row, place, hashes = anchors(data, at[low : high + 1] - at[low])
        key = row.astype(np.uint64) * np.uint64(PARTS) + (hashes >> np.uint64(58))
        order = np.lexsort((place, hashes, key))
        key = key[order]
        first = order[np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])]
        kept = np.empty(len(first), _ANCHOR)
        kept["part"] = hashes[first] >> np.uint64(58)
        kept["hash"] = (hashes[first] >> np.uint64(20)) & np.uint64(0xFFFFFFFF)
        kept["place"] = place[first] & 0xFFFFFFFF
        ends = W.row_starts(row[first], high - low)
        out += [kept[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def written(print_: np.ndarray) -> str:
    return base64.b64encode(print_.tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), _ANCHOR)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """How alike two fingerprints are, 0 to 1; empty texts are alike."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    hash_of, place_of = np.zeros(PARTS, np.int64) - 1, np.zeros(PARTS, np.int64)
    hash_of[a["part"]], place_of[a["part"]] = a["hash"], a["place"]
    same = hash_of[b["part"]] == b["hash"]
    used = len(a) + len(b) - int((hash_of[b["part"]] >= 0).sum())
    if not same.any():
        return 0.0
    # The longest chain: places in the first text in order, those in the second rising.
    pairs = sorted(zip(place_of[b["part"][same]].tolist(), b["place"][same].tolist(), strict=True))
    tails: list[int] = []
    for _, place in pairs:
        at = bisect.bisect_left(tails, place)
        tails[at : at + 1] = [place]
    j = len(tails) / used
    return 2 * j / (1 + j)


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by the first of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared_rows(batches):
    """Map sorted rows (bucket, copy, doc_id, text) to fingerprints and likenesses.

    Each row is compared with the row behind it in its bucket; rows marked as copies are only
    there to be compared with.
    """
    held: list[tuple] = []  # rows of one bucket, the first of them not yet written
    size = 0

    def out(rows):
        texts = [r[3].encode() for r in rows]
        prints = fingerprints(texts)
        pairs = [
            (r, edited(r[3], rows[i + 1][3]).encode(), i)
            for i, r in enumerate(rows[:-1])
            if not r[1] and rows[i + 1][0] == r[0]
        ]
        altered = fingerprints([e for _, e, _ in pairs])
        cols = list(
            zip(
                *(
                    (
                        r[2],
                        len(r[3]),
                        hashlib.sha256(e).hexdigest(),
                        written(prints[i]),
                        written(p),
                        likeness(prints[i], p),
                        likeness(prints[i], prints[i + 1]),
                    )
                    for (r, e, i), p in zip(pairs, altered, strict=True)
                ),
                strict=True,
            )
        )
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols or [[]] * 7, kinds, strict=True)],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        _, offsets = W.utf8(batch.column(3))
        for low, high in W.slices(offsets):
            part = batch.slice(low, high - low)
            held += zip(*(c.to_pylist() for c in part.columns), strict=True)
            size += int(offsets[high] - offsets[low])
            if size >= W.SLICE_BYTES:
                yield out(held)
                held, size = held[-1:], len(held[-1][3])
    if held:
        yield out(held)


def _bucket(key, bounds: list[int]):
    """How many of the sorted ``bounds`` lie below ``key``, in two steps of about their root."""
    step = max(1, int(len(bounds) ** 0.5))
    heads = bounds[::step]
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda x, kind: F.from_json(F.lit(str(x)), kind)
    below = lambda x: F.size(F.filter(x, lambda b: b < key))
    at = F.greatest(below(array(heads, "array<bigint>")) - 1, F.lit(0))
    return at * step + below(F.get(array(rows, "array<array<bigint>>"), at))


def compared(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): its fingerprint and that of its edited text.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The next document has the next smaller doc_id (after the last
    comes the first again; a lone document is its own next). Rows of one doc_id follow each
    other by text; rows without doc_id come last. A null text is empty; an empty table gives
    an empty result; other columns are not read. Equal texts have equal fingerprints.
    """
    spark = documents.sparkSession
    rows = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"),
        text_column(documents, "text").alias("text"),
    ).withColumn("key", F.coalesce("doc_id", F.lit(LEAST_ID)))
    parts = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("key", shares or [0.5], 10_000).alias("q")).first().q or []
    rows = rows.withColumn("bucket", _bucket(F.col("key"), sorted(set(bounds))).cast("int"))
    # The first row of each range: one row per bucket comes back, whatever its size.
    heads = rows.groupBy("bucket").agg(F.max("key").alias("key")).orderBy(F.desc("bucket")).collect()
    before = {h.key: heads[i - 1].bucket for i, h in enumerate(heads)}
    first = rows.where(F.col("key").isin(list(before))).groupBy("key").agg(F.min("text").alias("text"))
    # One row per bucket: keys and the bucket in front of theirs.
    place = F.from_json(F.lit(str([[k, b] for k, b in before.items()])), "array<array<bigint>>")
    owner = F.filter(place, lambda x: F.get(x, F.lit(0)) == F.col("key"))
    copies = first.select(
        F.get(F.get(owner, F.lit(0)), F.lit(1)).cast("int").alias("bucket"),
        F.lit(True).alias("copy"),
        F.lit(None).cast("long").alias("doc_id"),
        "text",
        "key",
    )
    both = rows.select("bucket", F.lit(False).alias("copy"), "doc_id", "text", "key").unionByName(copies)
    return (
        both.repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "copy", F.desc("key"), "text")
        .select("bucket", "copy", "doc_id", "text")
        .mapInArrow(
            compared_rows,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double",
        )
    )
