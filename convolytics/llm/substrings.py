"""Removal of repeated word windows by super-k-mer partitioning (operator 6).

A window is 13 consecutive words. It goes if its words also start in a document with a
smaller doc_id.

1. *Chunks.* Each task looks at chunks of about 5 MB of text. Windows that an earlier
   document of the chunk holds are settled there, so a passage that very many documents
   share leaves a chunk once per document that first holds it, not once per document.
2. *Super-k-mers.* Of the other windows, consecutive ones with the same minimiser (the least
   hash among the pairs of neighbouring words) travel as one packed string to the bucket
   of that minimiser: 12 words more than windows, instead of 13 words per window. The
   strings of one chunk and bucket are one compressed row.
3. *Buckets.* Equal windows have equal minimisers, so each bucket sorts its windows by hash
   and decides them alone. Equal hashes are compared word for word: the result is exact.
4. *Cut.* Runs of repeated windows come back per document and its words are cut.

The number of buckets follows the amount of text, so that a bucket stays about 12 MB of strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolytics.llm import words as W
from convolytics.llm.common import keep, text_column

WINDOW = 13
CHUNK_BYTES = 5 << 20
#: Bytes of text per bucket (about three times as many bytes of super-k-mers).
BUCKET_BYTES = 4 << 20
ROW = "bucket int, ids binary, starts binary, strings binary"


class Pieces:
    """Words of texts joined by single blanks: their bytes, places, hashes and owners."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        joined, sizes, hashes, rows = [], [], [], []
        for low, high in W.slices(offsets):
            part = data[offsets[low] : offsets[high]]
            starts, ends, row = W.words(part, offsets[low : high + 1] - offsets[low])
            lengths = ends - starts + 1
            at = np.concatenate([[0], np.cumsum(lengths)])
            take = np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])
            out = part[np.minimum(take, len(part) - 1)] if len(part) else part
            out[at[1:] - 1] = 32
            joined.append(out)
            sizes.append(lengths)
            hashes.append(W.span_hashes(W.BYTE[part], starts, ends))
            rows.append(row + low)
        empty = [np.zeros(0, np.int64)]
        self.text = np.concatenate(joined).tobytes() if joined else b""
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(sizes or empty))])
        self.hashes = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        self.row = np.concatenate(rows or empty)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows (numbers of their first words) and their hashes."""
        n = len(self.row) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        hashes = np.empty(n, np.uint64)
        step = W.SLICE_BYTES
        for low in range(0, n, step):
            part = self.hashes[low : low + step + size - 1]
            hashes[low : low + step] = W.window_hashes(part, size)
        return at, hashes[at]


def repeats(p: Pieces, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows, and whether an equal one lies in a row with a smaller id."""
    at, hashes = p.windows(size)
    if len(at) == 0:
        return at, np.zeros(0, bool)
    owner = ids[p.row[at]]
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    del h
    group = np.cumsum(~same) - 1
    many = np.zeros(len(same), bool)  # windows whose hash another one has
    many[:-1] |= same[1:]
    many |= same
    order, group = order[many], group[many]
    if len(order) == 0:
        return at, np.zeros(len(at), bool)
    by = np.lexsort((order, owner[order], group))
    order, group = order[by], group[by]
    new = np.ones(len(order), bool)
    new[1:] = group[1:] != group[:-1]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = owner[first] < owner[order]
    place, source = at[order[later]], at[first[later]]
    by = np.argsort(place)
    place, source = place[by], source[by]
    equal = _equal(p, place, source, size)
    found = np.zeros(len(p.row), bool)
    found[place[equal]] = True
    if not equal.all():  # hashes met by chance: decide these groups by the words themselves
        _settle(p, at, hashes, owner, place[~equal], size, found)
    return at, found[at]


def _equal(p: Pieces, place: np.ndarray, source: np.ndarray, size: int) -> np.ndarray:
    """Whether the words at ``place`` and ``source`` are the same, run by run."""
    equal = np.ones(len(place), bool)
    if len(place) == 0:
        return equal
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1] + 1)
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(place))
    last = place[high - 1] + size
    a, b = p.at[place[low]], p.at[last]
    c, d = p.at[source[low]], p.at[source[high - 1] + size]
    text = p.text
    spans = zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)
    for i, (a, b, c, d) in enumerate(spans):
        if text[a:b] != text[c:d]:
            for j in range(low[i], high[i]):
                x, y = place[j], source[j]
                equal[j] = (
                    text[p.at[x] : p.at[x + size]] == text[p.at[y] : p.at[y + size]]
                )
    return equal


def _settle(p, at, hashes, owner, unsure, size, found) -> None:
    bad = np.isin(hashes, hashes[np.isin(at, unsure)])
    least: dict[bytes, int] = {}
    spots = list(zip(at[bad].tolist(), owner[bad].tolist(), strict=True))
    word = lambda x: p.text[p.at[x] : p.at[x + size]]
    for x, o in spots:
        least[word(x)] = min(o, least.get(word(x), o))
    for x, o in spots:
        found[x] = least[word(x)] < o


def runs(places: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of consecutive places of one row (places sorted)."""
    if len(places) == 0:
        return places, places
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1] + 1) | (rows[1:] != rows[:-1])
    low = np.flatnonzero(new)
    return low, np.append(low[1:], len(places)) - 1


def minimisers(hashes: np.ndarray, size: int) -> np.ndarray:
    """The least hash of neighbouring words in each window of ``size`` words."""
    low = W.mix(hashes[:-1] + (hashes[1:] << np.uint64(1)))
    width, need = 1, size - 1
    while width < need:
        step = min(width, need - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low


def _settled(ids, starts, ends) -> pa.RecordBatch:
    """Runs found already: they pass the exchange spread evenly, as a row without strings."""
    return _rows([-1 - int(ids[0] % 1009)], [ids.tobytes()], [np.stack([starts, ends], 1).tobytes()], [None])


def _rows(buckets, ids, starts, strings) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, k) for x, k in zip([buckets, ids, starts, strings], kinds, strict=True)],
        ["bucket", "ids", "starts", "strings"],
    )


def _cut_chunk(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, size: int, buckets: int):
    p = Pieces(data, offsets)
    at, found = repeats(p, ids, size)
    if len(at) == 0:
        return
    first = W.row_starts(p.row, len(ids))
    gone = at[found]
    if len(gone):
        low, high = runs(gone, p.row[gone])
        row = p.row[gone[low]]
        yield _settled(ids[row], gone[low] - first[row], gone[high] - first[row] + size)
    open_ = at[~found]
    if len(open_) == 0:
        return
    least = minimisers(p.hashes, size)[open_]
    new = np.ones(len(open_), bool)
    new[1:] = (
        (open_[1:] != open_[:-1] + 1)
        | (least[1:] != least[:-1])
        | (p.row[open_[1:]] != p.row[open_[:-1]])
    )
    low = np.flatnonzero(new)
    start, end = open_[low], open_[np.append(low[1:], len(open_)) - 1] + size
    row = p.row[start]
    bucket = (W.mix(least[low]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, start, end, row = bucket[order], start[order], end[order], row[order]
    begin = p.at[start].tolist()
    stop = (p.at[end] - 1).tolist()
    doc, within = ids[row], (start - first[row]).astype(np.int32)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    pack = zstandard.ZstdCompressor(level=3)
    out = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
        strings = b"\n".join([p.text[x:y] for x, y in zip(begin[a:b], stop[a:b], strict=True)])
        out.append(
            (
                int(bucket[a]),
                pack.compress(doc[a:b].tobytes()),
                pack.compress(within[a:b].tobytes()),
                pack.compress(strings),
            )
        )
    yield _rows(*zip(*out, strict=True))


def super_kmers(size: int, buckets: int):
    """Map (doc_id, text) to packed rows of a bucket and to settled runs."""

    def run(batches):
        held, held_bytes = [], 0
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for low, high in W.slices(offsets, CHUNK_BYTES):
                held.append((ids[low:high], data[offsets[low] : offsets[high]], offsets[low : high + 1]))
                held_bytes += int(offsets[high] - offsets[low])
                if held_bytes >= CHUNK_BYTES:
                    yield from _cut_chunk(*_joined(held), size, buckets)
                    held, held_bytes = [], 0
        if held:
            yield from _cut_chunk(*_joined(held), size, buckets)

    return run


def _joined(held):
    lengths = np.concatenate([np.diff(o) for _, _, o in held])
    return (
        np.concatenate([i for i, _, _ in held]),
        np.concatenate([d for _, d, _ in held]),
        np.concatenate([[0], np.cumsum(lengths)]),
    )


def bucket_runs(size: int):
    """Map rows sorted by bucket to runs of repeated windows (doc_id, start, end)."""

    def decide(rows):
        unpack = zstandard.ZstdDecompressor()
        ids = np.concatenate([np.frombuffer(unpack.decompress(r[1]), np.int64) for r in rows])
        starts = np.concatenate([np.frombuffer(unpack.decompress(r[2]), np.int32) for r in rows])
        text = b"\n".join([unpack.decompress(r[3]) for r in rows]) + b"\n"
        data = np.frombuffer(text, np.uint8)
        offsets = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
        p = Pieces(data, offsets)
        at, found = repeats(p, ids, size)
        gone = at[found]
        if len(gone) == 0:
            return None
        first = W.row_starts(p.row, len(ids))
        low, high = runs(gone, p.row[gone])
        row = p.row[gone[low]]
        shift = starts[row] - first[row]
        return _runs(ids[row], gone[low] + shift, gone[high] + shift + size)

    def run(batches):
        bucket, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[3] is None:
                    ends = np.frombuffer(row[2], np.int64).reshape(-1, 2)
                    yield _runs(np.frombuffer(row[1], np.int64), ends[:, 0], ends[:, 1])
                    continue
                if row[0] != bucket and rows:
                    out = decide(rows)
                    rows = []
                    if out is not None:
                        yield out
                bucket = row[0]
                rows.append(row)
        if rows and (out := decide(rows)) is not None:
            yield out

    return run


def _runs(ids, starts, ends) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(starts.astype(np.int64)), pa.array(ends.astype(np.int64))],
        ["doc_id", "start", "end"],
    )


def cut_rows(batches):
    """Map (doc_id, text, gone) to the counts and the words that stay."""
    for whole in batches:
        _, offsets = W.utf8(whole.column(1))
        for low, high in W.slices(offsets, 4 * W.SLICE_BYTES):
            ids, texts, gone = (whole.column(i).slice(low, high - low) for i in range(3))
            out = [_cut(*x) for x in zip(texts.to_pylist(), gone.to_pylist(), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [ids] + [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )


def _cut(text: str, spans) -> tuple[int, int, str, str]:
    words = stay = text.encode().split()
    if spans:
        alive = np.ones(len(words), bool)
        for s in spans:
            alive[s["start"] : s["end"]] = False
        stay = [w for w, a in zip(words, alive.tolist(), strict=True) if a]
    kept = b" ".join(stay)
    return len(words), len(words) - len(stay), hashlib.sha256(kept).hexdigest(), kept.decode()


def repeated_runs(documents: DataFrame, size: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(doc_id, start, end): word spans covered by windows that an earlier document holds.

    Spans of one document may touch or overlap. Rows without doc_id neither lose words nor
    make others lose them.
    """
    spark = documents.sparkSession
    texts = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"),
        text_column(documents, "text").alias("text"),
    ).where("doc_id is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if buckets is None:
        total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # Several per task at least, so that tasks come out even.
        buckets = int(min(2**31 - 1, max(1 + total // BUCKET_BYTES, 4 * parts)))
    parts = max(parts, buckets // 4)
    packed = texts.mapInArrow(super_kmers(size, buckets), ROW)
    return (
        packed.repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(bucket_runs(size), "doc_id long, start long, end long")
    )


def without_repeats(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) per row of ``documents``.

    Words are runs of bytes other than blank and tab to carriage return. A word goes if it
    lies in a window of ``size`` words whose sequence also starts in a document with a
    smaller doc_id (judged on the input). Null and empty texts have no words. Windows that
    only repeat within a document or among rows of one doc_id stay. Of rows that share a
    doc_id, each loses the places found in any of them. Rows without doc_id stay whole. An
    empty table gives an empty result; other columns are not read.
    """
    spans = repeated_runs(documents, size)
    gone = keep(
        spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("gone")),
        "substring-runs",
    )
    texts = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"),
        text_column(documents, "text").alias("text"),
    )
    return (
        texts.join(gone, "doc_id", "left")
        .select("doc_id", "text", "gone")
        .mapInArrow(
            cut_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
        )
    )
