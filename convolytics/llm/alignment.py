"""Cross-tokenizer alignment in Arrow tables (operator 13).

Two tokenizers cut the same bytes in two ways. Where a token of A and a token of B end at the
same byte, the tokens are *linked*, and the text between two such places is a *group* that both
spell out.

Per Arrow batch the ids of all texts are one list column each. The lists are flattened next to
the indices of their parents; cumulative sums of token lengths, less the sum where a text
begins, are the byte ends; an Acero hash join on (text, end) gives the links; and
``Table.group_by`` counts the id pairs of the batch. Spark merges these partial counts into
corpus counts. A second pass over the written links looks the counts up and sums them per text.

The merged counts have a proven bound and are broadcast: of two linked tokens, which end at one
byte, the shorter one's bytes are a suffix of the longer one's, so there are at most as many id
pairs as bytes in all entries of both vocabularies (under a million here), whatever the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolytics.llm import words as W
from convolytics.llm.common import keep

#: A pair of ids is one number: a << SHIFT | b.
SHIFT = 20
ROWS = (
    "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
    "links array<long>, counts array<struct<pair: long, n: long>>"
)
#: Fixed value: how byte-level tokenizers cut texts before they merge.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_SPACE = re.compile(r"\s{1000}")
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)
_loaded: dict[tuple, object] = {}


class Side:
    """One tokenizer: ids of texts, and the bytes of every id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: list[bytes]):
        self.encode = encode
        self.bytes = pa.array(entries, pa.large_binary())
        self.lengths = pc.cast(pc.binary_length(self.bytes), pa.int64())


def byte_level(path: str) -> Side:
    """A byte-level tokenizer file, for a space and the text; special tokens are plain text.

    Its vocabulary is in order of its merges, so the numbers are ranks and a rank encoder gives
    the ids of the file's own library (a test compares them) in a third of the time. Its search
    for words is recursive, so texts with very long white space go to that library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    # Byte-level entries write each byte as a printable character: Latin-1 printable ones as
    # themselves, the others in order from U+0100.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {token["content"] for token in parsed["added_tokens"]}
    ranks = {
        bytes(byte_of[c] for c in token): i
        for token, i in parsed["model"]["vocab"].items()
        if token not in special
    }
    encoder = tiktoken.Encoding(
        "byte-level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={}
    )
    entries = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        entries[i] = token

    @functools.cache
    def library():
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def encode(text: str) -> list[int]:
        if LONG_SPACE.search(text):
            return library().encode(" " + text, add_special_tokens=False).ids
        return encoder.encode_ordinary(" " + text)

    return Side(lambda texts: [encode(t) for t in texts], entries)


def piece_level(path: str) -> Side:
    """A piece model file, which puts a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        entries.append(
            bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        )
    return Side(lambda texts: model.encode(texts, num_threads=1), entries)


def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """Both tokenizers, loaded once in a worker."""
    found = _loaded.get((path_a, path_b))
    if found is None:
        found = _loaded[path_a, path_b] = (byte_level(path_a), piece_level(path_b))
    return found


class Tokens:
    """All tokens of the texts of a batch, by one tokenizer."""

    def __init__(self, side: Side, texts: list[str]):
        ids = pa.array(side.encode(texts), pa.list_(pa.int32()))
        self.ids = ids.flatten()
        self.parent = pc.list_parent_indices(ids)
        self.first = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)))
        ends = pc.cumulative_sum(side.lengths.take(self.ids))
        #: Bytes of all tokens before each text, and after the last one.
        self.bounds = np.append(0, ends.to_numpy())[self.first]
        self.ends = pc.subtract(ends, pa.array(self.bounds).take(self.parent))
        self.side = side

    def spells(self, texts: list[str]) -> np.ndarray:
        """Which texts, a space before each, the joined bytes of the tokens are."""
        _, _, data = self.side.bytes.take(self.ids).buffers()
        data = memoryview(data or b"").cast("B")
        pairs = zip(texts, self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)
        return np.array([data[a:b] == b" " + t.encode() for t, a, b in pairs], bool)

    def table(self, name: str) -> pa.Table:
        return pa.table(
            {
                "text": self.parent,
                "end": self.ends,
                name: self.ids,
                f"at_{name}": pa.array(np.arange(len(self.ids), dtype=np.int64)),
            }
        )


def _joined(a: Tokens, b: Tokens) -> pa.Table:
    """(text, a, b, at_a, at_b) of all links, in order."""
    links = a.table("a").join(
        b.table("b"), ["text", "end"], join_type="inner", use_threads=False
    )
    return links.sort_by("at_a").combine_chunks()


def _digits(size: int) -> pa.Array:
    """The texts of 0 .. size - 1 followed by ',', by '|' and by ';', at 3 * id + 0, 1, 2."""
    return pa.array([f"{i}{c}" for i in range(size) for c in ",|;"], pa.large_string())


def _spelt(a: Tokens, b: Tokens, links: pa.Table, digits: pa.Array) -> list[str]:
    """SHA-256 of the groups of each text, written ``a1,a2|b1;a3|b2,b3``."""
    last_a = links.column("at_a").to_numpy()
    last_b = links.column("at_b").to_numpy()
    total = len(a.ids) + len(b.ids)
    at = np.empty(total, np.int64)
    # A token of A stands behind the tokens of B of all groups before its own, one of B behind
    # those of A up to its own.
    group = np.searchsorted(last_a, np.arange(len(a.ids)))
    where_a = np.arange(len(a.ids)) + np.append(0, last_b + 1)[group]
    group = np.searchsorted(last_b, np.arange(len(b.ids)))
    where_b = np.arange(len(b.ids)) + last_a[group] + 1
    mark = np.zeros(total, np.int64)
    at[where_a] = a.ids.to_numpy()
    at[where_b] = b.ids.to_numpy()
    mark[where_a[last_a]] = 1
    mark[where_b[last_b]] = 2
    written = digits.take(pa.array(3 * at + mark))
    _, offsets, data = written.buffers()
    ends = np.frombuffer(offsets, np.int64)[: total + 1][a.first + b.first]
    data = memoryview(data or b"").cast("B")
    return [
        hashlib.sha256(data[low : high - 1]).hexdigest()
        for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    ]


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def aligned(a: Side, b: Side, ids: pa.Array, column: pa.Array, digits: pa.Array) -> pa.RecordBatch:
    """Rows of ``ROWS`` for one slice of a batch; its partial counts stand in the first row."""
    n = len(column)
    given = column.to_pylist()
    rows = np.flatnonzero([bool(t) for t in given])
    texts = [given[i] for i in rows]
    ta, tb = Tokens(a, texts), Tokens(b, texts)
    fine = ta.spells(texts) & tb.spells(texts)
    if not fine.all():
        rows = rows[fine]
        texts = [given[i] for i in rows]
        ta, tb = Tokens(a, texts), Tokens(b, texts)
    links = _joined(ta, tb)
    pairs = pc.bit_wise_or(
        pc.shift_left(pc.cast(links.column("a"), pa.int64()), SHIFT), pc.cast(links.column("b"), pa.int64())
    ).combine_chunks()
    counted = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    partial = pa.StructArray.from_arrays(
        [counted.column("pair").combine_chunks(), counted.column("count_all").combine_chunks()],
        ["pair", "n"],
    )
    per_text = np.bincount(links.column("text").to_numpy(), minlength=len(texts)).astype(np.int64)

    def spread(values):
        out = np.zeros(n, np.int64)
        out[rows] = values
        return out

    digests = np.full(n, "", object)
    digests[rows] = _spelt(ta, tb, links, digits)
    n_links = spread(per_text)
    only_first = np.zeros(n, np.int64)
    only_first[:1] = len(partial)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(spread(np.diff(ta.first))),
            pa.array(spread(np.diff(tb.first))),
            pa.array(n_links),
            pa.array(digests, pa.string()),
            _lists(pairs, n_links),
            _lists(partial, only_first),
        ],
        ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "counts"],
    )


def align_rows(path_a: str, path_b: str):
    """Map (doc_id, text) to rows of ``ROWS``."""

    def run(batches):
        a, b = sides(path_a, path_b)
        digits = _digits(max(len(a.bytes), len(b.bytes)))
        for batch in batches:
            _, offsets = W.utf8(batch.column(1))
            for low, high in W.slices(offsets):
                ids, column = (batch.column(i).slice(low, high - low) for i in (0, 1))
                yield aligned(a, b, ids, column, digits)

    return run


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each id pair in all of ``rows``, and whether n is its b's highest."""
    merged = keep(
        rows.select(F.explode("counts").alias("c")).groupBy("c.pair").agg(F.sum("c.n").alias("n")),
        "alignment-counts",
    ).select(
        F.shiftright("pair", SHIFT).alias("a"),
        F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b"),
        "n",
    )
    highest = merged.groupBy("b").agg(F.max("n").alias("top"))
    return merged.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def scored_rows(counts):
    """Map rows of ``ROWS`` to ``RESULT`` with the broadcast (pairs, n, best), sorted by pair."""

    def run(batches):
        pairs, n, best = counts.value
        for batch in batches:
            rows = batch.num_rows
            links = batch.column(5)
            at = np.searchsorted(pairs, links.flatten().to_numpy(zero_copy_only=False))
            table = pa.table(
                {"row": pc.list_parent_indices(links), "n": pa.array(n[at]), "best": pa.array(best[at])}
            )
            sums = table.group_by("row", use_threads=False).aggregate([("n", "sum"), ("best", "sum")])
            place = sums.column("row").to_numpy()
            total, top = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            total[place] = sums.column("n_sum").to_numpy()
            top[place] = sums.column("best_sum").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(4)],
                    batch.column(3),
                    pa.array(top),
                    pa.array(total),
                    batch.column(4),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return run


def alignment_rows(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``ROWS`` of each row of ``documents`` (doc_id, text), written once: links as id pairs."""
    texts = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text")
    )
    return keep(texts.mapInArrow(align_rows(path_a, path_b), ROWS), "alignment-rows")


def alignments(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """How the tokens of two tokenizers meet in each row of ``documents`` (doc_id, text).

    Returns doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose id pair is the
    most frequent one of its B id in the corpus, ties included), count_sum (of the corpus counts
    of the links' pairs) and groups_sha256.

    Null and empty texts, and texts that the joined tokens of A or B do not spell out again,
    have no tokens: zeros and an empty digest; they count nowhere. Repeated rows, and rows
    without doc_id, have a result each and count each. An empty table gives an empty result.
    Other columns are not read.
    """
    rows = alignment_rows(documents, path_a, path_b)
    local = pair_counts(rows).toArrow().combine_chunks()
    pairs = local.column("a").to_numpy() << SHIFT | local.column("b").to_numpy()
    order = np.argsort(pairs)
    counts = rows.sparkSession.sparkContext.broadcast(
        (
            pairs[order],
            local.column("n").to_numpy()[order],
            local.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64),
        )
    )
    return rows.drop("counts").mapInArrow(scored_rows(counts), RESULT)
