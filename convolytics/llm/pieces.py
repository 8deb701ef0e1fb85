"""SentencePiece encoding that keeps byte offsets, and decoding (operator 4).

Only the model file's table is read: pieces with scores and types, and the normaliser's
settings with its compiled character map (a double array whose values point at replacement
texts). The work is done here, on Arrow batches:

* *Normalising.* At each place the longest prefix that the map knows gives its replacement,
  else one character stands for itself. Every byte that comes out is recorded with the span
  of source bytes it came from, so blanks that are added, joined or dropped keep their place.
* *Encoding.* Byte-pair merges by score, leftmost first; what no piece covers becomes byte
  pieces. Pieces of this kind of model hold a blank at their start only, so a text falls
  into units (blanks, then characters) that merge alone; units repeat and are cached.
  If a model has other pieces, the whole text is one unit.
* *Spans.* Each piece covers the source bytes from the first to the last of its bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolytics.llm import words as W
from convolytics.llm.common import text_column, tidy

BLANK = "▁"
#: Piece types in the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Units kept in a worker; a full table starts anew (with those of the texts at hand).
CACHE = 200_000


def _fields(body: bytes):
    """(number, value) of a protocol buffer message; values are numbers or bytes."""

    def number(at):
        value = shift = 0
        while True:
            byte = body[at]
            value |= (byte & 127) << shift
            at += 1
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(body):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = body[at : at + size], at + size
        yield key >> 3, value


class CharMap:
    """The compiled map of a normaliser: longest known prefix and its replacement."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """(length of the prefix at ``at``, replacement); length 0 where none is known."""
        units = self.units
        if not units:
            return 0, b""

        def offset(unit):
            return (unit >> 10) << ((unit & (1 << 9)) >> 6)

        node = offset(units[0])
        length, value = 0, 0
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                length, value = i + 1 - at, units[node] & 0x7FFFFFFF
        if not length:
            return 0, b""
        return length, self.texts[value : self.texts.index(b"\0", value)]


class Model:
    """A byte-pair model with byte fallback, read from its file."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        charmap = b""
        self.add_blank = self.squeeze = self.escape = True
        self.kind, self.byte_fallback, self.end = 1, False, 2
        for field, body in _fields(Path(path).read_bytes()):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(body):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif f == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif field == 2:
                for f, v in _fields(body):
                    if f == 3:
                        self.kind = v
                    elif f == 35:
                        self.byte_fallback = bool(v)
                    elif f == 42:
                        self.end = v
            elif field == 3:
                for f, v in _fields(body):
                    if f == 2:
                        charmap = v
                    elif f == 3:
                        self.add_blank = bool(v)
                    elif f == 4:
                        self.squeeze = bool(v)
                    elif f == 5:
                        self.escape = bool(v)
        if self.kind != 2:
            raise ValueError("the model is not a byte-pair model")
        self.charmap = CharMap(charmap)
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER)}
        self.user = sorted((p for p, _, k in self.pieces if k == USER), key=len, reverse=True)
        self.score = {p: s for p, s, k in self.pieces if k in (NORMAL, USER)}
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        whole = any(BLANK in p.lstrip(BLANK) for p in self.ids) or self.user
        # A line break that no piece holds ends a unit as well.
        line = "" if any("\n" in p for p in self.ids) else "\n"
        parts = f"{BLANK}+[^{BLANK}{line}]*|[^{BLANK}{line}]+" + (f"|{line}+" if line else "")
        self.unit = re.compile(".+" if whole else parts, re.S)
        self.names = [str(i) for i in range(len(self.pieces))]
        self._pairs = self._known = None
        self.plain = not self.charmap.units and not self.squeeze and self.escape

    # -- normalising ------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte."""
        source = text.encode()
        if not source:
            return "", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(source, np.uint8)
            width = np.where(raw == 32, 3, 1)
            at = np.repeat(np.arange(len(raw)), width)
            lead = 3 if self.add_blank else 0
            at = np.concatenate([np.zeros(lead, np.int64), at, [len(raw)]])
            return (BLANK if lead else "") + text.replace(" ", BLANK), at
        chunks, at = [], 0
        while at < len(source):
            length, out = self.charmap.longest(source, at)
            if not length:
                byte = source[at]
                length = 1 if byte < 128 else 2 if byte < 224 else 3 if byte < 240 else 4
                out = source[at : at + length]
            chunks.append((out, at))
            at += length
        end = len(source)
        if self.squeeze:
            while chunks and chunks[0][0].strip(b" ") == b"":
                chunks.pop(0)
        out, places = bytearray(), []
        blank = BLANK.encode() if self.escape else b" "

        def put(part, place):
            out.extend(part)
            places.extend([place] * len(part))

        if not chunks:
            return "", np.array([end])
        if self.add_blank:
            put(blank, chunks[0][1])
        after_blank = self.squeeze
        for part, place in chunks:
            if self.squeeze and after_blank:
                part = part.lstrip(b" ")
            for byte in part:
                put(blank if byte == 32 else bytes([byte]), place)
            if part:
                after_blank = self.squeeze and part.endswith(b" ")
        if self.squeeze:
            while out.endswith(blank) and out:
                end = places[-len(blank)]
                del out[-len(blank) :], places[-len(blank) :]
        return out.decode(), np.array([*places, end])

    # -- encoding ---------------------------------------------------------------------

    def merge(self, unit: str) -> list[str]:
        """The pieces of one unit: the best-scored neighbours merge, the leftmost of equals."""
        symbols = self._symbols(unit)
        score = self.score
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i, j):
            if 0 <= i and j < n:
                both = symbols[i] + symbols[j]
                if both in score:
                    heapq.heappush(heap, (-score[both], i, j, both))

        frozen = {i for i, s in enumerate(symbols) if s in self.user} if self.user else ()
        for i in range(n - 1):
            if not frozen or (i not in frozen and i + 1 not in frozen):
                offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] not in frozen:
                offer(left[i], i)
            if right[i] not in frozen:
                offer(i, right[i])
        return [s for s in symbols if s is not None]

    # -- many units at once -------------------------------------------------------------

    def _tables(self):
        """Numbers of symbols (pieces and characters); pairs that merge, with rank and result."""
        if self._pairs is None:
            names = [p for p, _, k in self.pieces if k in (NORMAL, USER)]
            chars = sorted({c for p in names for c in p} - set(names))
            number = {p: i for i, p in enumerate([*names, *chars])}
            # Equal scores are one rank: of such pairs the leftmost merges.
            places = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
            rank = {p: places[self.score[p]] for p in names}
            rows = [
                (number[p[:i]] << 32 | number[p[i:]], rank[p], number[p])
                for p in names
                for i in range(1, len(p))
                if p[:i] in number and p[i:] in number
            ]
            table = np.array(sorted(rows), np.int64).reshape(-1, 3).T.copy()
            self._pairs = number, [*names, *chars], table, not self.user
        return self._pairs

    def merge_many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of each unit: how many ids, all ids, the bytes that each covers.

        As ``merge``, for all units together: in every round each makes its best merge.
        """
        number, names, (keys, ranks, results), usable = self._tables()
        text = "".join(units)
        extra = {c: len(names) + k for k, c in enumerate(sorted(set(text) - number.keys()))}
        of = {c: number.get(c, extra.get(c)) for c in set(text)}
        lengths = np.array([len(u) for u in units], np.int64)
        slow = (lengths > 64) | (not usable) | (len(keys) == 0)
        found_owner, found = [], []
        for i in np.flatnonzero(slow).tolist():
            merged = [number.get(x, extra.get(x)) for x in self.merge(units[i])]
            found_owner.append(np.full(len(merged), i))
            found.append(np.array(merged, np.int64))
        owner = np.repeat(np.arange(len(units)), np.where(slow, 0, lengths))
        symbols = np.array(
            [of[c] for u, s in zip(units, slow.tolist(), strict=True) if not s for c in u], np.int64
        )
        none = np.int64(1) << 40
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = (keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(known, ranks[at], none), none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            # Finished units leave; of equal best pairs in a unit the first merges.
            gone = np.repeat(best == none, size)
            found_owner.append(owner[gone])
            found.append(symbols[gone])
            pick = np.flatnonzero((rank == np.repeat(best, size)) & (rank < none))
            if len(pick):
                pick = pick[np.append(True, owner[pick[1:]] != owner[pick[:-1]])]
                symbols[pick] = results[at[pick]]
                gone[pick + 1] = True
            symbols, owner = symbols[~gone], owner[~gone]
        if not found:
            return np.zeros(len(units), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner, symbols = np.concatenate(found_owner), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        owner, symbols = owner[order], symbols[order]
        first, ids, sizes = self._ids_of([*names, *extra])
        counts = first[symbols + 1] - first[symbols]
        ends = np.cumsum(counts)
        take = np.repeat(first[symbols] - (ends - counts), counts) + np.arange(counts.sum())
        per_unit = np.bincount(owner, weights=counts, minlength=len(units)).astype(np.int64)
        return per_unit, ids[take], sizes[take]

    def _ids_of(self, names: list[str]):
        """For numbered symbols: their ids and covered bytes, symbol i at first[i]:first[i + 1]."""
        fixed = len(self._tables()[1])
        if self._known is None:
            self._known = _flat([self.unit_ids([x]) for x in names[:fixed]])
        first, ids, sizes = self._known
        more, more_ids, more_sizes = _flat([self.unit_ids([x]) for x in names[fixed:]])
        return (
            np.append(first, first[-1] + more[1:]),
            np.append(ids, more_ids),
            np.append(sizes, more_sizes),
        )

    def _symbols(self, unit: str) -> list[str]:
        if not self.user:
            return list(unit)
        out, at = [], 0
        while at < len(unit):
            piece = next((u for u in self.user if unit.startswith(u, at)), unit[at])
            out.append(piece)
            at += len(piece)
        return out

    def unit_ids(self, merged: list[str]) -> list[tuple[int, int]]:
        """(id, bytes of the normalised text it covers) of each piece of a merged unit."""
        out = []
        for piece in merged:
            size = len(piece.encode())
            if piece in self.ids:
                out.append((self.ids[piece], size))
            elif self.byte_fallback:
                out += [(self.bytes[b], 1) for b in piece.encode()]
            else:
                out.append((self.unknown, size))
        return out

    # -- decoding ---------------------------------------------------------------------

    def surface(self, ids: list[int]) -> str:
        """The text of ids, blanks marked; runs of byte pieces are read as UTF-8 together."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_read(bytes(run)))
                run.clear()
            if i is None:
                break
            piece, _, kind = self.pieces[i]
            out.append("" if kind == CONTROL else " ⁇ " if kind == UNKNOWN else piece)
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.shown(self.surface(ids))

    def shown(self, text: str) -> str:
        """Blanks instead of their mark, without the one that encoding adds in front."""
        if (self.add_blank or self.squeeze) and text.startswith(BLANK):
            text = text.lstrip(BLANK) if self.squeeze else text[1:]
        return text.replace(BLANK, " ")


def _flat(rows: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.append(0, np.cumsum([len(r) for r in rows], dtype=np.int64))
    pairs = np.array([p for r in rows for p in r], np.int64).reshape(-1, 2)
    return first, pairs[:, 0], pairs[:, 1]


def _read(run: bytes) -> str:
    """UTF-8, each byte that is not part of a character as the replacement character."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out)


class Units:
    """Encoded units of a task's texts, numbered: ids, bytes covered, decimal ids, surface."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.decimal: list[str] = []
        self.surface: list[str] = []
        self.first = np.zeros(1, np.int64)
        self.flat_ids, self.flat_sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, units: set[str]) -> None:
        if not units:
            return
        units = sorted(units)
        counts, ids, sizes = self.model.merge_many(units)
        at = len(self.decimal)
        self.number.update(zip(units, range(at, at + len(units)), strict=True))
        shown = [self.model.names[i] for i in ids.tolist()]
        last = np.cumsum(counts).tolist()
        self.decimal += [
            " ".join(shown[a:b]) for a, b in zip([0, *last[:-1]], last, strict=True)
        ]
        # Byte pieces of a unit are whole characters: it reads as it was written.
        bad = np.isin(ids, [self.model.unknown]).any()
        self.surface += (
            [self.model.surface(ids[a:b].tolist()) for a, b in zip([0, *last[:-1]], last, strict=True)]
            if bad
            else units
        )
        self.first = np.append(self.first, self.first[-1] + np.cumsum(counts))
        self.flat_ids = np.append(self.flat_ids, ids.astype(np.int32))
        self.flat_sizes = np.append(self.flat_sizes, sizes.astype(np.int32))


class Encoded:
    """Texts encoded together: ids and spans as flat arrays, text i at first[i]:first[i + 1]."""

    def __init__(self, table: Units, texts: list[str]):
        model = table.model
        normal = [model.normalise(t) for t in texts]
        split = [model.unit.findall(t) for t, _ in normal]
        new = set().union(*split)
        if len(table.number) + len(new - table.number.keys()) > CACHE:
            table.clear()
        table.add(new - table.number.keys())
        number = table.number
        numbers = [[number[u] for u in units] for units in split]
        unit = np.array([n for row in numbers for n in row], np.int64)
        counts = table.first[unit + 1] - table.first[unit]
        ends = np.cumsum(counts)
        take = np.repeat(table.first[unit] - (ends - counts), counts) + np.arange(counts.sum())
        ids, sizes = table.flat_ids[take], table.flat_sizes[take]
        per_text = np.array([len(r) for r in numbers])
        last = np.cumsum(per_text)
        token_end = np.append(0, ends)[last]  # ids without end ids up to each text
        tokens = np.diff(np.append(0, token_end))
        self.first = np.append(0, np.cumsum(tokens + 1))
        shift = np.repeat(np.arange(len(texts)), tokens)
        place = np.arange(len(ids)) + shift
        self.ids = np.full(len(ids) + len(texts), model.end, np.int64)
        self.ids[place] = ids
        # Bytes before each id in all normalised texts; each text adds its closing entry.
        source = np.concatenate([s for _, s in normal]) if normal else np.zeros(0, np.int64)
        base = np.append(0, np.cumsum([len(s) for _, s in normal]))
        before = np.append(0, np.cumsum(sizes))
        lead = before[np.append(0, token_end)[:-1]]
        offset = np.repeat(base[:-1] - lead, tokens)
        length = np.array([len(t.encode()) for t in texts], np.int64)
        self.starts, self.ends = (np.empty(len(self.ids), np.int64) for _ in range(2))
        self.starts[self.first[1:] - 1] = self.ends[self.first[1:] - 1] = length
        self.starts[place] = source[before[:-1] + offset]
        self.ends[place] = source[before[1:] + offset]
        end = str(model.end)
        self.decimal = [" ".join([*[table.decimal[n] for n in r], end]) for r in numbers]
        self.decoded = [model.shown("".join([table.surface[n] for n in r])) for r in numbers]


_units: dict[str, Units] = {}


def units_of(path: str) -> Units:
    if path not in _units:
        _units[path] = Units(Model(path))
    return _units[path]


def encoded(path: str, batch: pa.RecordBatch):
    """(ids of rows, Encoded) for slices of a batch of (doc_id, text)."""
    _, offsets = W.utf8(batch.column(1))
    for low, high in W.slices(offsets, W.SLICE_BYTES // 2):
        texts = batch.column(1).slice(low, high - low).to_pylist()
        yield batch.column(0).slice(low, high - low), Encoded(units_of(path), [t or "" for t in texts])


def encode_rows(path: str):
    """Map (doc_id, text) to ids, source spans and the decoded text of every row."""

    def run(batches):
        for batch in batches:
            for ids, e in encoded(path, batch):
                first = pa.array(e.first.astype(np.int32))
                lists = [pa.array(x.astype(np.int32)) for x in (e.ids, e.starts, e.ends)]
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.ListArray.from_arrays(first, x) for x in lists)]
                    + [pa.array(e.decoded, pa.string())],
                    ["doc_id", "ids", "starts", "ends", "decoded"],
                )

    return tidy(run)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digest_rows(path: str):
    """Map (doc_id, text) to token counts, digests and the source bytes that spans cover."""

    def run(batches):
        for batch in batches:
            for ids, e in encoded(path, batch):
                covered = np.add.reduceat(e.ends - e.starts, e.first[:-1]) if len(ids) else e.starts
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(e.first).astype(np.int64))]
                    + [pa.array([_sha(x) for x in e.decimal], pa.string())]
                    + [pa.array([_sha(x) for x in e.decoded], pa.string())]
                    + [pa.array(covered.astype(np.int64))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "source_bytes"],
                )

    return tidy(run)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(
        documents["doc_id"].cast("long").alias("doc_id"),
        text_column(documents, "text").alias("text"),
    )


def tokens(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) per row of ``documents`` (doc_id, text).

    ids as the library gives them, with an end id; starts and ends: the bytes of the source
    text (UTF-8) that each piece covers, end exclusive; decoded: the text of the ids. A null
    or empty text has the end id alone. Rows are independent: repeated rows and rows without
    doc_id are encoded each; an empty table gives an empty result; other columns are not
    read. ``path``: the model file, at the same place on every executor.
    """
    kinds = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"
    return _texts(documents).mapInArrow(encode_rows(path), kinds)


def token_digests(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, source_bytes) per row of ``documents``.

    As ``tokens``, reduced in the task; source_bytes: how many source bytes its spans cover.
    """
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, source_bytes long"
    return _texts(documents).mapInArrow(digest_rows(path), kinds)
