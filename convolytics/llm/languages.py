"""Language identification by a linear-chain conditional random field (operator 7).

Each word of a text has a language; the field scores words by features and neighbouring
languages by learned transitions, and the forward-backward algorithm gives every word's
probabilities, so that code-switched texts are told apart word by word. Features of a word
are its byte n-grams (2 to 4, with marks at both ends, so that those at an end are affixes)
and its entry in a lexicon of the words that the sample repeats.

Training joins stretches of labelled texts of different languages, so that transitions are
learned from switches too. Long texts are cut into chunks whose transfer matrices are
multiplied: all chunks of a slice advance together, and the result is that of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolytics.llm import words as W
from convolytics.llm.common import sized, text_column
from convolytics.llm.quality import remainder

#: The training sample: rows per language with the least hash of doc_id, and words of each,
#: in a row from a place that the id's hash gives.
ROWS_PER_LANGUAGE = 400
WORDS_PER_ROW = 160
BUCKETS = 1 << 16
LEXICON_LEAST = 3
CHUNK = 32
STEPS = 240
BATCH = 64
RATE = 0.25
#: Bytes of words: ASCII letters, and all of longer characters.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def letter_words(data: np.ndarray, offsets: np.ndarray):
    """Bytes with all others blanked, and start, end and row of each word."""
    clean = np.where(LETTER[data], data, np.uint8(32))
    return clean, *W.words(clean, offsets)


def ngram_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(bucket, word) of each n-gram of each word."""
    length = ends - starts + 2
    at = np.append(0, np.cumsum(length))
    owner = np.repeat(np.arange(len(starts)), length)
    take = np.arange(at[-1]) - at[owner] + starts[owner] - 1
    text = data[np.clip(take, 0, max(len(data) - 1, 0))].astype(np.uint64)
    text[at[:-1]], text[at[1:] - 1] = 94, 36  # ^ and $ around the word
    buckets, words = [], []
    for n in (2, 3, 4):
        if len(text) < n:
            continue
        code = np.full(len(text) - n + 1, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | text[k : len(text) - n + 1 + k]
        inside = owner[: len(code)] == owner[n - 1 :]
        buckets.append((W.mix(code[inside]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        words.append(owner[: len(code)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(words)


@dataclass
class Field:
    """A trained field: weights per n-gram bucket and lexicon word, transitions."""

    languages: list[str]
    lexicon: np.ndarray  # sorted word hashes
    ngrams: np.ndarray  # BUCKETS x languages
    entries: np.ndarray  # len(lexicon) + 1 x languages; the last: words outside
    moves: np.ndarray  # languages x languages

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, len(self.lexicon))

    def emissions(self, data, starts, ends, hashes) -> np.ndarray:
        """Log scores of every word in every language; equal words are scored once."""
        _, pick, back = np.unique(hashes, return_index=True, return_inverse=True)
        bucket, word = ngram_buckets(data, starts[pick], ends[pick])
        out = self.entries[self.lookup(hashes[pick])].astype(np.float64)
        for k in range(len(self.languages)):
            out[:, k] += np.bincount(word, weights=self.ngrams[bucket, k], minlength=len(pick))
        return out[back]


def marginals(logs: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probabilities of each word's language; sequence i has words first[i] to first[i + 1]."""
    n, k = logs.shape
    if n == 0:
        return logs
    a = np.exp(moves - moves.max())
    o = np.exp(logs - logs.max(axis=1, keepdims=True))
    counts = np.diff(first)
    chunks = -(-counts // CHUNK)
    row = np.repeat(np.arange(len(counts)), chunks)
    number = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = first[row] + number * CHUNK
    size = np.minimum(CHUNK, first[row + 1] - begin)
    # Words by place in their chunk; places past the end of a chunk hold ones and stay still.
    place = begin[:, None] + np.arange(CHUNK)[None, :]
    real = np.arange(CHUNK)[None, :] < size[:, None]
    obs = o[np.minimum(place, n - 1)]
    # Transfer matrix of each chunk: the product of moves and observations of its words.
    whole = np.broadcast_to(np.eye(k), (len(row), k, k)).copy()
    for t in range(CHUNK):
        on = real[:, t]
        step = (whole[on] @ a) * obs[on, t][:, None, :]
        whole[on] = step / step.sum(axis=(1, 2), keepdims=True)
    start, stop = np.empty((len(row), k)), np.empty((len(row), k))
    last = np.cumsum(chunks)
    head = last - chunks
    state = np.full((len(counts), k), 1 / k)
    for j in range(int(chunks.max())):
        rows = np.flatnonzero(chunks > j)
        c = head[rows] + j
        start[c] = state[rows]
        moved = np.einsum("ri,rij->rj", state[rows], whole[c])
        state[rows] = moved / moved.sum(axis=1, keepdims=True)
    state = np.full((len(counts), k), 1 / k)
    for j in range(int(chunks.max()) - 1, -1, -1):
        rows = np.flatnonzero(chunks > j)
        c = head[rows] + j
        stop[c] = state[rows]
        moved = np.einsum("rij,rj->ri", whole[c], state[rows])
        state[rows] = moved / moved.sum(axis=1, keepdims=True)
    ahead = np.empty((len(row), CHUNK, k))
    state = start
    for t in range(CHUNK):
        state = (state @ a) * obs[:, t]
        state = state / state.sum(axis=1, keepdims=True)
        ahead[:, t] = state
    back = stop
    for t in range(CHUNK - 1, -1, -1):
        on = real[:, t][:, None]
        ahead[:, t] *= back
        moved = (obs[:, t] * back) @ a.T
        back = np.where(on, moved / moved.sum(axis=1, keepdims=True), back)
    out = ahead[real]
    return out / out.sum(axis=1, keepdims=True)


def _gradient(logs: np.ndarray, labels: np.ndarray, moves: np.ndarray):
    """Expected minus observed counts: per word, and of moves. logs: sequences x words x k."""
    b, t, k = logs.shape
    a = np.exp(moves - moves.max())
    o = np.exp(logs - logs.max(axis=2, keepdims=True))
    ahead, back = np.empty_like(o), np.empty_like(o)
    state = np.full((b, k), 1 / k)
    for i in range(t):
        state = (state @ a) * o[:, i]
        state /= state.sum(axis=1, keepdims=True)
        ahead[:, i] = state
    state = np.full((b, k), 1 / k)
    for i in range(t - 1, -1, -1):
        back[:, i] = state
        state = (o[:, i] * state) @ a.T
        state /= state.sum(axis=1, keepdims=True)
    words = ahead * back
    words /= words.sum(axis=2, keepdims=True)
    pair = ahead[:, :-1, :, None] * a[None, None] * (o * back)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    expected = pair.sum(axis=(0, 1))
    np.subtract.at(expected, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    words[np.arange(b)[:, None], np.arange(t)[None, :], labels] -= 1
    return words, expected


def train(sample: list[tuple[str, str]]) -> Field:
    """The field of (language, text) pairs, in a given order."""
    languages = sorted({lang for lang, _ in sample})
    k = len(languages)
    data, offsets = W.utf8(pa.array([t for _, t in sample], pa.string()))
    clean, starts, ends, rows = letter_words(data, offsets)
    hashes = W.span_hashes(W.BYTE[clean], starts, ends)
    unique, pick, back, counts = np.unique(
        hashes, return_index=True, return_inverse=True, return_counts=True
    )
    field = Field(
        languages,
        unique[counts >= LEXICON_LEAST],
        np.zeros((BUCKETS, k), np.float32),
        np.zeros(((counts >= LEXICON_LEAST).sum() + 1, k), np.float32),
        np.zeros((k, k)),
    )
    if k < 2 or len(hashes) == 0:
        return field
    entry = field.lookup(unique)
    bucket, word = ngram_buckets(clean, starts[pick], ends[pick])
    order = np.argsort(word, kind="stable")
    bucket = bucket[order]
    grams = W.row_starts(word[order], len(unique))
    first = W.row_starts(rows, len(sample))
    label = np.array([languages.index(lang) for lang, _ in sample])
    of_language = [np.flatnonzero((label == i) & (np.diff(first) > 0)) for i in range(k)]
    of_language = [x for x in of_language if len(x)]
    rng = np.random.default_rng(7)
    sums = [np.full(x.shape, 1e-6) for x in (field.ngrams, field.entries, field.moves)]
    for _ in range(STEPS):
        words, labels = np.empty((BATCH, CHUNK), np.int64), np.empty((BATCH, CHUNK), np.int64)
        for s in range(BATCH):
            at = 0
            while at < CHUNK:  # stretches of one text each, of random length
                texts = of_language[rng.integers(len(of_language))]
                text = texts[rng.integers(len(texts))]
                size = min(CHUNK - at, int(rng.integers(3, CHUNK + 1)), first[text + 1] - first[text])
                begin = rng.integers(first[text], first[text + 1] - size + 1)
                words[s, at : at + size] = back[begin : begin + size]
                labels[s, at : at + size] = label[text]
                at += size
        flat = words.ravel()
        count = grams[flat + 1] - grams[flat]
        stop = np.cumsum(count)
        take = np.repeat(grams[flat] - (stop - count), count) + np.arange(stop[-1])
        features, owner = bucket[take], np.repeat(np.arange(len(flat)), count)
        logs = field.entries[entry[flat]].astype(np.float64)
        for i in range(k):
            logs[:, i] += np.bincount(owner, weights=field.ngrams[features, i], minlength=len(flat))
        words_grad, moves_grad = _gradient(logs.reshape(BATCH, CHUNK, k), labels, field.moves)
        g = words_grad.reshape(-1, k) / BATCH
        ngram_grad = np.stack(
            [np.bincount(features, weights=g[owner, i], minlength=BUCKETS) for i in range(k)], axis=1
        )
        entry_grad = np.stack(
            [
                np.bincount(entry[flat], weights=g[:, i], minlength=len(field.entries))
                for i in range(k)
            ],
            axis=1,
        )
        for x, gradient, total in zip(
            (field.ngrams, field.entries, field.moves),
            (ngram_grad, entry_grad, moves_grad / BATCH),
            sums,
            strict=True,
        ):
            gradient = gradient + 1e-5 * x
            total += gradient**2
            x -= (RATE * gradient / np.sqrt(total)).astype(x.dtype)
    return field


def excerpt_rows(batches):
    """Map (doc_id, lang, text) to (lang, text): up to WORDS_PER_ROW words in a row of each."""
    for batch in batches:
        langs, texts = [], []
        for i, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.split()
            room = max(0, len(words) - WORDS_PER_ROW)
            begin = int(W.mix(np.array([i], np.int64).view(np.uint64))[0]) % (room + 1)
            langs.append(lang)
            texts.append(" ".join(words[begin : begin + WORDS_PER_ROW]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(texts, pa.string())], ["lang", "text"]
        )


def sample_of(documents: DataFrame) -> list[tuple[str, str]]:
    """The bounded training sample of rows whose crc32(doc_id as text) mod 5 is not 0."""
    ids = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"), documents["lang"].cast("string").alias("lang")
    ).where((remainder(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull())
    # Of a common language only the rows in a range of hashes that holds half as many again
    # as are wanted are ranked, so that no task ranks all rows of a language.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("_c"))
    near = ids.join(sized(sizes), "lang").where(
        place.cast("double") * F.col("_c") <= 1.5 * ROWS_PER_LANGUAGE * (1 << 30)
    )
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    picked = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= ROWS_PER_LANGUAGE)
    rows = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"),
        documents["lang"].cast("string").alias("lang"),
        F.lower(text_column(documents, "text")).alias("text"),
    )
    # At most ROWS_PER_LANGUAGE rows per language: a small table.
    chosen = rows.join(F.broadcast(picked.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    out = chosen.select("doc_id", "lang", "text").mapInArrow(excerpt_rows, "lang string, text string")
    return sorted((r.lang, r.text) for r in out.collect())


def predicted_rows(field: Field):
    """Map (doc_id, text) to (doc_id, lang_pred, score, by_language)."""

    def run(batches):
        k = len(field.languages)
        names = np.array([*field.languages, "und"], object)
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            for low, high in W.slices(offsets):
                part = data[offsets[low] : offsets[high]]
                clean, starts, ends, rows = letter_words(part, offsets[low : high + 1] - offsets[low])
                n = high - low
                share = np.zeros((n, max(k, 1)))
                if k and len(starts):
                    hashes = W.span_hashes(W.BYTE[clean], starts, ends)
                    logs = field.emissions(clean, starts, ends, hashes)
                    first = W.row_starts(rows, n)
                    each = marginals(logs, first, field.moves)
                    for i in range(k):
                        share[:, i] = np.bincount(rows, weights=each[:, i], minlength=n)
                total = share.sum(axis=1)
                lettered = total > 0
                # Without ASCII letters it takes a look at the characters.
                ascii_ = np.bincount(rows, weights=clean[starts] < 128, minlength=n) > 0
                for i in np.flatnonzero(lettered & ~ascii_).tolist():
                    text = batch.column(1)[low + i].as_py() or ""
                    lettered[i] = any(c.isalpha() for c in text)
                best = np.where(lettered, share.argmax(axis=1), k)
                share = share / np.maximum(total, 1e-300)[:, None]
                score = np.where(lettered, share.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, n),
                        pa.array(names[best].tolist(), pa.string()),
                        pa.array(np.clip(score, 0, 1)),
                    ],
                    ["doc_id", "lang_pred", "score"],
                )

    return run


def predictions(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``documents`` (doc_id, text, lang).

    Learns from rows with a language whose crc32(doc_id as text) mod 5 is not 0; held_out
    marks the others (null without doc_id). lang_pred: the language with the greatest
    expected number of words (the first by name of equal ones), score: its share of words.
    ``und`` with score 0 if the text is null or has no letter, or nothing could be learned.
    Repeated rows are judged each; an empty table gives an empty result; no other column is
    read.
    """
    field = train(sample_of(documents))
    texts = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"),
        F.lower(text_column(documents, "text")).alias("text"),
    )
    out = texts.mapInArrow(predicted_rows(field), "doc_id long, lang_pred string, score double")
    return out.select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score"
    )
