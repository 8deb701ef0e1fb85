"""Quality classifier: regularised quadratic discriminant analysis (operator 1).

A document becomes a vector of statistics of its whole text, transformed towards a normal
shape: logarithms of counts and lengths, arcsines of the roots of shares. Each class has a
normal density whose covariance shrinks towards the pooled one and towards a multiple of
the identity. A score is the difference of the two log densities, from Mahalanobis lengths
by Cholesky factors that are computed once, mapped to a probability by a logistic curve.
Both amounts of shrinkage, and the curve, are chosen by cross-validation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.llm import words as W
from convolytics.llm.common import keep, text_column

#: At most so many labelled rows, those with the least hash of doc_id, are learned from.
MAX_LABELLED = 50_000
FOLDS = 5
#: Shares of the pooled covariance and of the identity that are tried.
POOLED = (0.02, 0.1, 0.3, 0.6)
IDENTITY = (0.001, 0.01, 0.05)

_CLASS = np.zeros(256, np.uint8)
for _i, _group in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c"),
    1,
):
    _CLASS[list(_group)] = _i
_CLASS[10] = 5
_CLASS[list(b".,;:?'-\"()")] = 6
_CLASS[list(b"!")] = 7
_CLASS[list(b"|")] = 8
_CLASS[128:] = 9
#: Class 0 is every other byte: symbols and controls.
CLASSES = 10
FEATURES = 24


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1)))


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each row has."""
    key = np.unique((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    return np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    counts = np.bincount(row * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    starts, ends, wrow = W.words(data, offsets)
    length = ends - starts
    words = np.bincount(wrow, minlength=n)
    per_word = lambda flags: np.bincount(wrow, weights=flags, minlength=n)
    inside = lambda flags: (c := np.append(0, np.cumsum(flags, dtype=np.int64)))[ends] - c[starts]
    upper, lower = inside(kind == 1), inside(kind == 2)
    odd = inside((kind == 0) | (kind == 7) | (kind == 8))
    hashes = W.span_hashes(W.BYTE[W.LOWER[data]], starts, ends)
    mean = per_word(length) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(per_word(length**2) / np.maximum(words, 1) - mean**2, 0))
    # Lines: a break closes one, the end of a text the last.
    breaks = np.flatnonzero(data == 10)
    line_end = np.union1d(breaks + 1, offsets[1:][size > 0])
    line_start = np.append(0, line_end[:-1]) if len(line_end) else line_end
    lrow = np.searchsorted(offsets, line_start, side="right") - 1
    lines = np.bincount(lrow, minlength=n)
    lhash = W.span_hashes(W.BYTE[data], line_start, line_end)
    table = [
        np.log1p(size),
        np.log1p(words),
        np.log1p(lines),
        np.log1p(mean),
        np.log1p(spread),
        np.log1p(size / np.maximum(lines, 1)),
        *[_share(counts[:, k], size) for k in range(CLASSES)],
        _share(counts[:, 1], counts[:, 1] + counts[:, 2]),
        _share(_distinct(wrow, hashes, n), words),
        _share(_distinct(lrow, lhash, n), lines),
        _share(per_word(odd > 0), words),
        _share(per_word((upper > lower) & (upper > 1)), words),
        _share(per_word(length <= 3), words),
        _share(per_word(length >= 16), words),
        _share(counts[:, 6], words),
    ]
    out = np.stack(table, axis=1)
    out[size == 0] = 0
    return out


def statistic_rows(batches):
    """Map (doc_id, text) to (doc_id, x): the statistics of each row."""
    for batch in batches:
        data, offsets = W.utf8(batch.column(1))
        for low, high in W.slices(offsets):
            part = data[offsets[low] : offsets[high]]
            x = statistics(part, offsets[low : high + 1] - offsets[low])
            at = pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, high - low),
                    pa.ListArray.from_arrays(at, pa.array(x.ravel())),
                ],
                ["doc_id", "x"],
            )


@dataclass
class Discriminant:
    """A fitted model; ``slope`` and ``shift`` map density differences to log odds."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray  # inverses of the Cholesky factors of both covariances
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 minus that under class 0."""
        z = (x - self.centre) / self.scale
        lengths = [
            (((z - m) @ w.T) ** 2).sum(axis=1)
            for w, m in zip(self.whiten, self.means, strict=True)
        ]
        return self.offset + 0.5 * (lengths[0] - lengths[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(x) == 0:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -500, 500)))


def _fit(x: np.ndarray, y: np.ndarray, pooled: float, identity: float) -> Discriminant:
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - centre) / scale
    means = np.stack([z[y == c].mean(axis=0) for c in (0, 1)])
    scatter = [(z[y == c] - means[c]).T @ (z[y == c] - means[c]) for c in (0, 1)]
    whiten, logs = [], []
    for c in (0, 1):
        n = (1 - pooled) * (y == c).sum() + pooled * len(y)
        cov = ((1 - pooled) * scatter[c] + pooled * (scatter[0] + scatter[1])) / n
        p = len(cov)
        cov = (1 - identity) * cov + identity * max(np.trace(cov) / p, 1e-6) * np.eye(p)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        logs.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, means, np.stack(whiten), 0.5 * (logs[0] - logs[1]))


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(slope, shift, mean loss) of the curve that maps margins to the labels' odds."""
    unit = max(float(np.abs(m).mean()), 1e-9)
    design = np.stack([m / unit, np.ones_like(m)], axis=1)
    w = np.zeros(2)
    target = (y * (y.sum() + 1) + (1 - y)) / np.where(y == 1, y.sum() + 2, (1 - y).sum() + 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (p - target) + 1e-6 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ w, -30, 30))), 1e-9, 1 - 1e-9)
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    return float(w[0] / unit), float(w[1]), float(loss)


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """The discriminant of labelled rows, in a given order.

    With fewer than two rows of a class there is no density: the score is then the smoothed
    share of label 1 for every text (0.5 without labels).
    """
    if len(y) == 0 or min((y == 0).sum(), (y == 1).sum()) < 2:
        p = x.shape[1] if len(y) else FEATURES
        share = (y.sum() + 1) / (len(y) + 2)
        flat = np.zeros(p)
        return Discriminant(
            flat, flat + 1, np.zeros((2, p)), np.stack([np.eye(p)] * 2), 0.0, 0.0, float(np.log(share / (1 - share)))
        )
    fold = np.empty(len(y), int)
    for c in (0, 1):  # each fold has rows of both classes if they reach
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    best = None
    for pooled in POOLED:
        for identity in IDENTITY:
            m = np.zeros(len(y))
            for f in range(FOLDS):
                train = fold != f
                if min((y[train] == 0).sum(), (y[train] == 1).sum()) < 1:
                    train = np.ones(len(y), bool)
                if (fold == f).any():
                    m[fold == f] = _fit(x[train], y[train], pooled, identity).margin(x[fold == f])
            slope, shift, loss = _logistic(m, y)
            if best is None or loss < best[0]:
                best = loss, pooled, identity, slope, shift
    _, pooled, identity, slope, shift = best
    model = _fit(x, y, pooled, identity)
    model.slope, model.shift = slope, shift
    return model


def score_rows(model: Discriminant):
    """Map (doc_id, held_out, x) to (doc_id, held_out, score, predicted)."""

    def run(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def learned(vectors: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Discriminant:
    """The model of the rows of ``vectors`` (doc_id, x) that ``labels`` (doc_id, quality) covers.

    Only labels 0 and 1 count, each label row once; rows without doc_id are left out. Of
    very many labels those whose hash lies in a range that holds half as many again as the
    limit are joined, so that no task sorts more than a few times the limit.
    """
    known = labels.select(
        labels["doc_id"].cast("long").alias("doc_id"),
        labels["quality"].cast("int").alias("quality"),
    ).where("quality in (0, 1) and doc_id is not null")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, 1.5 * limit / max(1, known.count()))
    rows = (
        vectors.select("doc_id", "x")
        .join(known.where(place <= int(share * (1 << 30))), "doc_id")
        .orderBy(place, "doc_id", "quality", "x")
        .limit(limit)
        .select("x", "quality")
        .collect()
    )
    x = np.array([r.x for r in rows], float).reshape(-1, FEATURES)
    return fit(x, np.array([r.quality for r in rows], int))


def scores(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``documents`` (doc_id, text).

    Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1; held_out
    marks the others (null without doc_id). score: how likely label 1 is, 0 to 1; predicted:
    1 from 0.5 on. Null texts count as empty; these are scored like any text. Repeated rows
    are scored each; an empty table gives an empty result; other columns are not read.
    """
    texts = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"),
        text_column(documents, "text").alias("text"),
    )
    vectors = texts.mapInArrow(statistic_rows, "doc_id long, x array<double>")
    vectors = vectors.withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    vectors = keep(vectors.select("doc_id", "held_out", "x"), "quality-vectors")
    model = learned(vectors.where(~F.col("held_out")), labels, limit)
    return vectors.mapInArrow(
        score_rows(model), "doc_id long, held_out boolean, score double, predicted int"
    )


def accepted(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``documents`` that are not predicted 0, all columns as they are."""
    rejected = keep(
        scores(documents, labels, limit).where("predicted = 0 and doc_id is not null")
        .select(F.col("doc_id").alias("_id")).distinct(),
        "quality-rejected",
    )
    return documents.join(
        rejected, documents["doc_id"].cast("long") == rejected["_id"], "left_anti"
    )
