import zlib

import numpy as np
import tables

from convolytics.llm import quality
from convolytics.llm.queries import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels")
    rows = quality.scores(table(spark, SF, "documents"), labels).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    out = [r for r in rows if r.held_out and r.doc_id in known]
    assert np.mean([r.predicted == known[r.doc_id] for r in out]) > 0.95


def test_scores_do_not_see_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.selectExpr(
        "doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality", "1 as x"
    )
    one, two = (
        {r.doc_id: r.score for r in quality.scores(docs, x).collect()} for x in (labels, turned)
    )
    assert one == two


def test_density_difference():
    """Against densities written out in full."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 3)), rng.normal(1, 2, size=(200, 3))])
    y = np.repeat([0, 1], [300, 200])
    m = quality._fit(x, y, 0.1, 0.01)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    logs = []
    scatter = [np.cov(z[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)]
    for c in (0, 1):
        cov = (0.9 * scatter[c] + 0.1 * sum(scatter)) / (0.9 * (y == c).sum() + 0.1 * 500)
        cov = 0.99 * cov + 0.01 * np.trace(cov) / 3 * np.eye(3)
        d = z - z[y == c].mean(axis=0)
        logs.append(-0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.sum(d @ np.linalg.inv(cov) * d, axis=1))
    assert np.allclose(m.margin(x), logs[1] - logs[0])


def test_hostile_rows(spark, docs, empty):
    ids = [r.doc_id for r in docs.collect()]
    rows = [(i, j % 3 if j % 5 else None, "n") for j, i in enumerate(ids)] * 2
    labels = spark.createDataFrame(rows, "doc_id long, quality int, text string")
    got = quality.scores(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, ids))
    assert all(0 <= r.score <= 1 for r in got)
    few = quality.scores(docs, labels.limit(0)).collect()
    assert {r.score for r in few} == {0.5}
    assert quality.scores(empty, labels).count() == 0
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    rejected = {r.doc_id for r in got if r.predicted == 0}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(i) for i in ids if i is None or i not in rejected
    )


def test_statistics_of_slices():
    """A text has the same statistics alone and among others."""
    data = [t.encode() for t in tables.texts()]
    offsets = np.append(0, np.cumsum([len(t) for t in data]))
    whole = quality.statistics(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert whole.shape == (len(data), quality.FEATURES) and np.isfinite(whole).all()
    for t, x in zip(data, whole, strict=True):
        alone = quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone[0], x)
