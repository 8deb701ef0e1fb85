import numpy as np
import pytest

from convolytics.llm import jaccard


def sets(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, percent):
    """Least id reachable by links, of every id."""
    own = [(r.doc_id, sets(r.text, n)) for r in rows if r.doc_id is not None]
    least = {d: d for d, _ in own}
    changed = True
    while changed:
        changed = False
        for i, (d, s) in enumerate(own):
            for e, t in own[:i]:
                both = len(s & t)
                linked = s and t and 100 * both >= percent * (len(s) + len(t) - both)
                if linked and least[d] != least[e]:
                    least[d] = least[e] = min(least[d], least[e])
                    changed = True
    return least


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_components(docs, n, percent):
    rows = docs.collect()
    want = brute(rows, n, percent)
    got = jaccard.linked(docs, n, percent).collect()
    assert len(got) == len(rows)
    assert sorted(len(sets(r.text, n)) for r in rows) == sorted(r.n_shingles for r in got)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])


def test_many_near_copies(spark):
    """A group with links that only some of its members have."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(1, 12)):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(frame.collect(), 4, 85)
    assert {r.doc_id: r.component_id for r in jaccard.linked(frame).collect()} == want


def test_no_pair_is_lost():
    """Random sets at the threshold always share a segment that both send."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        out = int(rng.integers(0, size * 15 // 85 + 1))
        b = a[: len(a) - out // 2]
        b = np.concatenate([b, rng.integers(0, 1 << 63, out - out // 2, dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        grams = [np.unique(a), np.unique(b)]
        rows = np.repeat([0, 1], [len(g) for g in grams])
        row, sig = jaccard._segments(
            rows, np.concatenate(grams), np.array([len(g) for g in grams]), 85
        )
        assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def test_representatives(docs):
    want = brute(docs.collect(), 4, 85)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert ids.count(None) == 1


def test_empty(empty):
    assert jaccard.linked(empty).count() == 0
    assert jaccard.representatives(empty).count() == 0
