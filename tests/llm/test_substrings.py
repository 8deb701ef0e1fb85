import hashlib

import numpy as np
import pytest

from convolytics.llm import substrings


def brute(rows, size):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in rows]
    first = {}
    for d, w in rows:
        for i in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[i : i + size])
                first[key] = min(d, first.get(key, d))
    for d, w in rows:
        alive = [True] * len(w)
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                alive[i : i + size] = [False] * size
        kept = [x for x, a in zip(w, alive, strict=True) if a]
        yield d or -1, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


@pytest.mark.parametrize("size, chunk", [(13, 1 << 23), (13, 900), (4, 900)])
def test_repeats(docs, monkeypatch, size, chunk):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    got = substrings.without_repeats(docs, size).collect()
    want = sorted(brute(docs.collect(), size))
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert any(r[2] for r in want)


def test_equal_hashes_are_compared(monkeypatch):
    """With hashes that always meet, the words themselves decide."""
    monkeypatch.setattr(
        substrings.W, "window_hashes", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64)
    )
    text = b"a b c d a b x d"
    offsets = np.array([0, 8, 15])
    p = substrings.Pieces(np.frombuffer(b"a b c d a b c x", np.uint8), offsets)
    at, found = substrings.repeats(p, np.array([1, 2]), 3)
    assert text and at.tolist() == [0, 1, 4, 5] and found.tolist() == [False, False, True, False]


def test_empty(empty):
    assert substrings.without_repeats(empty).count() == 0
