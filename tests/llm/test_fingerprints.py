import hashlib

import numpy as np
import pytest
import tables

from convolytics.llm import fingerprints as fp


def brute_anchors(text):
    """Places of closed syncmers, from their definition."""
    data = np.frombuffer(text, np.uint8)
    rank = []
    for i in range(len(data) - fp.S + 1):
        code = np.uint64(int.from_bytes(text[i : i + fp.S], "big"))
        rank.append(int(fp.W.mix(np.array([code]))[0]))
    out = []
    for i in range(len(text) - fp.K + 1):
        inner = rank[i : i + fp.K - fp.S + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out or ([0] if text else [])


def test_anchors():
    data = [t.encode()[:700] for t in tables.texts()]
    offsets = np.append(0, np.cumsum([len(t) for t in data]))
    row, place, _ = fp.anchors(np.frombuffer(b"".join(data), np.uint8), offsets)
    for i, t in enumerate(data):
        assert sorted(place[row == i].tolist()) == brute_anchors(t)


def test_likeness():
    base, other = tables.texts()[30].encode() * 20, tables.text_of(__import__("random").Random(8), 2000)
    a, b, c = fp.fingerprints([base, base, other.encode()])
    assert fp.likeness(a, b) == 1 and fp.likeness(a, c) < 0.2
    assert fp.likeness(a[:0], a[:0]) == 1 and fp.likeness(a, a[:0]) == 0
    text = other.encode()
    half = text[: len(text) // 2]
    x, y, z = fp.fingerprints([text, half + base[: len(half)], b"new words in front " + text])
    assert 0.3 < fp.likeness(x, y) < 0.7 and fp.likeness(x, z) > 0.85
    assert np.array_equal(fp.read(fp.written(x)), x)


@pytest.mark.parametrize("buckets", [1, 7])
def test_rows(docs, buckets):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 62)), r[1]))
    want = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        e = fp.edited(t, after)
        prints = fp.fingerprints([t.encode(), e.encode(), after.encode()])
        want.append(
            (
                str(d), len(t), hashlib.sha256(e.encode()).hexdigest(),
                fp.written(prints[0]), fp.written(prints[1]),
                fp.likeness(prints[0], prints[1]), fp.likeness(prints[0], prints[2]),
            )
        )
    got = [(str(r[0]), *tuple(r)[1:]) for r in fp.compared(docs, buckets).collect()]
    assert sorted(got) == sorted(want)


def test_few_rows(spark, empty):
    assert fp.compared(empty).count() == 0
    one = fp.compared(spark.createDataFrame([(3, "lonely text")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    none = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert fp.compared(none).count() == 2
