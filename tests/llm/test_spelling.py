import random
import re
import zlib

import pytest

from convolytics.llm import spelling


def brute_words(rows):
    counts = {}
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            low = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            if len(low) >= 7:
                counts[low] = counts.get(low, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = brute_words(rows)
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], counts.get(form[w]), root)
    return out


def check(frame):
    got = spelling.variants(frame).collect()
    want = brute(frame.collect())
    assert len(got) == len(want)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want
    return want


def texts(seed):
    """Few stems, many slips, over letters that repeat and letters beyond ASCII."""
    rng = random.Random(seed)
    letters = "aabcéñÀß"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(12)]
    out = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 40)):
            word = stems[min(int(rng.expovariate(0.5)), 11)]
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(word) + 1)
                kind = rng.randrange(3)
                word = word[:at] + (rng.choice(letters) if kind else "") + word[at + (kind < 2) :]
            words.append(word.upper() if rng.random() < 0.1 else word)
        out.append((i, rng.choice([" ", ". ", "1"]).join(words)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_neighbours(spark, seed):
    want = check(spark.createDataFrame(texts(seed), "doc_id long, text string"))
    assert sum(v[1] for v in want.values()) > 500
    assert any(v[4] != v[2] for v in want.values() if v[2])


def test_chain_of_forms(spark):
    """aaaaaaa <- baaaaaa (10 times as often) <- bbaaaaa (100 times): the root is the last."""
    words = ["bcaaaaa"] * 400 + ["baaaaaa"] * 40 + ["aaaaaaa"] * 3
    rows = [(i, w) for i, w in enumerate(words) if zlib.crc32(f"{i}:{w}".encode()) % 31]
    want = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert want["aaaaaaa"][2] == "baaaaaa" and want["aaaaaaa"][4] == "bcaaaaa"


def test_long_runs(spark):
    """Runs of many thousand letters: pairs grow with the length, not with its square."""
    long = "ab" * 20_000
    rows = [(i, t) for i, t in enumerate([long, long, long + "x", long + "x", "c" + long, "c" + long])]
    got = {len(r.word): r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_words(spark.createDataFrame(rows, "doc_id long, text string").collect())
    assert sorted(got) == sorted({len(w) for w in want})
    assert got[40_000].n_near == sum(len(w) == 40_001 for w in want)


def test_odd_rows(docs, empty):
    check(docs)
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(empty).columns == ["word", "n", "n_near", "form", "form_n", "root"]
