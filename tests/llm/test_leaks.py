import random

import numpy as np
import pytest
import tables

from convolytics.llm import leaks


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(9)
    items = [(i, tables.text_of(rng, n)) for i, n in enumerate([3, 6, 15, 16, 23, 40, 59, 130, 300])]
    items += [(20, None), (21, " "), (5, items[5][1])]
    return spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")


def test_leaks(spark, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect() if r.text and r.text.strip()]
    rng = random.Random(4)
    more = [f"{tables.text_of(rng, rng.randint(0, 60))} {t}\n{tables.text_of(rng, 9)}" for _, t in items]
    more += [items[5][1].upper(), items[4][1]]
    docs = tables.documents(spark, more)
    want = set()
    for r in docs.collect():
        words = (r.text or "").lower().split()
        for item, text in items:
            wanted = text.lower().split()
            n = len(wanted)
            a = leaks.shingles(wanted)
            for i in range(len(words) - n + 1):
                if leaks.similarity(leaks.shingles(words[i : i + n]), a) >= 0.8:
                    want.add((r.doc_id, item))
                    break
    got = leaks.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.similarity >= 0.8 and r.end > r.start for r in got)
    clean = leaks.clean(docs, benchmark)
    assert clean.columns == docs.columns
    bad = {d for d, _ in want}
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(
        r.doc_id or -1 for r in docs.collect() if r.doc_id not in bad
    )


def test_blocks_of_items(spark, benchmark, monkeypatch):
    docs = spark.createDataFrame([(1, r.text) for r in benchmark.collect()], "doc_id long, text string")
    whole = leaks.leaks(docs, benchmark).collect()
    monkeypatch.setattr(leaks, "ITEMS_PER_PASS", 2)
    assert sorted(leaks.leaks(docs, benchmark).collect()) == sorted(whole)


def test_index_misses_none_within_the_radius():
    rng = np.random.default_rng(3)
    index = leaks.Index([(0, "a b c d e f g h i j k l m n o p")])
    size, prints, marks, _ = index.groups[0]
    assert size <= 16
    for _ in range(500):
        flips = rng.choice(64, int(rng.integers(0, leaks.RADIUS + 1)), replace=False)
        other = int(prints[0]) ^ sum(1 << int(b) for b in flips)
        assert any(marks[b][(other >> 16 * b) & 0xFFFF] for b in range(4))


def test_wide_windows_have_the_same_prints():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    grams = leaks.pairs(hashes)
    for size in (2, 15, 120, 250, 251, 400):
        wide = leaks._wide(size)
        counts = leaks._lanes(grams, wide)[: size - 1].sum(axis=0, dtype=np.uint64)[None, :]
        assert int(leaks._prints(counts, size - 1, wide)[0]) == leaks.simhash(hashes[:size])


def test_empty(spark, docs, empty, benchmark):
    assert leaks.leaks(empty, benchmark).count() == 0
    assert leaks.leaks(docs, benchmark.limit(0)).count() == 0
    assert leaks.clean(docs, benchmark.limit(0)).count() == docs.count()


def test_rows_shorter_than_an_item(spark):
    """Whole rows that are an item with words missing, next to a brute force over whole rows."""
    rng = random.Random(12)
    items = [(i, tables.text_of(rng, n)) for i, n in enumerate([5, 6, 7, 9, 12, 16, 23, 40, 59, 130, 300])]
    texts = []
    for _, text in items:
        words = text.split()
        n = len(words)
        for k in sorted({1, 2, n // 12, n // 8, n // 6, n // 5, n // 4}):
            texts += [" ".join(words[: n - k]), " ".join(words[k:])]
            texts.append(" ".join(words[k // 2 : n - (k - k // 2)]))
            middle = rng.randrange(n - k + 1)
            texts.append(" ".join(words[:middle] + words[middle + k :]))
    want = {}
    for d, text in enumerate(texts):
        words = text.split()
        for item, other in items:
            wanted = other.split()
            if len(words) < len(wanted):
                s = leaks.similarity(leaks.shingles(words), leaks.shingles(wanted))
                if s >= 0.8:
                    want[d, item] = (0, len(words), s)
    assert len({item for _, item in want}) >= 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.end, r.similarity) for r in leaks.leaks(docs, benchmark).collect()}
    assert {k: v for k, v in got.items() if k in want} == want
    assert {d for d, _ in want}.isdisjoint(r.doc_id for r in leaks.clean(docs, benchmark).collect())


def test_an_item_less_its_last_word_is_a_leak():
    rng = random.Random(2)
    text = tables.text_of(rng, 59)
    index = leaks.Index([(7, text)])
    words = leaks.word_hashes([text.rsplit(" ", 1)[0]])[0]
    ((row, item, start, end, s),) = index.matches(words, np.array([0, len(words)]))
    assert (row, item, start, end) == (0, 7, 0, 58) and s == 54 / 55


@pytest.mark.parametrize("seed", [250, 708, 1, 2, 3])
def test_near_copies_at_the_end_of_a_row(seed):
    """No window of a grid follows there; of these seeds two were missed by steps alone."""
    rng = random.Random(seed)
    item = [f"w{rng.getrandbits(30)}" for _ in range(60)]
    copy = list(item)
    for _ in range(2):
        copy[rng.randrange(10, 50)] = f"x{rng.getrandbits(30)}"
    doc = [f"y{rng.getrandbits(30)}" for _ in range(rng.randrange(200, 400))] + copy
    a, b = leaks.word_hashes([" ".join(item), " ".join(doc)])
    s = leaks.similarity(leaks.shingles(b[-60:].tolist()), leaks.shingles(a.tolist()))
    got = leaks.Index([(0, " ".join(item))]).matches(b, np.array([0, len(b)]))
    assert [(start, end) for *_, start, end, _ in got] == [(len(b) - 60, len(b))] * (s >= 0.8)
