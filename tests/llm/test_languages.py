import zlib

import numpy as np
from pyspark.sql import functions as F

from convolytics.llm import languages
from convolytics.llm.queries import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    more = [(10**6, None, "en"), (10**6 + 1, " 12, … \U0001f600", "en"), (None, "the and of", None)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    rows = languages.predictions(docs).collect()
    known = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id < 10**6]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id is None:
            assert r.held_out is None and r.lang_pred == "en"
        else:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in (10**6, 10**6 + 1):
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_held_out_rows_are_not_learned(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    assert languages.sample_of(docs) == languages.sample_of(other)


def test_marginals_of_words():
    """Chunks and transfer matrices give what plain forward-backward gives."""
    rng = np.random.default_rng(1)
    moves = rng.normal(size=(3, 3))
    sizes = [0, 1, 31, 32, 33, 200, 0]
    logs = rng.normal(size=(sum(sizes), 3)) * 3
    first = np.append(0, np.cumsum(sizes))
    got = languages.marginals(logs, first, moves)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        ahead, back = [logs[a] + np.logaddexp.reduce(moves, axis=0)], [np.zeros(3)]
        for x in logs[a + 1 : b]:
            ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + moves, axis=0) + x)
        for x in logs[a + 1 : b][::-1]:
            back.append(np.logaddexp.reduce(moves + (x + back[-1])[None, :], axis=1))
        p = np.array(ahead) + np.array(back[::-1])
        p = np.exp(p - np.logaddexp.reduce(p, axis=1)[:, None])
        assert np.allclose(p, got[a:b])


def test_gradient_of_the_likelihood():
    """Expected minus observed counts are the slope of the log partition function."""
    rng = np.random.default_rng(2)
    logs, moves = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3))
    labels = rng.integers(0, 3, (2, 5))

    def loss(logs, moves):
        total = 0.0
        for x, y in zip(logs, labels, strict=True):
            state = np.logaddexp.reduce(moves - np.log(3), axis=0) + x[0]
            for o in x[1:]:
                state = np.logaddexp.reduce(state[:, None] + moves, axis=0) + o
            path = x[np.arange(5), y].sum() + moves[y[:-1], y[1:]].sum()
            total += np.logaddexp.reduce(state) - path
        return total

    words, pairs = languages._gradient(logs, labels, moves)
    for i in ((0, 0, 1), (1, 3, 2)):
        up = logs.copy()
        up[i] += 1e-5
        assert abs((loss(up, moves) - loss(logs, moves)) / 1e-5 - words[i]) < 1e-3
    assert pairs.shape == (3, 3) and abs(pairs.sum()) < 1e-9


def test_code_switching(spark):
    """Words of a mixed text keep their own language."""
    docs = table(spark, SF, "documents")
    field = languages.train(languages.sample_of(docs))
    rows = docs.where("lang in ('en', 'de') and n_chars between 600 and 1500").orderBy("doc_id").collect()
    de, en = (next(r.text for r in rows if r.lang == x).lower() for x in ("de", "en"))
    data = np.frombuffer((de + " " + en).encode(), np.uint8)
    clean, starts, ends, _ = languages.letter_words(data, np.array([0, len(data)]))
    hashes = languages.W.span_hashes(languages.W.BYTE[clean], starts, ends)
    each = languages.marginals(
        field.emissions(clean, starts, ends, hashes), np.array([0, len(starts)]), field.moves
    )
    said = np.array(field.languages)[each.argmax(axis=1)]
    border = starts < len(de.encode())
    assert (said[border] == "de").mean() > 0.9 and (said[~border] == "en").mean() > 0.9


def test_hostile_rows(docs, empty):
    rows = docs.collect()
    got = languages.predictions(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows)
    for r in got:
        text = next(x.text for x in rows if x.doc_id == r.doc_id) or ""
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
    assert languages.predictions(empty).count() == 0
    alone = languages.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("und", 0.0)}
