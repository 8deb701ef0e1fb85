import random
import re

import numpy as np

from convolytics.llm import licenses
from convolytics.llm.licenses import TEMPLATES, WORD

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(WORD, low)


def brute(text):
    words = words_of(text)
    places, found = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                found.add(label)
    ends = (min(places), max(places)) if places else (None, None)
    return (len(words), len(places), *ends, ",".join(sorted(found)))


def texts():
    rng = random.Random(4)
    plain = "the of under license a mit cc by nc version 2 apache é".split()
    out = []
    for i in range(150):
        parts = [rng.choice(plain) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            line = rng.choice([*PHRASES, "Apache License, Version 2.0", "CC BY-NC 4.0", "Under the MIT\nlicense!"])
            parts.insert(rng.randint(0, len(parts)), line)
        out.append((i, " ".join(parts)))
    out.append((900, "under the mit license " * 3000))
    out.append((901, "x" * 100_000 + " cc by nc"))
    return out


def test_phrases(spark, docs):
    frame = spark.createDataFrame(texts(), "doc_id long, text string")
    for table in (frame, docs):
        rows = table.collect()
        got = licenses.labels(table).collect()
        assert len(got) == len(rows)
        key = lambda x: repr(x)
        assert sorted(
            ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key
        ) == sorted(((r.doc_id, *brute(r.text)) for r in rows), key=key)
        for r in got:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
            assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)


def test_notices(spark):
    """Whole notices, notices with words changed, put in and left out, and half of one."""
    notice = next(t for t in TEMPLATES if t.label == "gpl-3").text.split()
    other = next(t for t in TEMPLATES if t.label == "bsd").text
    put_in = [*notice[:15], "really", "quite", *notice[15:]]
    left_out = notice[:12] + notice[14:]
    rows = [
        (1, " ".join(["some", "words", *notice])),
        (2, " ".join(["a", *put_in])),
        (3, " ".join(left_out)),
        (4, " ".join(notice[:10])),
        (5, other.upper() + " and " + " ".join(notice)),
        (6, "no license here"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.labels(frame).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["gpl-3", "gpl-3", "gpl-3", "", "bsd,gpl-3", ""]
    assert got[1].score == 1 and 0.8 < got[2].score < 1.0001 and got[4].score == 0
    # Spans of the long notice; a shorter one of the same label lies half in it.
    found = licenses.spans(frame.select("doc_id", "text")).where("label = 'gpl-3' and last - first > 20")
    starts = sorted(r["first"] for r in found.collect())
    assert starts == sorted([2, 1, 0, len(words_of(other)) + 1])


def test_spans_hold_equal_words(spark):
    """Coverage counted by hand for a notice with one word replaced: k words of it fall out."""
    notice = licenses.template_words(next(t for t in TEMPLATES if t.label == "isc"))
    changed = list(notice)
    changed[9] = "other"
    frame = spark.createDataFrame([(1, " ".join(changed))], "doc_id long, text string")
    row = licenses.labels(frame).first()
    assert np.isclose(row.score, (len(notice) - 1) / len(notice)) and row.labels == "isc"


def test_empty(empty):
    assert licenses.labels(empty).count() == 0
