import random
from pathlib import Path

import corpus_pipeline
import pytest
import tables
from compare import connect, difference

from convolytics.llm import jaccard, leaks, pieces, queries, quality, secrets
from convolytics.llm.common import components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql_twins(spark, name):
    assert difference(spark, connect(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name]) == ""


def test_entry_lists_all():
    import __spark_entry__ as entry

    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 11))
    assert "pipeline" in entry.queries() and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_stages_and_run(spark, tmp_path):
    """Each stage does to its own input what plain Python says; run() is their sequence."""
    sf = str(tmp_path)
    for f in Path(SF).iterdir():
        if f.stem != "documents":
            (tmp_path / f.name).symlink_to(f)
    docs = queries.table(spark, SF, "documents")
    shown = docs.where("n_chars between 800 and 2000").orderBy("doc_id").limit(4)
    planted = shown.selectExpr(
        "doc_id + 100000 as doc_id", "concat(reverse(text), ' token=abcdefgh.') as text",
        "lang", "source", "n_chars + 16 as n_chars",
    )
    docs.unionByName(planted).write.parquet(f"{sf}/documents.parquet")
    docs = queries.table(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    labels = queries.table(spark, sf, "labels")
    verdict = {r.doc_id: r.predicted for r in quality.scores(docs, labels).collect()}

    one = stages[0](spark, docs, sf)
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns and kept == {d for d in rows if verdict[d] == 1}

    two = stages[1](spark, one, sf)
    from test_jaccard import brute

    ids = {r.doc_id for r in two.collect()}
    assert two.columns == docs.columns
    assert ids == set(brute([rows[d] for d in kept], 5, 80).values())

    three = stages[2](spark, two, sf)
    items = [" ".join(r.text.lower().split()) for r in queries.table(spark, sf, "benchmark").collect()]
    bad = {d for d in ids if any(t in " ".join(rows[d].text.lower().split()) for t in items)}
    left = {r.doc_id for r in three.collect()}
    assert three.columns == docs.columns and bad and not left & bad and len(left) >= len(ids - bad) - 1

    four = stages[3](spark, three, sf)
    clean = {r.doc_id: r for r in four.collect()}
    assert four.columns == docs.columns and set(clean) == left
    hit = 0
    for d, r in clean.items():
        from test_secrets import base

        if base(rows[d].text)[:3] == [0, 0, 0] and "[secret]" not in r.text:
            assert r.text == rows[d].text
        hit += base(rows[d].text)[:3] != [0, 0, 0]
        assert base(r.text)[:3] == [0, 0, 0] and r.n_chars == len(r.text)
    assert hit

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    want = {r.doc_id: r for r in stages[4](spark, four, sf).collect()}
    assert got == want and set(got) == left


def test_stages_on_hostile_rows(spark, tmp_path):
    """Nulls, repeated rows and clashing names pass through all stages; an empty table too."""
    rng = random.Random(4)
    docs = tables.documents(spark, ["token=abcdefgh " + tables.text_of(rng, 30)])
    for frame in (docs, tables.nothing(spark)):
        out = frame
        for _, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, out, SF)
        assert (out.count() > 10) == (frame is docs)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    pairs += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(40)]
    pairs += [(500, 500), (None, 3), (7, None), (1, 0), (0, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_modules_are_their_own():
    """Nothing outside the subpackage and the pipeline needs it."""
    assert all(m.__name__.startswith("convolytics.llm") for m in (jaccard, leaks, pieces, secrets))
