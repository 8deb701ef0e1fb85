import hashlib
import re
import time

import tables

from convolytics.llm import secrets

KINDS = [
    (
        "assign",
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.I | re.A,
        ),
        2,
        6,
    ),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]
MORE = [
    "token=a secret=token:abcdefgh öpassword = 'x1234567' AKIA" + "Z" * 16 + " AKIAAKIA0q",
    "ü token: abcdef12 " * 700,
    "0123456789abcdef" * 5 + "g" + "f" * 23,
    "APIKEY:abcdefgh,secret==abcdefg password=secret=hellothere \U0001f600 api_key='12345678'",
    "pa\u017fsword=abcdefgh to\u212aen=abcdefgh",
    "ghp_" + "a" * 36 + " x https://u:p@h/ eyJhbGciOiJI.eyJhbGciOiJI.abcdefgh12 é token=\n",
    "-----BEGIN RSA PRIVATE KEY----- xoxb-1234567890ab AIza" + "b" * 35,
]


def base(text):
    found, counts = [], []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        hits = [m for m in pattern.finditer(text) if len(m.group(group)) >= least]
        counts.append(len(hits))
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in hits]
    return [*counts, hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()]


def test_digests(spark):
    docs = tables.documents(spark, MORE)
    rows = docs.collect()
    got = secrets.digests(docs).collect()
    want = sorted([r.doc_id or -1, *base(r.text or "")] for r in rows)
    assert sorted([r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256] for r in got) == want
    kinds = {s.split(":")[0] for r in got for s in r.spans.split(",") if s}
    assert kinds == {r.kind for r in secrets.RULES}
    for r in got:
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


def test_long_runs(spark):
    """A million letters without a break, alone and before what rules look for, take seconds."""
    runs = ["a" * 1_000_000, "eyJ" * 300_000 + ".", "x" * 500_000 + "://", "ghp_" * 200_000, "xoxb-" * 3]
    texts = [f"{r} {end}" for r in runs for end in ("", "https://u:p@h", "token=abcdefgh")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    begin = time.monotonic()
    got = {r.doc_id: r for r in secrets.digests(docs).collect()}
    assert time.monotonic() - begin < 60
    for i, text in enumerate(texts):
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256] == base(text)
        assert ("login_url" in got[i].spans) == text.endswith("@h")


def test_ledger(spark):
    """Only unseen pairs of blob and rule version are scanned; every path gets its findings."""
    first = spark.createDataFrame(
        [("a", 1, "token=abcdefgh"), ("b", 1, "token=abcdefgh"), ("c", 1, None)],
        "path string, version int, text string",
    )
    then = spark.createDataFrame(
        [("a", 2, "nothing"), ("d", 1, "token=abcdefgh"), ("d", 1, "token=abcdefgh"), (None, 1, "")],
        "path string, version int, text string",
    )
    found, ledger = secrets.scan(first, paths=["path", "version"])
    assert ledger.count() == 2 and found.count() == 3
    found, grown = secrets.scan(then, ledger, paths=["path", "version"])
    assert grown.count() == 3  # only "nothing" was new
    rows = {(r.path, r.version): len(r.spans) for r in found.collect()}
    assert rows == {("a", 2): 0, ("d", 1): 1, (None, 1): 0} and found.count() == 4
    _, again = secrets.scan(then, grown, rule_version="next", paths=["path"])
    assert again.count() == 6
    seen = secrets.scanned(then, grown)
    assert seen.count() == 0


def test_redaction(spark, docs):
    rows = tables.documents(spark, MORE)
    out = secrets.without_secrets(rows)
    assert out.columns == rows.columns and out.count() == rows.count()
    texts = {r.doc_id: r for r in out.collect()}
    for r in rows.collect():
        new = texts[r.doc_id]
        if r.text in MORE:
            assert "[secret]" in new.text or r.text == MORE[4]
            assert base(new.text)[:3] == [0, 0, 0]
            assert new.n_chars == len(new.text)
        else:
            assert new.text == r.text and new.n_chars == r.n_chars and new.blob == r.blob
    assert texts[next(r.doc_id for r in rows.collect() if r.text == MORE[1])].text == "ü [secret] " * 700


def test_plan_is_native(docs):
    plan = secrets.digests(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty(empty):
    assert secrets.digests(empty).count() == 0
    assert secrets.without_secrets(empty).count() == 0
