import gzip
import hashlib
import json
from pathlib import Path

import pytest

from convolytics.llm import warc

BIG = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 80
ROWS = [
    (1, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (9, None, BIG), (9, None, BIG), (None, "u", BIG),
    (3, "http://c/", "short"), (4, "http://c/", "short"), (5, "http://d/", None), (6, "", ""),
    (7, "x", "y" * 200_000), (8, "x", "z" * 999), (10, "x", "z" * 999), (11, "é", "q" * 1000),
    (12, "é", "q" * 1000),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*r, "v", 1) for r in ROWS]
    return spark.createDataFrame(
        rows, "page_id long, url string, html string, value string, size int"
    ).repartition(3)


def expected():
    for page, _, html in ROWS:
        data = (html or "").encode()
        same = [p for p, _, h in ROWS if h == html and p is not None]
        keeper = max(same) if len(data) >= 1000 and same else None
        revisit = keeper is not None and page != keeper
        digest = hashlib.sha1(data).hexdigest()
        kind = "revisit" if revisit else "response"
        yield page or -1, len(data), digest, kind, keeper if revisit else None


def test_round_trip(pages):
    got = [(r.page_id or -1, *tuple(r)[1:5]) for r in warc.round_trip(pages).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected()))


def test_files(spark, pages, tmp_path):
    once, members = str(tmp_path / "once"), str(tmp_path / "members")
    warc.write_archives(pages, once, per_file=2)
    streams = list(Path(once).glob("part-*"))
    assert len(streams) >= len(ROWS) // 2
    for f in streams:  # one stream from end to end
        assert len(list(warc.parse_records(warc.inflated(f.read_bytes())))) <= 2
    warc.normalise(spark, once, members)
    seen = 0
    for f in Path(members, "kind=index").glob("part-*"):
        part = f.name.split("-")[1]
        (archive,) = Path(members, "kind=warc").glob(f"part-{part}-*")
        data = archive.read_bytes()
        whole = gzip.decompress(data)
        for line in gzip.decompress(f.read_bytes()).splitlines():
            entry = json.loads(line)
            record = gzip.decompress(data[entry["offset"] :][: entry["length"]])
            assert record in whole and entry["id"].encode() in record
            seen += 1
    assert seen == len(ROWS)


def test_streams_in_small_steps():
    record = b"WARC/1.1\r\nContent-Length: 5\r\nA: b\r\n\r\nhello\r\n\r\n"
    for size in (1, 3, 7, 1000):
        data = record * 3
        chunks = [data[i : i + size] for i in range(0, len(data), size)]
        assert [x[1] for x in warc.parse_records(chunks)] == [b"hello"] * 3
        packed = gzip.compress(record) + warc.EMPTY + gzip.compress(record * 2)
        assert b"".join(warc.inflated(packed, size)) == data
    for bad in (record[:-1], record[:20], b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_records([bad]))


def test_empty(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0
