import re

from pyspark.sql import functions as F

from convolytics.llm import urls

URLS = [
    None, "", "example.org/es/", "http://", "http://example.org", "HTTP://Example.ORG/es/a?b#c",
    "http://a.example.org/es/", "http://aexample.org/es/", "https://example.org/en/1",
    "https://example.org/en/123?x", "https://example.org/en/", "https://x.com/fr/1", "ftp://com/de/",
    "http://x.com/de/?", "http://x.com?/fr/", "http://x.com#/de/", "http://a.spam-farm.example.net/",
    "http://spam-farm.example.net", "http://notspam-farm.example.net/", "http://ÄB.org/É",
    "http://u:p@x.com:80/fr/", "a://b://c.org/de", "http://..org/", "http://x.net/\n/es/",
]


def judged(url, rules, blocked):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    inside = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if inside(h) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[2:]
    return host, path, None, "block" if any(map(inside, blocked)) else "allow"


def frame(spark, values):
    rows = [(i % 7 or None, u, "h", "k") for i, u in enumerate(values)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, key string")


def test_verdicts(spark):
    values = [*URLS, *URLS[3:6]]
    got = urls.filter_urls(frame(spark, values)).collect()
    want = [(i % 7 or None, *judged(u, urls.RULES, urls.BLOCKED_HOSTS)) for i, u in enumerate(values)]
    order = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_cascade_is_exact(spark):
    """Many keys that the first level lets through wrongly: later levels put them right."""
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("cast(substr(key, 2) as int) % 40 = 0")
    cascade = urls.Cascade(keys, listed)
    assert len(cascade.levels) > 2
    wrong = keys.where(cascade.listed(F.col("key")) != (F.expr("cast(substr(key, 2) as int) % 40") == 0))
    assert wrong.count() == 0


def test_plan_is_native(spark):
    plan = urls.filter_urls(frame(spark, URLS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Join", plan)


def test_without_lists_or_rows(spark):
    rows = urls.filter_urls(frame(spark, URLS), rules=(), blocked_hosts=()).collect()
    assert len(rows) == len(URLS) and {(r.rule, r.verdict) for r in rows} == {(None, "allow")}
    assert urls.filter_urls(frame(spark, URLS).limit(0)).count() == 0
