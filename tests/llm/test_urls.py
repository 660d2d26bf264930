import re

import pytest

from seedlane.llm import urls as U

HARD = [
    None, "", "no scheme", "http://", "://", "http://ORG/", "http://organ/x", "http://a.org", "http://a.org/", "http://a.org?x",
    "https://www.Example.org/en/1", "https://example.org/en/12?q#f", "https://EXAMPLE.ORG/es/#x", "https://badexample.org/es/",
    "http://com/fr/", "http://x.y.com/fr/a", "http://x.com/FR/", "ftp://u@h.com:80/de/", "http://x.com/de/", "a://b://c.com/fr/",
    "http://ÉX.com/de/ü", "http://x.com\n/de/", "http://.com/de/", "http://com./de/",
]


def plain(url, rules, default):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h) or h == "") and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


@pytest.mark.parametrize("rules", [
    U.RULES, [], [("block", "", "/")],
    [("allow", "x.com", ""), ("block", "com", ""), ("allow", "y.com", "/de"), ("block", "x.com", ""), ("allow", "com", "/fr/")],
])
def test_equals_plain_python(spark, rules):
    rows = [(i, u) for i, u in enumerate(HARD)] + [(None, HARD[-6]), (3, HARD[3])]
    rows += [(100 + i, f"http://h{i % 7}.{'com' if i % 2 else 'example.org'}/{'fr' if i % 3 else 'es'}/{i}") for i in range(300)]
    rows += [(1000 + i, "http://hot.com/de/x") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS key", "'y' AS verdict", "1 AS bin")
    laws = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = sorted(map(tuple, U.judge_urls(pages.repartition(3), laws, default="allow").collect()), key=str)
    assert got == sorted([(i, *plain(u, rules, "allow")) for i, u in rows], key=str)


def test_a_hot_key_is_dealt_over_ranges(spark):
    pages = spark.range(2000).selectExpr("id AS page_id", "'http://a.com/de/' AS url")
    laws = spark.createDataFrame(U.RULES, "verdict string, host string, path string")
    judged = U.judge_urls(pages, laws)
    assert judged.filter("verdict = 'block'").count() == 2000
    sizes = [len(p) for p in judged.rdd.glom().collect()]
    assert max(sizes) < 1000


def test_empty_table(spark):
    laws = spark.createDataFrame(U.RULES, "verdict string, host string, path string")
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string"), laws).count() == 0
