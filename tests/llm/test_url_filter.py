import random

import pytest

from draftloom.llm import url_filter


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: next((k for k, c in enumerate(rest) if c in "?#"), len(rest))]
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [
    "http://x.net/a", "http://net/", "http://net", "HTTP://A.EXAMPLE.NET/en/1?q=1#f", "http://example.net/english", "http://example.net/en", "https://b.example.com/de/",
    "http://example.com/de", "x://org/fr/1", "http://org/", "http://notnet/", "no scheme", "", None, "://net/", "a://b://net/", "http://u@x.net:80/p", "http://.net/", "http://a..net/x",
    "http://net?x", "http://net/\n/en/", "http://ÀÉ.net/É", "http://example.net//en/", "mailto:x@net",
]


@pytest.mark.parametrize("most", [100, 0])
def test_matches_brute_force(spark, most):
    rnd = random.Random(1)
    rules = [*url_filter.QUERY_RULES, ("com", "", "block"), ("a.com", "/p", "allow"), ("a.com", "/pq/", "block"), ("b.a.com", "/", "allow"), ("a.com", "/p", "block")]
    urls = URLS + [f"http://{'.'.join(rnd.choice(['a', 'b', 'com', 'net']) for _ in range(rnd.randint(1, 4)))}/{rnd.choice(['p', 'pq', 'pq/x', '', 'p/q'])}" for _ in range(200)]
    df = spark.createDataFrame([(k, u, "mine", "old") for k, u in enumerate(urls + urls[:3])], "page_id long, url string, rule string, judged string")
    rows = url_filter.filter_urls(df, rules, max_broadcast_rules=most).collect()
    assert len(rows) == len(urls) + 3
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules), r
        assert r.judged == "old"


def test_empty_table_default_and_bad_rule(spark):
    df = spark.createDataFrame([], "url string")
    assert url_filter.filter_urls(df, url_filter.QUERY_RULES).count() == 0
    one = spark.createDataFrame([("http://q.q/",)], "url string")
    assert url_filter.filter_urls(one, [], default="block").first().verdict == "block"
    with pytest.raises(ValueError):
        url_filter.filter_urls(one, [("", "/", "block")])
