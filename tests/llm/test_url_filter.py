import random
import re

from rowlens.llm import url_filter
from rowlens.llm.queries import URL_RULES


def plain_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fitting = [
        (len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if not fitting:
        return host, path, None, "allow"
    best = max(fitting)
    return host, path, best[3], best[4]


def test_urls_against_brute_force(spark):
    pick = random.Random(5)
    urls = [
        None, "", "no scheme", "http://", "http://example.com", "http://example.com/", "http://EXAMPLE.com/en/x",
        "http://www.example.com/en/?q=1", "https://a.b.www.example.com/en/1#x", "http://notexample.com/en/",
        "http://com/", "http://x.net/es/", "http://x.net/es", "http://x.net/fr/a?b", "x://y://z.com/", "http://.com/",
        "http://ÉX.com/", "http://a.com:80/", "http://a.com?x/", "http://a\nb.com/\n", "http://" + "a." * 300 + "com/en/",
    ]
    for _ in range(200):
        host = ".".join(pick.choice(["www", "example", "com", "net", "x"]) for _ in range(pick.randrange(1, 5)))
        urls.append(f"http://{host}{pick.choice(['', '/', '/en', '/en/', '/en/a', '/es/', '/fr/b', '/e'])}{pick.choice(['', '?', '#/en/'])}")
    pages = spark.createDataFrame(
        [(k, u, "own") for k, u in enumerate(urls + urls[:20])], "page_id long, url string, verdict string"
    )
    for rules in (URL_RULES, URL_RULES + [("com", "/en", "block"), ("x.com", "", "block"), ("com", "/x", "allow")]):
        table = spark.createDataFrame(rules + rules[:1] + [(None, "/", "block")], "host string, path string, verdict string")
        found = url_filter.judge_urls(pages, table).collect()
        assert len(found) == len(urls) + 20
        for r in found:
            assert (r.host, r.path, r.rule, r.verdict) == plain_judge(r.url, rules), r.url


def test_no_rules_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    (row,) = url_filter.judge_urls(pages, none).collect()
    assert (row.host, row.path, row.rule, row.verdict) == ("a.com", "/", None, "allow")
    rules = spark.createDataFrame(URL_RULES, none.schema)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_short_prefixes_are_confirmed(spark, monkeypatch):
    """With one digit most expressions meet some rule; the full digest sorts them out."""
    monkeypatch.setattr(url_filter, "PREFIX_DIGITS", 1)
    urls = [f"http://h{k}.example.com/en/{k}" for k in range(50)] + [f"http://h{k}.org/" for k in range(50)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    for r in url_filter.judge_urls(pages, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain_judge(r.url, URL_RULES)
