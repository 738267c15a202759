import pytest

from loopscope.llm import url_filter
from loopscope.llm.queries import RULES

CASES = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("https://example.net/en/x?q#f", "example.net", "/en/x", "example.net/en/", "allow"),
    ("https://w.EXAMPLE.net/en/", "w.example.net", "/en/", "example.net/en/", "allow"),
    ("https://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
    ("x://example.com/de/y", "example.com", "/de/y", "example.com/de/", "block"),
    ("x://example.com/dex", "example.com", "/dex", None, "allow"),
    ("x://a.b.org/fr/", "a.b.org", "/fr/", "org/fr/", "allow"),
    ("http://net", "net", "", None, "allow"),
    ("http://a.net?x=/", "a.net", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http:///net/", "", "/net/", None, "allow"),
    ("a://b://c.net/", "b:", "//c.net/", None, "allow"),
]


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_RULES, 0])
def test_cases(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    rules = spark.createDataFrame([*RULES, RULES[0], (None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(CASES)] + [(None, CASES[0][0], "h"), (0, CASES[0][0], "h")], "page_id long, url string, host string").drop("host")
    got = sorted((r["page_id"] is None, r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect())
    assert len(got) == len(CASES) + 2
    by = {g[1]: g[2:] for g in got if not g[0]}
    assert all(by[i] == c[1:] for i, c in enumerate(CASES))


def test_nothing(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.filter_urls(pages, rules).collect()] == [(1, "a.net", "/", None, "allow")]
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


def test_clashing_names_and_long_urls(spark):
    rules = spark.createDataFrame([*RULES, ("a.b.c.d.e", "/x/y/", "block"), ("e", "/" + "p" * 5000, "block")], "host string, path string, verdict string")
    long = "http://" + "s." * 20_000 + "a.b.c.d.e/x/y/" + "z" * 200_000
    pages = spark.createDataFrame([(1, "u1", "http://a.net/q", "v", 5, "k"), (2, "u2", long, "v", 6, "k"), (3, "u3", "http://e/" + "p" * 5001, "v", 7, "k")], "id long, host string, url string, verdict string, _row long, `_k0` string")
    got = url_filter.filter_urls(pages, rules, keep=("id", "host", "_row", "_k0", "url")).collect()
    assert got[0].__fields__ == ["id", "_row", "_k0", "url", "host", "path", "rule", "verdict"]
    by = {r["id"]: r for r in got}
    assert (by[1]["host"], by[1]["_row"], by[1]["_k0"], by[1]["rule"], by[1]["verdict"]) == ("a.net", 5, "k", "net/", "block")
    assert (by[2]["rule"], by[2]["verdict"]) == ("a.b.c.d.e/x/y/", "block") and len(by[2]["path"]) == 200_005
    assert by[3]["rule"] == "e/" + "p" * 5000


def test_many_shapes_of_rules_equal_plain(spark):
    import random

    rng = random.Random(6)
    hosts = [".".join(rng.choices(["a", "b", "c", ""], k=rng.randint(1, 5))) for _ in range(60)]
    paths = ["/" + "/".join(rng.choices(["x", "yy", "z"], k=rng.randint(0, 3))) for _ in range(60)]
    rules = list({(h, p): (h, p, rng.choice(["block", "allow"])) for h, p in zip(hosts, paths)}.values())
    urls = [(i, f"h://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '/x', '?q', '#f/'])}") for i in range(300)]
    got = url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == 300
    for r in got:
        fits = [x for x in rules if r["host"] and (r["host"] == x[0] or r["host"].endswith("." + x[0])) and r["path"].startswith(x[1])]
        best = max(fits, key=lambda x: (len(x[0] + x[1]), len(x[0]), x[2] == "block"), default=None)
        assert (r["rule"], r["verdict"]) == ((best[0] + best[1], best[2]) if best else (None, "allow"))
