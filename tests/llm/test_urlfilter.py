"""URL rules against a plain Python version; cascades are exact over their universe."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import urlfilter
from tessera.llm.queries import URL_RULES

URLS = [None, "", "example.com/en/x", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x", "http://example.com",
        "http://example.com/", "http://example.com?x=/en/", "http://a.b.example.com/en/1#t", "http://badexample.com/en/",
        "https://www.example.com/en/", "https://x.www.example.com/en/y", "http://example.com/en", "ftp://net/es/",
        "http://n.net/fr/q", "http://n.net/de/q", "http://internet/fr/", "x://y://com/en/", "http://com/", "http://com",
        "http://example.org/en/", "http://.com/a", "http://com./a", "a\nb://m.com/\n", "http://É.com/É", "://com/",
        "http://example.com:80/en/", "http://" + "a." * 5000 + "com/" + "en/" * 9000]


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        end = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
        path = rest[:end]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[4] if best else default)


def judged(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = urlfilter.judge(df, rules)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    return {r["page_id"]: tuple(r)[1:] for r in got.collect()}


def test_rules_of_the_contract(spark):
    assert judged(spark, URLS, URL_RULES) == {i: brute(u, URL_RULES) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rules(spark, seed):
    rng = random.Random(seed)
    labels = ["a", "bb", "c", "dd"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 3)))
    path = lambda: "/" + "".join(rng.choice(["x/", "y", "zz/"]) for _ in range(rng.randint(0, 3)))
    rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(25)]
    rules = list({(h + p): (v, h, p) for v, h, p in rules}.values())
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(200)]
    assert judged(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(3)
    universe = [f"host{i}.com/" for i in range(4000)]
    listed = rng.sample(universe, 300) + ["elsewhere.org/"]
    u = spark.createDataFrame([(k,) for k in universe], "key string")
    levels = urlfilter.build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), u)
    assert len(levels) > 1
    got = {r["key"] for r in u.where(urlfilter.is_listed(F.col("key"), levels)).collect()}
    assert got == set(listed) & set(universe)


def test_no_rules_empty_table_nulls(spark):
    df = spark.createDataFrame([(None, "http://a.com/"), (1, None), (1, None)], "page_id long, url string")
    assert {tuple(r) for r in urlfilter.judge(df, []).collect()} == {(None, "a.com", "/", None, "allow"), (1, "", "", None, "allow")}
    got = urlfilter.judge(df, URL_RULES, default="block").collect()
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in got} == {(None, "com/", "allow"), (1, None, "block")}
    assert len(got) == 3
    assert urlfilter.judge(df.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge(df, [("deny", "a", "/")])


def test_no_join_or_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = urlfilter.judge(df, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
