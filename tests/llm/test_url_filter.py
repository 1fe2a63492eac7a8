import pytest
from pyspark.sql import functions as F

from helpers import duck_rows, spark_rows
from quarry.llm.url_filter import OP6_SQL, RULES, filter_urls, op6_url_filter, rule_table

URLS = [
    "HTTP://A.Example.COM/en/x?y#z", "https://example.com/en", "https://example.com/EN/", "x://www.example.com/en/1", "x://wwwexample.com/", "x://com/", "x://com", "x://b.net/es/", "x://b.net?/es/",
    "://net/fr/", "no scheme", "", None, "a://b://c.com/", "x://ünï.com/ü/", "x://" + "a." * 5000 + "com/", "x://a.net/fr/" + "p" * 100_000, "x://user@b.com:80/", "x://b.com:80/", "x://h.com\n/a\nb?c", "x://.com/",
]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[2:] if fit else (None, default))


@pytest.mark.parametrize("broadcast", [100, 0])
def test_odd_urls(spark, broadcast):
    rules = [*RULES, ("block", "b.com:80", ""), ("allow", "c.com", "/"), ("block", "com", "/a"), ("allow", "com", "/a"), ("block", "", "")]
    pages = spark.createDataFrame([(i, u, "h", "v", 1) for i, u in enumerate(URLS + URLS[:3])], "page_id int, url string, host string, verdict string, rule int")
    got = sorted(map(tuple, filter_urls(pages, rule_table(spark, rules), broadcast_rules=broadcast).collect()))
    merged = [r for r in rules if r != ("allow", "com", "/a")]
    assert got == [(i, *brute(u, merged)) for i, u in enumerate(URLS + URLS[:3])]


def test_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "x://a.com/")], "page_id int, url string")
    none = rule_table(spark, RULES).where("false")
    assert [tuple(r) for r in filter_urls(pages, none, default="block").collect()] == [(1, "a.com", "/", None, "block")]
    assert filter_urls(pages.limit(0), rule_table(spark, RULES)).count() == 0
    nulls = rule_table(spark, RULES).withColumn("host", F.lit(None).cast("string"))
    assert filter_urls(pages, nulls).first().rule is None


def test_no_python_in_the_plan(spark, small):
    plan = op6_url_filter(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_a_popular_url_is_no_key(spark):
    """Half of the pages have one url, a quarter none: nothing is dealt by url."""
    urls = ["x://a.example.com/en/1"] * 200 + [None] * 100 + [f"x://h{i}.net/es/{i}" for i in range(100)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    out = filter_urls(pages, rule_table(spark, RULES))
    assert sorted(map(tuple, out.collect())) == [(i, *brute(u, RULES)) for i, u in enumerate(urls)]
    plan = out._jdf.queryExecution().toString()
    assert "hashpartitioning(row_no" in plan and "hashpartitioning(host" not in plan and "hashpartitioning(path" not in plan


def test_whole_table(spark, small):
    assert spark_rows(op6_url_filter(spark, small)) == duck_rows(OP6_SQL, small)
