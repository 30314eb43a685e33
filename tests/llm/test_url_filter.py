"""The cascade against a plain walk over the rules."""

import random

import numpy as np
import pytest

from rankloom.llm import url_filter
from rankloom.llm.queries import URL_RULES
from rankloom.llm.text import prepare_python


def expected(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [
        (len(h + p), v == "allow", h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, True, None, "allow"))
    return host, path, best[2], best[3]


@pytest.fixture(scope="module")
def urls(spark):
    chance = random.Random(5)
    hosts = ["net", "example.net", "EN.example.Net", "blog.example.com", "org", "a.b.org", "xnet", "net:80", "..net", "\u00e9.org"]
    rest = ["", "/", "/en/", "/en/x?y#z", "/de/", "/DE/", "/fr/1", "?q=/en/", "#/de/", "/en", "//"]
    rows = [(i, f"http://{chance.choice(hosts)}{chance.choice(rest)}") for i in range(300)]
    rows += [(1, None), (2, ""), (3, "no scheme/net/"), (4, "://net/"), (5, "http://a://net/"), (1, None)]
    return rows, spark.createDataFrame(rows, "page_id long, url string")


@pytest.mark.parametrize("block_bits", [1 << 28, 128])
def test_matches_rules(spark, urls, block_bits):
    rows, frame = urls
    rules = [*URL_RULES, ("a.b.org", "/fr/", "block"), ("example.net", "/en/", "block"), ("", "", "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.judge_urls(frame, table, block_bits=block_bits).collect()
    assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got])) == sorted(
        map(str, [(i, *expected(url, rules)) for i, url in rows])
    )


def test_without_rules_and_without_pages(spark, urls):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = url_filter.judge_urls(urls[1], none).collect()
    assert {(r.rule, r.verdict) for r in got} == {(None, "allow")} and len(got) == len(urls[0])
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(urls[1].limit(0), rules).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    prepare_python(spark)
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    listed = spark.range(300).selectExpr("concat('k', id * 61) AS key")
    levels = url_filter.build_cascade(listed, universe)
    assert len(levels) > 1
    hashed = url_filter._hashed(universe).toPandas()
    found = url_filter.in_cascade(hashed.h1.to_numpy(), hashed.h2.to_numpy(), levels)
    assert set(hashed.key[found]) == {f"k{i * 61}" for i in range(300)}
    assert sum(level[2] for level in levels) < 300 * 24
    assert not np.array_equal(levels[0][3], levels[1][3])
