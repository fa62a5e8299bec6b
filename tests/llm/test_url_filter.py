import random

import pytest

from cadenza.llm import url_filter

SF = "/root/testdata/sf0.001"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def brute(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), p, h, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    *_, p, h, v = max(fits)
    return host, path, h + p, v


def run(spark, rows, rules):
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    found = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    return sorted(((r.row.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect()), key=str)


def test_whole_table(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = url_filter.query(spark, SF).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u, url_filter.RULES) for i, u in urls.items()}


@pytest.mark.parametrize("seed", range(3))
def test_nested_rules_and_hot_hosts(spark, seed):
    rng = random.Random(seed)
    names = ["com", "a.com", "b.a.com", "ab.com", "a-b.com", "a.com.au", "x.b.a.com", "net", "", "com.", "-.com"]
    paths = ["/", "/a", "/a/", "/a/b/", "", "/ab", "/é/"]
    rules = list({(rng.choice(names), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(25)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    hosts = [*names, "WWW.A.com", "c.b.a.com", "a.com:80", "acom", "0.com"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'b', 'b/c', '?q=/a', '#://x/'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "a://b://c/d", "HTTP://X\n.com/a\nb", *["http://b.a.com/a/b/"] * 300]
    rows = [(i % 500, u, "clash", 1) for i, u in enumerate(urls)]
    assert run(spark, rows, rules) == sorted(((i, *brute(u, rules)) for i, u, *_ in rows), key=str)


def test_rule_tables_with_nulls_repeats_and_nothing(spark):
    rows = [(1, "http://a.com/x", None, None), (2, None, None, None)]
    assert run(spark, rows, [("a.com", "/", "allow"), ("a.com", "/", "block"), (None, "/", "block"), ("a.com", None, "allow"), ("a.com", "/x", None)])[0][-1] == "block"
    assert run(spark, rows, []) == [(1, "a.com", "/x", None, "allow"), (2, "", "", None, "allow")]
    assert run(spark, [], [("a.com", "/", "allow")]) == []
