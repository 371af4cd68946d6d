"""URL rules against a plain search over all rules."""

import random

from zeitton.llm.url_filter import judge_urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    cut_path = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:cut_path]


def verdict(url, rules):
    host, path = parts(url)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]), len(r[1]), r[2] == "block"), default=None)
    return (host, path, best and best[0] + best[1], best[2] if best else "allow")


def check(spark, urls, rules):
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "1 as host", "'x' as part")
    found = judge_urls(rows.repartition(3), spark.createDataFrame(rules, "host string, path string, verdict string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert got == {i: verdict(u, rules) for i, u in enumerate(urls)}


def test_random_rules_and_urls(spark):
    draw = random.Random(9)
    labels = ["com", "net", "a", "b", "a-b", "ab", "x1"]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randint(1, 4)))
    path = lambda: "/" + "/".join(draw.choice(["en", "e", "", "es"]) for _ in range(draw.randint(0, 3)))
    rules = [(host(), path(), draw.choice(["allow", "block"])) for _ in range(60)]
    urls = [draw.choice(["http://", "HTTPS://"]) + host().title() + path() + draw.choice(["", "?q=1", "#t"]) for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "http://com", "http://com?x=/en", "x://a://b/c", "http://" + "a" * 20_000 + ".com/en"]
    check(spark, urls + ["http://hot.com/en/"] * 300, rules)


def test_no_rules_no_urls_and_repeated_rules(spark):
    check(spark, ["http://a.com/", None], [("b", "/", "block")])
    check(spark, ["http://a.com/x"], [("com", "/", "allow"), ("com", "/", "block"), ("com", "/", "block")])
    empty = spark.createDataFrame([], "page_id bigint, url string")
    rules = spark.createDataFrame([(None, "/", "block")], "host string, path string, verdict string")
    assert judge_urls(empty, rules).collect() == []
