import itertools
import random
import re

from haulmark.llm import url_rules
from haulmark.llm.queries import QUERIES, URL_RULES


def brute(url, rules):
    match = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in match[2]) if match else ""
    path = match[3] if match else ""
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def judged(spark, urls, rules):
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    out = url_rules.judge(frame, url_rules.rule_table(rules, spark)).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(urls[r["page_id"]], rules)


def test_odd_urls(spark):
    hosts = ["Example.COM", "www.example.com", "a.www.example.com", "xexample.com", "com", ".com",
             "example.com.", "é.net", "com:80", "user@x.net", ""]
    paths = ["", "/", "/en", "/en/", "/EN/x", "/en/x/y?q=/es/", "/es/#/fr/", "//en/", "/es//fr/"]
    urls = [f"https://{h}{p}" for h, p in itertools.product(hosts, paths)]
    urls += [None, "", "no scheme", "://", "a://b://c/d", "x\n://example.com/en/",
             "http://" + "a." * 3000 + "com/" + "d/" * 3000]
    judged(spark, urls, URL_RULES)


def test_random_rules(spark):
    rnd = random.Random(4)
    part = lambda: rnd.choice(["a", "b", "c", "en", "e"])
    host = lambda: ".".join(part() for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join("/" + part() for _ in range(rnd.randint(0, 3))) + rnd.choice(["", "/"])
    rules = sorted({(rnd.choice(["allow", "block"]), host(), path()) for _ in range(60)})
    judged(spark, [f"http://{host()}{path()}" for _ in range(400)], rules)


def test_query(spark, small):
    pages = {r["page_id"]: r["url"]
             for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = QUERIES["op9_url_rules"](spark, small).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        assert tuple(r)[1:] == brute(pages[r["page_id"]], URL_RULES)


def test_repeated_rows_clashing_names_and_empty_tables(spark):
    frame = spark.createDataFrame(
        [(1, "http://a.com/", "x", "y")] * 3, "page_id bigint, url string, path string, short string")
    rows = url_rules.judge(frame, url_rules.rule_table(URL_RULES, spark)).collect()
    assert [(r["path"], r["rule"]) for r in rows] == [("/", "com/")] * 3
    assert url_rules.judge(frame.limit(0), url_rules.rule_table(URL_RULES, spark)).count() == 0
    none = url_rules.judge(frame, url_rules.rule_table([], spark), default="block").collect()
    assert {r["verdict"] for r in none} == {"block"}
