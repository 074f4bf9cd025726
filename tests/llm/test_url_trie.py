import random
import time

from pyspark.sql import functions as F

from newsloom.llm import url_trie
from newsloom.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([k for k in map(rest.find, "?#") if k >= 0], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_trie_and_join_agree_with_every_rule_tried(spark):
    rng = random.Random(3)
    hosts, paths = ["org", "example.org", "a.example.org", "com", "x.com", "xcom", "EXAMPLE.org", "", "org:80", "b..com"], ["", "/", "/es", "/es/", "/en/1", "/en/123/x", "/en//", "/fr/a", "/de/", "//"]
    urls = [f"{s}{h}{p}{t}" for s in ("http://", "x://", "://", "mailto:", "") for h in hosts for p in paths for t in ("", "?a=/b", "#c://d/e", "\n/x")] + [None]
    rules = URL_RULES + [("block", "a.example.org", ""), ("allow", "x.com", "//"), ("allow", "com", "/de/"), ("allow", "b..com", "/e")]
    rules += list({(h, p): ("block", h, p) for h, p in ((rng.choice(hosts[:5]), rng.choice(paths) + rng.choice("abc")) for _ in range(8))}.values())
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    want = [(k, *brute(u, rules)) for k, u in enumerate(urls)]
    assert sorted(map(tuple, url_trie.judge(pages, rules).collect())) == sorted(want)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert sorted(map(tuple, url_trie.judge(pages, table, max_rules=3).collect())) == sorted(want)
    assert url_trie.judge(pages.limit(0), rules).count() == 0
    assert url_trie.judge(pages.union(pages).where("page_id = 3"), rules).count() == 2


def test_very_long_urls(spark):
    urls = ["http://a.example.org/" + "x/" * 3000, "http://" + "a." * 2000 + "example.org/es/" + "y" * 50_000, "http://example.org" + "/" * 2000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [(k, *brute(u, URL_RULES)) for k, u in enumerate(urls)]
    table = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    assert sorted(map(tuple, url_trie.judge(pages, URL_RULES).collect())) == want
    short = pages.where("page_id <> 1")
    assert sorted(map(tuple, url_trie.judge(short, table, max_rules=3).collect())) == [want[0], want[2]]


def test_a_very_long_segment_takes_linear_time():
    trie = url_trie.Trie([*URL_RULES, ("block", "org", "/" + "y" * 30), ("allow", "org", "/" + "y" * 31 + "z")])
    path = "/" + "y" * 3_000_000
    start = time.process_time()
    assert trie.find("a.org", path) == ("block", "org/" + "y" * 30)
    assert trie.find("example.org", "/es/" + path) == ("block", "example.org/es/")
    assert time.process_time() - start < 1
