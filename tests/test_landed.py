"""Pages of responses, read in full and resumed."""

import json
from urllib.parse import quote

import pytest

from newsloom.sources import landed


def land(folder, token, body):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{quote(token, safe='')}.json").write_text(json.dumps(body))


def stories(page, n):
    return [{"url": f"https://a.in/{page}/{k}", "title": f"t{page} {k}", "publish_date": "2024-03-05", "media_name": "A", "extra": {"x": 1}} for k in range(n)]


def test_pages_are_followed_by_their_tokens(spark, tmp_path):
    q = tmp_path / "in" / "oil fraud"
    land(q, "first", {"stories": stories(0, 3), "pagination_token": "a/b=="})
    land(q, "a/b==", {"stories": stories(1, 2), "pagination_token": "c"})
    land(q, "c", {"stories": [*stories(2, 1), None, "x"], "pagination_token": None})
    land(q, "never named", {"stories": stories(9, 5)})
    land(tmp_path / "in" / "loop", "first", {"stories": stories(7, 1), "pagination_token": "first"})
    land(tmp_path / "in" / "none", "first", {"error": "x"})
    path = f"file://{tmp_path}/in"
    got = sorted((r.query, r.page, r.place, r.url) for r in landed.read_pages(spark, path, "mediacloud").collect())
    want = [("loop", 0, 0, "https://a.in/7/0")] + [("oil fraud", p, k, f"https://a.in/{p}/{k}") for p, n in ((0, 3), (1, 2), (2, 1)) for k in range(n)]
    assert got == want
    assert landed.read_pages(spark, path, "mediacloud", cap=4).where("query = 'oil fraud'").count() == 4
    rows = {r.url: r for r in landed.discovered(landed.read_pages(spark, path, "mediacloud"), "mediacloud").collect()}
    one = rows["https://a.in/1/1"]
    assert (one.query_used, one.title_snippet, one.source, one.domain, one.published_date, one.status) == ("oil fraud", "t1 1", "A", "a.in", "2024-03-05", "pending")
    assert landed.read_pages(spark, f"file://{tmp_path}/nowhere", "mediacloud").count() == 0


@pytest.mark.parametrize(("connector", "body", "url", "said", "day"), [
    ("gdelt", {"articles": [{"url": "https://x.in/a", "title": "A", "seendate": "20240305T101500Z", "domain": "x.in"}]}, "https://x.in/a", "A", "2024-03-05"),
    ("ddgs", [{"href": "https://x.in/a", "title": "A", "body": "b"}], "https://x.in/a", "A b", None),
    ("cse", {"items": [{"link": "https://x.in/a", "title": "A", "snippet": "s"}], "queries": {"nextPage": [{"startIndex": 11}]}}, "https://x.in/a", "A s", None),
    ("bing", {"value": [{"url": "https://x.in/a", "name": "A", "description": "d", "datePublished": "2024-03-05T10:15:00.0000000Z"}]}, "https://x.in/a", "A d", "2024-03-05"),
    ("serpapi", {"news_results": [{"link": "https://x.in/a", "title": "A", "snippet": "s"}]}, "https://x.in/a", "A s", None),
])
def test_connectors(spark, tmp_path, connector, body, url, said, day):
    land(tmp_path / "in" / "q", "first", body)
    if connector == "cse":
        land(tmp_path / "in" / "q", "11", {"items": [{"link": url, "title": "again"}, {"link": "https://x.in/b", "title": "B"}]})
    got = {r.url: r for r in landed.discovered(landed.read_pages(spark, f"file://{tmp_path}/in", connector), connector).collect()}
    assert (got[url].title_snippet, got[url].published_date) == (said, day)
    assert len(got) == (2 if connector == "cse" else 1)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(landed.Landed)
    q, seen = tmp_path / "in" / "q", []

    def run():
        rows = spark.readStream.format("landed").options(path=f"file://{tmp_path}/in", connector="mediacloud").load()
        query = rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return sorted((r.query, r.page, r.place) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    land(q, "first", {"stories": stories(0, 2), "pagination_token": "a"})
    assert run() == [("q", 0, 0), ("q", 0, 1)]
    land(q, "a", {"stories": stories(1, 1), "pagination_token": "b"})
    land(tmp_path / "in" / "other", "first", {"stories": stories(5, 1)})
    assert run() == [("other", 0, 0), ("q", 0, 0), ("q", 0, 1), ("q", 1, 0)]
    land(q, "b", {"stories": stories(2, 1)})
    assert run() == run() == [("other", 0, 0), ("q", 0, 0), ("q", 0, 1), ("q", 1, 0), ("q", 2, 0)]
