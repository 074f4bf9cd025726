from pyspark.sql import functions as F
import pytest
from pyspark.sql.types import StructType

from newsloom.operators import html, rounds
from newsloom.sources import tables
from newsloom.streaming import events

SF = "/root/testdata/sf0.001"


def test_csv_with_mark_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿url,Title\nu1,"two\nlines ""q"""\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("url,Title\nu2,x\n")
    one = tables.read_csv(spark, f"{tmp_path}/a.csv")
    assert one.columns == ["url", "Title"] and one.first()["Title"] == 'two\nlines "q"'
    many = tables.read_many(spark, f"{tmp_path}/*.csv")
    assert [r.url for r in many.orderBy("file", "position").collect()] == ["u1", "u2"]
    shaped = tables.conform(one, StructType.fromDDL("url string, title string, year int"), {"title": "title"}).first()
    assert shaped.title.startswith("two") and shaped.year is None


def test_json_lines_last_wins_and_bad_lines_go(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"url": "a", "v": 1}\nbroken\n{"url": "b", "v": 2}\n{"url": "a", "v": 3}\n')
    rows = tables.read_jsonl(spark, f"{tmp_path}/x.jsonl", "url string, v int", ["url"]).collect()
    assert {(r.url, r.v) for r in rows if r.url} == {("a", 3), ("b", 2)}


def test_landed_records(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"url": "https://www.a.in/x", "title": "T", "seendate": "20240305T101500Z", "domain": "a.in"}\n')
    (tmp_path / "r.json").write_text('{"link": "https://b.in/y", "title": "T", "pubDate": "Tue, 05 Mar 2024 10:15:00 GMT", "description": "D"}\n')
    r = tables.read_landed(spark, f"{tmp_path}/r.json", "news_rss").first()
    assert (r.url, r.published_date, r.title_snippet) == ("https://b.in/y", "2024-03-05", "T D")
    r = tables.read_landed(spark, f"{tmp_path}/g.json", "gdelt").first()
    assert (r.domain, r.published_date, r.title_snippet, r.status) == ("a.in", "2024-03-05", "T", "pending")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "relevant"), ("b", "irrelevant")], "url string, final_label string")
    tables.write_by_label(df, f"{tmp_path}/p")
    assert [r.url for r in spark.read.parquet(f"{tmp_path}/p").where("final_label = 'relevant'").collect()] == ["a"]
    tables.append_jsonl(df, f"{tmp_path}/j")
    tables.append_jsonl(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    tables.write_csv(df, f"{tmp_path}/c", ["url"])
    assert tables.read_csv(spark, f"{tmp_path}/c").columns == ["url"]


def test_urls_in_text(spark):
    got = spark.range(1).select(tables.urls_in(F.lit("see https://a.b/c). and http://d.e/f?x=1, https://a.b/c")).alias("u")).first().u
    assert got == ["https://a.b/c", "http://d.e/f?x=1"]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    schema = batch.schema.simpleString().removeprefix("struct<").removesuffix(">")
    stream = events.read_folder(spark, f"{tmp_path}/in", schema.replace(":", " "), 1)
    q = events.tumbling(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select * from tumbling").collect())) == sorted(map(tuple, events.tumbling(batch, "1 hour").collect()))
    q = events.upsert_into(events.read_folder(spark, f"{tmp_path}/in", schema.replace(":", " "), 1), f"{tmp_path}/out", f"{tmp_path}/ck", ["user_id"], "event_id")
    q.awaitTermination(120)
    last = {r.user_id: r.m for r in batch.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(last) and {r.user_id: r.event_id for r in got} == last


def test_page_fields():
    page = """<html><head><title>Site</title><meta property="og:title" content="OG &amp; title"><link rel="canonical" href="https://a.in/x">
    <script type="application/ld+json">{"@type": "NewsArticle", "headline": "LD", "author": [{"name": "N"}], "datePublished": "2024-03-05T10:00:00+05:30"}</script></head>
    <body><nav>menu</nav><article><h1>Head</h1><p>one   two</p><p>three</p></article><footer>f</footer></body></html>"""
    title, _, author, _, canonical, published, body, _ = html.fields_of(page)
    assert (title, author, canonical, published) == ("OG & title", "N", "https://a.in/x", "2024-03-05T10:00:00+05:30") and body.split("\n") == ["Head", "one two", "three"]
    assert html.fields_of("<script type='application/ld+json'>{broken</script><body>x")[-2] == "x" and html.fields_of("")[-2:] == (None, None)


def test_keyword_rounds(spark):
    assert rounds.round_queries(["Oil raid", "x"], ["oil raid", "y"], 3) == ["Oil raid", "x", "y"]
    assert rounds.phrase_query(["fake milk", "urea"], "milk", 5) == "milk AND ((fake AND milk) OR (urea))"
    steps = [["a", "b"], ["a", "c"], ["a", "c"]]
    known, settled = rounds.augment(lambda k, q: spark.createDataFrame([(t, 1.0) for t in steps[k]], "term string, score double"), ["x"], rounds=3)
    assert settled and known[-1] == ["a", "c"]


def test_order_of_files_is_by_name_and_line(spark, tmp_path):
    """A short file that comes first by name, and a long one: however Spark packs them."""
    (tmp_path / "a.csv").write_text("url,n\nu,1\n")
    (tmp_path / "b.csv").write_text("url,n\n" + "".join(f"v{k},{k}\n" for k in range(5000)) + "u,2\n")
    many = tables.read_many(spark, f"{tmp_path}/*.csv")
    assert [r.url for r in many.orderBy("position").limit(3).collect()] == ["u", "v0", "v1"]
    (tmp_path / "a.jsonl").write_text("".join('{"url": "u", "v": %d}\n' % k for k in range(3000)))
    (tmp_path / "b.jsonl").write_text('{"url": "u", "v": -1}\n')
    assert tables.read_jsonl(spark, f"{tmp_path}/*.jsonl", "url string, v int", ["url"]).first().v == -1
    (tmp_path / "x.json").write_text('[{"url": "a", "text": "t"},\n {"url": "b"}]')
    assert [(r.url, r.text) for r in tables.read_json_array(spark, f"{tmp_path}/x.json", "url string, text string").collect()] == [("a", "t"), ("b", None)]
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert tables.read_texts(spark, f"{tmp_path}/t.txt").first()[0] == "one\ntwo"


def test_seeds_and_feeds(spark):
    rows = [(" https://www.a.in/x ", "T", "", 1), ("https://www.a.in/x", "later", "2024", 2), ("", "no", "", 3), ("https://b.in/y", " ", None, 4)]
    got = tables.seeds(spark.createDataFrame(rows, "url string, title_snippet string, published_date string, position int"), "seeds.csv").orderBy("url").collect()
    assert [(r.url, r.title_snippet, r.published_date, r.domain, r.query_used, r.status) for r in got] == [("https://b.in/y", "", None, "b.in", "seed", "pending"), ("https://www.a.in/x", "T", None, "a.in", "seed", "pending")]
    entries = [("https://a.in/1", "Fake oil", "seized"), ("https://a.in/2", "Turmoil", "fake"), ("", "fake oil", ""), ("https://a.in/3", None, "oil was adulterated")]
    got = tables.feed_entries(spark.createDataFrame(entries, "link string, title string, description string"), ["oil"], ["fake", "adulterated"], "f").collect()
    assert [r.url for r in got] == ["https://a.in/1", "https://a.in/3"] and got[0].query_used == "rss:f"


def test_redirects_codes_and_reader_pages(spark):
    import base64

    coded = base64.urlsafe_b64encode(b"\x08\x13\x22\x15https://a.in/b?c=1\xd2\x01\x00").decode().rstrip("=")
    urls = {f"https://news.example.com/rss/articles/{coded}?oc=5": "https://a.in/b?c=1", f"https://other.com/articles/{coded}": None, "https://news.example.com/rss/articles/AAAA": None, "https://news.example.com/x": None, "https://news.example.com/articles/A": None}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", tables.decoded_redirect(F.col("u"), "news.example.com").alias("d")).collect()
    assert {r.u: r.d for r in got} == {u: d or u for u, d in urls.items()}
    cases = [([200], True, "success", 1, None), ([500, 429, 200, 404], True, "success", 3, None), ([301], True, "failed", 1, "HTTP 301"), ([None, 404, 200], True, "failed", 2, "HTTP 404"), ([500] * 9, True, "failed", 4, "HTTP 500")]
    cases += [([429, 429, None, None], True, "failed", 4, "no response"), ([503] * 4 + [200], True, "failed", 4, "HTTP 503"), ([], True, "failed", 0, "no response"), (None, True, "failed", 0, "no response"), ([200], False, "robots_blocked", 0, None)]
    got = spark.createDataFrame([(k, c[0], c[1]) for k, c in enumerate(cases)], "k int, c array<int>, a boolean").select("k", tables.fetch_outcome(F.col("c"), F.col("a")).alias("o")).orderBy("k").collect()
    assert [tuple(r.o) for r in got] == [c[2:] for c in cases]
    page = "Title: A  title\nURL Source: x\nPublished Time: 2024-03-05\nMarkdown Content:\n# Head\n![img](a.png)\nSome [link](http://x) *text*\nAdvertisement\nSubscribe now\n\n> quoted\n[](x)\nlast"
    r = spark.range(1).select(tables.reader_article(F.lit(page)).alias("r")).first().r
    assert (r.title, r.published, r.body) == ("A  title", "2024-03-05", "Head\nSome link text\nquoted\nlast")
    assert spark.range(1).select(tables.reader_article(F.lit(None).cast("string")).alias("r")).first().r.body == ""


def test_a_writer_that_stops_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path)
    tables.replace_table(spark.range(1), path)
    steps = ["files_of", "current_version"]
    real = {s: getattr(tables, s) for s in steps}
    for stop in range(1, 12):
        calls = []

        def counted(name, calls=calls, stop=stop):
            def run(*args):
                calls.append(name)
                if len(calls) == stop:
                    raise KeyboardInterrupt
                return real[name](*args)

            return run

        for s in steps:
            monkeypatch.setattr(tables, s, counted(s))
        try:
            tables.replace_table(spark.range(1 + stop), path)
            done = True
        except KeyboardInterrupt:
            done = False
        for s in steps:
            monkeypatch.setattr(tables, s, real[s])
        n = tables.read_table(spark, path).count()
        assert n == 1 + stop if done else n in (1, 1 + stop)
        tables.replace_table(spark.range(1), path)
        if done:
            break
    assert done
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2


def test_tables_are_replaced_whole_and_cached(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    for n in (3, 1):
        old = tables.read_table(spark, path) if n == 1 else None
        tables.replace_table(spark.range(n), path)
        assert tables.read_table(spark, path).count() == n
        assert old is None or old.count() == 3
    made = []
    for _ in range(2):
        assert tables.cached(spark, f"file://{tmp_path}/cache", lambda: made.append(1) or spark.range(5)).count() == 5
    assert made == [1]


def test_leader_store_of_a_stream(spark, tmp_path):
    rows = [(k, f"https://a.in/{k % 4}" if k != 9 else None) for k in range(10)]
    for n in range(2):
        spark.createDataFrame(rows[n * 5 : n * 5 + 5], "row long, url string").coalesce(1).write.parquet(f"{tmp_path}/in{n}")
    for n in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{n}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{n}-{f.name}")
        stream = events.read_folder(spark, f"{tmp_path}/in", "row long, url string", 1)
        q = events.leader_store(stream, "url", "row").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r.row: r.leader for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {k: None if k < 4 else k % 4 for k in range(9)}


def test_article_rounds(spark):
    assert rounds.anchored(["a", "b", "c", "d"], ["x", "a", "y"], 5) == ["a", "b", "c", "x", "y"] and rounds.anchored(["a", "b", "c"], ["x"], 2) == ["a", "b", "c"]
    pool = spark.createDataFrame([("milk urea",)], "text string")
    asked = []

    def fetch(k, q):
        asked.append(q)
        return spark.createDataFrame([(f"milk urea round{k}",), ("nothing",)], "text string")

    words, kept = rounds.article_rounds(lambda p: sorted({w for r in p.collect() for w in r.text.split()}), fetch, lambda df, ws: df.where(rounds.any_part(F.col("text"), ws)), pool, "milk", 5)
    assert words == [["milk", "urea"], ["milk", "urea", "round0"], ["milk", "urea", "round0", "round1"]] and [df.count() for df in kept] == [1, 1, 1]
    assert asked[0] == "milk AND ((milk) OR (urea))"


def test_first_of_each_key_in_a_stream(spark, tmp_path):
    """Repeats within the watermark go, whichever file they come in."""
    rows = [(k, f"u{k % 3}", f"2024-01-01 00:00:0{k}") for k in range(6)]
    df = spark.createDataFrame(rows, "n long, url string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.first_seen(events.read_folder(spark, f"{tmp_path}/in", "n long, url string, ts timestamp", 1), ["url"])
    q = stream.writeStream.format("memory").queryName("first_seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.url for r in spark.sql("select url from first_seen").collect()) == ["u0", "u1", "u2"] == sorted(r.url for r in events.first_seen(df, ["url"]).collect())


def test_three_ways_to_the_text(spark):
    """Pages that only one of the three ways can read, one that none can, and one where each is right in its turn."""
    say = lambda n, w: " ".join(f"{w}{k}" for k in range(n))
    menu = "<nav><ul>" + "".join(f"<li><a href=/{k}>section {k} of the paper</a></li>" for k in range(20)) + "</ul></nav>"
    pages = {
        # Blocks of a form in plain containers: no paragraphs, and the tags of the third way leave forms out.
        "density": (f"<body>{menu}<form><div>{say(25, 'a')}</div><div>short note on it</div><div>{say(20, 'b')}</div></form>", f"{say(25, 'a')}\nshort note on it\n{say(20, 'b')}"),
        # Paragraphs of a few words each, again where the third way does not look.
        "paragraphs": (f"<body>{menu}<form><div><p>{say(9, 'a')}<p>{say(9, 'b')}<p>{say(9, 'c')}<p>{say(9, 'd')}</div><div><p>{say(6, 'x')}</div></form>", "\n".join(say(9, w) for w in "abcd")),
        # Lines without paragraphs, in an element that says what it is.
        "tags": (f"<body>{menu}<article>" + "".join(f"<li>{say(5, w)}</li>" for w in "abcde") + "</article>", "\n".join(say(5, w) for w in "abcde")),
        None: (f"<body>{menu}<div>{say(8, 'a')}</div>", None),
    }
    for method, (page, text) in pages.items():
        found = html.fields_of(page)
        assert found[-1] == method
        assert method is None or found[-2] == text
    status = {"density": "success", "paragraphs": "success", "tags": "partial", None: "failed"}
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(pages.values())] + [(9, None)], "k int, html string")
    assert {r.k: r.extraction_status for r in html.extract(df).collect()} == dict(enumerate(status[m] for m in pages)) | {9: "failed"}


def test_configuration_with_an_environment(spark, tmp_path):
    import json

    from newsloom.sources import config

    (tmp_path / "c.json").write_text(json.dumps({"api_keys": {"a": "file", "b": "file"}, "discovery": {"x": {"n": 1}}}))
    names, enables = {"KEY_A": "api_keys.a", "KEY_C": "api_keys.c", "KEY_D": "api_keys.d"}, {"discovery.x.enabled": ["api_keys.a", "api_keys.c"], "discovery.y.enabled": ["api_keys.d"], "discovery.z.enabled": ["api_keys.b"]}
    got = config.load(spark, f"file://{tmp_path}/c.json", {"KEY_A": "own", "KEY_C": "c", "KEY_D": ""}, names, enables)
    assert got == {"api_keys": {"a": "own", "b": "file", "c": "c"}, "discovery": {"x": {"n": 1, "enabled": True}, "z": {"enabled": True}}}
    assert config.at(got, "discovery.x.n") == 1 and config.at(got, "discovery.x.n.m", "none") == "none"


def test_many_files_and_landed_records(spark, tmp_path):
    for name, text in (("b.csv", "\ufeffid,t\n3,\"x\ny\"\n4,z\n"), ("a.csv", "id,t\n1,p\n2,q\n")):
        (tmp_path / name).write_text(text)
    rows = tables.read_many(spark, f"file://{tmp_path}/*.csv").orderBy("position").collect()
    assert [(r.id, r.t) for r in rows] == [("1", "p"), ("2", "q"), ("3", "x\ny"), ("4", "z")]
    assert [r.file.rsplit("/", 1)[-1] for r in rows] == ["a.csv", "a.csv", "b.csv", "b.csv"]
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert tables.read_texts(spark, f"file://{tmp_path}/t.txt").first()[0] == "one\ntwo"
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [r.a for r in tables.read_json_array(spark, f"file://{tmp_path}/a.json", "a int").orderBy("a").collect()] == [1, 2]
