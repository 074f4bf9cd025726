import html
import random
import re
from html.parser import HTMLParser

from newsloom.llm import wrappers as w

SF = "/root/testdata/sf0.01"


def plain(page: str) -> str:
    """The article of this fixture's pages, by string operations alone."""
    inner = page.split("<article>", 1)[1].split("</article>", 1)[0]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    return "\n".join(b for b in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in blocks) if b)


def test_fixture_pages_by_hand(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: (r.url, plain(r.html)) for r in pages.collect()}
    for limit in (w.BROADCAST_BYTES, 0):
        got = w.extract(pages, limit).collect()
        assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def extracted(page: str) -> str:
    nested = w.tree(page)
    return w.read(nested, w.wrapper_of(nested))


def test_parts_that_are_not_the_article():
    page = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><header>H</header><nav>N</nav>
    <div class="cookie-notice">C</div><article><header>by</header><h1>A &amp;&nbsp;B</h1><p>one <b>tw</b>o&#33; 3 &lt; 4 <p>second<br>line<aside>side</aside>
    <ul><li>x<li>y</ul><form>F<input></form><style>p{}</style><!-- c --><table><tr><td>1<td>2<tr><td>3</table><section id="comments"><article><p>reader</p></article></section>
    <pre>a
      b</pre></article><div class="sidebar">S</div><footer>&copy;</footer></body>"""
    assert extracted(page) == "A & B\none two! 3 < 4\nsecond line\nx\ny\n1\n2\n3\na b"
    assert extracted("") == "" == extracted("<nav>x</nav>") and extracted("just text") == "just text"
    assert extracted("<div>a<div class='ad'>b</div>c</div>") == "a\nc"
    assert extracted("<article>a <unclosed b </article>") != "" and extracted("<article>" * 3000 + "deep") == "deep"
    assert extracted("<main><p>m</p></main><div>n</div>") == "m" and extracted("<p>a<![CDATA[b<c]]></p>") == "ab<c"


def test_wrappers_are_inferred_with_optional_and_repeated_parts():
    a = w.wrapper_of(w.tree("<body><div><a>m</a></div><article><h1>x</h1><p>a</p><table><tr><td>1<td>2</table></article></body>"))
    b = w.wrapper_of(w.tree("<body><section>n</section><div><a>m</a></div><article><h1>x</h1><p>a<b>c</b></p></article></body>"))
    one = w.expression(w.absorb(a, b))
    assert one == "<body>(<section>(.*)</section>)?<div>(.*)</div><article>(.*)(<table>(<td>(.*)</td>)+</table>)?</article></body>"
    assert w.expression(w.unpacked(w.packed(a))) == one
    cards = [w.wrapper_of(w.tree("<body>" + "<div><h2>c</h2><p>t</p></div>" * n + "<div><a>f</a></div></body>")) for n in (2, 5)]
    assert w.expression(w.absorb(*cards)).count("+") == 1


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def unmarked(rng: random.Random, k: int) -> tuple[str, str]:
    """A page of divs without classes, and its text: a menu, now and then a banner, the text, links to others that
    differ from page to page, and a note that does not."""
    menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "Sport", "Weather"))
    blocks = [prose(rng, 4), *(prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 6)))]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{x}</p>" for x in blocks[1:])
    if k % 4 == 1:
        more = [prose(rng, 5), prose(rng, 6), prose(rng, 30)]
        body += f"<ul><li>{more[0]}</li><li>{more[1]}</li></ul><div><p>{more[2]}</p></div>"
        blocks += more
    banner = f"<div><p>{prose(rng, 6)}</p></div>" if k % 3 == 0 else ""
    links = f"<div><a href=/x>{prose(rng, 3)}</a><a href=/y>{prose(rng, 4)}</a></div>"
    page = f"<html><body><div><ul>{menu}</ul></div>{banner}<div><div>{body}</div>{links}</div><div><p>All rights reserved by the paper</p><p>Imprint and contact</p></div></body></html>"
    return page, "\n".join(blocks)


def test_only_the_wrapper_tells_menu_from_text(spark, monkeypatch):
    rng = random.Random(1)
    made = {k: unmarked(rng, k) for k in range(120)}
    pages = spark.createDataFrame([(k, f"https://Site{k % 2}.example/{k}", page) for k, (page, _) in made.items()], "page_id long, url string, html string").repartition(7)
    want = {k: text for k, (_, text) in made.items()}
    assert {r.page_id: r.text for r in w.extract(pages).collect()} == want
    # Without wrappers no page's text is found.
    assert not [k for k, (page, text) in made.items() if w.read(w.tree(page), w.Part("", "")) == text]
    # Folded two tasks at a time, so in levels.
    known = w.infer(pages.selectExpr("lower(split_part(split_part(url, '://', 2), '/', 1)) host", "html"), fan_in=2).collect()
    assert sorted(r.host for r in known) == ["site0.example", "site1.example"]
    for r in known:
        wrapper = w.unpacked(r.wrapper)
        assert wrapper.pages == 60 and all(w.read(w.tree(made[k][0]), wrapper) == want[k] for k in made if f"site{k % 2}.example" == r.host)


def test_what_stands_on_every_page_is_no_article_where_nothing_is_marked():
    """Also right beside the text, in no container of its own."""
    rng = random.Random(3)
    made = [[prose(rng, 30), prose(rng, 40)] for _ in range(5)]
    pages = [f"<body><p>Join our newsletter</p><p>{a}</p><p>{b}</p><p>All rights reserved</p></body>" for a, b in made]
    wrapper = w.wrapper_of(w.tree(pages[0]))
    for page in pages[1:]:
        w.absorb(wrapper, w.wrapper_of(w.tree(page)))
    assert [w.read(w.tree(p), wrapper) for p in pages] == ["\n".join(x) for x in made]
    # Within a marked article nothing is dropped for that.
    pages = [f"<body><article><p>Our correspondent</p><p>{a}</p></article><p>x</p></body>" for a, _ in made]
    wrapper = w.wrapper_of(w.tree(pages[0]))
    for page in pages[1:]:
        w.absorb(wrapper, w.wrapper_of(w.tree(page)))
    assert [w.read(w.tree(p), wrapper) for p in pages] == [f"Our correspondent\n{a}" for a, _ in made]


def test_class_words_do_not_drop_the_article():
    same = {
        '<article class="post has-sidebar"><p>x': "x", '<article class="post comments-open"><p>x': "x", '<div id="content" class="with-sidebar"><p>x</p></div>': "x",
        '<article><div class="article-header"><h1>T</h1></div><p>b</p></article>': "T\nb", '<article>cost <span class="share-price">5</span> <label>now</label></article>': "cost 5 now",
        '<div class="sidebar"><p>all there is</p></div>': "all there is", '<article><p>text that is long enough</p><div class="ad">buy</div><ul class="share-links"><li>s</ul></article>': "text that is long enough",
    }
    assert {p: extracted(p) for p in same} == same


def test_nesting_may_be_deep():
    for n in (130, 20_000):
        assert extracted("<div>" * n + "<nav>menu</nav><p>text</p>") == "text"
    assert len(extracted("".join(f"<div><p>w{k}</p></div>" for k in range(5000))).split("\n")) == 5000
    assert extracted("<table>" + "<tr><td>x" * 5000 + "</table>") == "\n".join("x" * 5000)


def test_edges(spark):
    rows = [(1, None, "<p>a</p>"), (None, "http://h/x", "<article>b"), (3, "http://h/y", None), (3, "http://h/y", None), (4, "://", ""), (5, "http://h/z", "<article><p>" + "word " * 100_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    got = sorted(((r.page_id or 0, r.text[:9], r.n_chars) for r in w.extract(pages).collect()))
    assert got == [(0, "b", 1), (1, "a", 1), (3, "", 0), (3, "", 0), (4, "", 0), (5, "word word", 499_999)]
    assert w.extract(pages.limit(0)).count() == 0


def test_attributes_are_read_one_by_one():
    """Names within values, behind dashes and in other names are no attributes; quotes may be of any kind or none."""
    same = {
        '<article style="visibility: hidden; x"><p>x</p></article>': "x", '<article><p>one</p><div style="overflow:hidden"><p>two</p></div></article>': "one\ntwo", '<p style="overflow:hidden">x</p>': "x",
        '<p data-role="navigation">x</p>': "x", '<div data-hidden="false"><p>x</p></div>': "x", '<div data-class="sidebar"><p>x</p></div><p>y</p>': "x\ny", "<p title='role=\"navigation\" hidden'>x</p>": "x",
        "<p title=hidden>x</p>": "x", '<p title = "a hidden b">x</p>': "x", "<p data-x=1 hidden>gone</p><p>x</p>": "x", "<p HIDDEN=''>gone</p><p>x</p>": "x", "<div/hidden><p>gone</p></div><p>x</p>": "x",
        "<div role = 'navigation'><p>gone</p></div><p>x</p>": "x", "<div ROLE=Navigation><p>gone</p></div><p>x</p>": "x", '<p aria-hidden="false">x</p>': "x", '<p aria-hidden = true>gone</p><p>x</p>': "x",
        '<p class="a" class="hidden" role>x</p>': "x", '<p role="main" role="navigation">x</p>': "x", '<a href="/?role=navigation&hidden">x</a>': "x", "<p =hidden>x</p>": "x",
    }
    assert {p: extracted(p) for p in same} == same


class Oracle(HTMLParser):
    """The blocks of <article> with <p> and <h1> in it, by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.on, self.lines, self.line = 0, [], ""
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.on += tag == "article"
        self.line += " " if tag == "br" else ""
        if tag in ("p", "h1"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        self.on -= tag == "article"

    def flush(self):
        if " ".join(self.line.split()):
            self.lines.append(" ".join(self.line.split()))
        self.line = ""

    def handle_data(self, data):
        self.line += data if self.on else ""


def test_marked_pages_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("html like '%<article>%'")
    want = {r.page_id: "\n".join(Oracle(r.html).lines) for r in pages.collect()}
    assert len(want) > 2000
    assert {r.page_id: r.text for r in w.extract(pages).collect()} == want


def test_a_sidebar_among_many_parts_of_its_name():
    """More than GROUP parts become one of each name; what every page has there still goes, what one page has stays."""
    rng = random.Random(9)
    for n in (10, 49, 51, 120):
        made = [[prose(rng, 25) for _ in range(n)] for _ in range(5)]
        pages = ["<body>" + "".join(f"<div><p>{t}</p></div>" + ("<div><p>Read this too</p><ul><li>One more</ul></div>" if k == n // 2 else "") for k, t in enumerate(texts)) + "</body>" for texts in made]
        wrapper = w.wrapper_of(w.tree(pages[0]))
        for page in pages[1:]:
            w.absorb(wrapper, w.wrapper_of(w.tree(page)))
        assert [w.read(w.tree(p), wrapper) for p in pages] == ["\n".join(t) for t in made]
