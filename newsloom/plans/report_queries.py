"""Queries over filters, orders, reports, keyword rules and landed records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import merge, relevance, rounds, windows
from newsloom.plans.catalogue import query
from newsloom.plans.text_queries import BLANK, PAD, SITE, TITLE, many, site, some, title, word
from newsloom.sources import tables as sources
from newsloom.sources.tables import table

# ---- Sources and filters


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' AND user_id = 7 ORDER BY ts, event_id LIMIT 30")
def scan_equal(spark, sf_dir):
    """SRC-01: rows with given values, ordered before they are cut."""
    return sources.scan(table(spark, sf_dir, "events"), {"event_type": "error", "user_id": 7}, ["ts", "event_id"], 30).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE nullif(event_type, 'view') <> 'error' UNION ALL SELECT -event_id FROM events WHERE nullif(event_type, 'view') IS NULL AND value > 50")
def null_filters(spark, sf_dir):
    """FLT-01: a comparison drops nulls, IS NULL finds them."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.nullif("event_type", F.lit("view")).alias("label"))
    return e.where("label <> 'error'").select("event_id").unionByName(e.where("label is null and value > 50").select((-F.col("event_id")).alias("event_id")))


SEEDS = "u AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN ' ' || regexp_replace(url, '[?#].*$', '') || ' ' ELSE regexp_replace(url, '[?#].*$', '') END AS url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"


@query(f"WITH {SEEDS}, f AS (SELECT trim(url) AS url, min_by(title, page_id) AS t FROM u WHERE trim(url) <> '' GROUP BY 1) SELECT url, 'seed' AS discovery_method, coalesce(nullif(trim(t), ''), '') AS title_snippet, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS domain, 'seeds.csv' AS source FROM f")
def seed_records(spark, sf_dir):
    """SRC-09: seed rows as discovered records, the first of each URL, blank cells by default."""
    p = table(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", "[?#].*$", "")
    rows = p.select(F.col("page_id").alias("position"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit(" "), bare, F.lit(" "))).otherwise(bare).alias("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title_snippet"))
    return sources.seeds(rows, "seeds.csv").select("url", "discovery_method", "title_snippet", "domain", "source")


FEED = ["the", "of", "der", "la"], ["and", "with", "und", "les"]


@query(f"WITH l AS (SELECT doc_id, source, lower({TITLE} || ' ' || coalesce(text, '')) AS t FROM documents) SELECT doc_id FROM l WHERE {some('t', FEED[0])} AND {some('t', FEED[1])}")
def feed_filter(spark, sf_dir):
    """SRC-14: entries whose title and summary have a product and a signal; documents stand for entries."""
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("link"), title().alias("title"), F.col("text").alias("description"))
    return sources.feed_entries(entries, *FEED, "feed").select(F.col("url").cast("long").alias("doc_id"))


@query("SELECT page_id, regexp_extract(url, '^(https?://[^ ]+)', 1) AS decoded FROM pages")
def redirects(spark, sf_dir):
    """SRC-15: URLs behind a redirect's base64 segment; each page's URL is put into one first."""
    coded = F.translate(F.base64(F.concat(F.unhex(F.lit("08132215")), F.encode("url", "UTF-8"), F.unhex(F.lit("D20100")))), "+/=\r\n", "-_")
    u = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://news.example.com/rss/articles/"), coded, F.lit("?oc=5")).alias("u"))
    return u.select("page_id", sources.decoded_redirect(F.col("u"), "news.example.com").alias("decoded"))


@query("""WITH c AS (SELECT event_id, event_id % 11 <> 3 AS allowed, [CASE (event_id + 3 * k) % 9 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 WHEN 3 THEN 451 WHEN 4 THEN 429 WHEN 5 THEN 500 WHEN 6 THEN 403 WHEN 7 THEN 503 END FOR k IN range(event_id % 7)] AS l FROM events),
t AS (SELECT allowed, l[1 : 4] AS l, list_position([x IN (200, 301, 302, 303, 307, 308, 403, 404, 410, 451) FOR x IN l[1 : 4]], true) AS p FROM c),
u AS (SELECT allowed, CASE WHEN allowed THEN coalesce(nullif(p, 0), len(l)) ELSE 0 END AS attempts, l FROM t),
s AS (SELECT CASE WHEN NOT allowed THEN 'robots_blocked' WHEN attempts > 0 AND l[attempts] = 200 THEN 'success' ELSE 'failed' END AS status, attempts::INT AS attempts, CASE WHEN attempts > 0 THEN l[attempts] END AS code FROM u)
SELECT status, attempts, CASE WHEN status = 'failed' THEN coalesce('HTTP ' || code, 'no response') END AS error, count(*) AS n FROM s GROUP BY ALL""")
def fetch_outcomes(spark, sf_dir):
    """SRC-19: what becomes of pages over the response codes of their attempts."""
    codes = F.array(*map(F.lit, (200, 301, 404, 451, 429, 500, 403, 503, None)))
    tried = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.get(codes, ((F.col("event_id") + 3 * k) % 9).cast("int")))
    e = table(spark, sf_dir, "events").select(F.slice(tried, 1, (F.col("event_id") % 7).cast("int")).alias("codes"), (F.col("event_id") % 11 != 3).alias("allowed"))
    return e.select(sources.fetch_outcome(F.col("codes"), F.col("allowed")).alias("o")).groupBy("o.status", "o.attempts", "o.error").agg(F.count("*").alias("n"))


@query()
def reader_pages(spark, sf_dir):
    """SRC-20: articles of a reader's markdown; documents stand for its body. Tested on pages by hand."""
    page = F.concat(F.lit("Title: "), title(), F.lit("\nMarkdown Content:\n![x](a.png)\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", sources.reader_article(page).alias("r")).select("doc_id", F.length("r.title").alias("n_title"), F.md5("r.body").alias("body"))


EXCLUDED = ["that", "oil", "été"]


@query(f"SELECT doc_id FROM documents WHERE NOT {some(f'lower({TITLE} || chr(32) || {SITE})', EXCLUDED)}")
def hard_exclusion(spark, sf_dir):
    """FLT-04: rows without an excluded term in title and URL."""
    return table(spark, sf_dir, "documents").where(~relevance.hard_excluded(EXCLUDED, title(), site())).select("doc_id")


@query(f"WITH t AS (SELECT doc_id, lower({TITLE}) AS t FROM documents) SELECT doc_id FROM t WHERE {some('t', ['the', 'of'])} AND {some('t', ['and', 'in'])} AND NOT {some('t', ['that'])}")
def risky_titles(spark, sf_dir):
    """FLT-08: a product and a risk, and nothing that excludes."""
    return table(spark, sf_dir, "documents").where(relevance.title_high_risk(title(), ["the", "of"], ["and", "in"], ["that"])).select("doc_id")


@query(f"WITH d AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS dup FROM documents) SELECT doc_id FROM d JOIN labels USING (doc_id) WHERE trim(text, {BLANK}) <> '' AND NOT dup AND quality = 1")
def keyword_sources(spark, sf_dir):
    """FLT-09: texts that keywords are taken from: not empty, no duplicates, relevant ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The first row of each text is looked up by its doc_id, so a text that most rows have is no hot key.
    first = d.groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id").join(first, "doc_id", "left")
    return relevance.keyword_source(rows, "text", F.col("first").isNull(), F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant")).select("doc_id")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN quality IN (0, 1) WHEN 1 THEN toxic = 1 ELSE false END AS marked FROM labels")
def reviewed_rows(spark, sf_dir):
    """FLT-10: rows that a reviewer has marked, under any of the columns that may say so."""
    k = F.col("doc_id") % 3
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(k == 0, F.concat(F.lit(" "), F.col("quality").cast("string"))).alias("final_keep"), F.when((k == 1) & (F.col("toxic") == 1), "Relevant ").when(k == 2, "maybe").alias("human_label"))
    return rows.select("doc_id", relevance.human_marked(rows).alias("marked"))


# ---- Projections and joins


@query("SELECT doc_id, 3 AS round, 'round_03' AS package, CASE WHEN n_chars > 500 THEN 'own' ELSE 'default' END AS origin FROM documents")
def round_columns(spark, sf_dir):
    """PRJ-01, PRJ-02: constant columns of a round; a value that a row has itself wins."""
    own = F.when(F.col("n_chars") > 500, "own")
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(3).alias("round"), F.concat(F.lit("round_"), F.lpad(F.lit("3"), 2, "0")).alias("package"), F.coalesce(own, F.lit("default")).alias("origin"))


ASKED = """CASE p_partkey % 6 WHEN 0 THEN 'article_title:' || p_name WHEN 1 THEN '"' || p_name || ' seized"~10' WHEN 2 THEN p_name || ' AND fake' WHEN 3 THEN p_name || ' AND raid*' WHEN 4 THEN 'mustard oil ' || p_name ELSE 'spurious AND fssai ' || p_name END"""


def asked() -> Column:
    name, k = F.col("p_name"), F.col("p_partkey") % 6
    cases = [F.concat(F.lit("article_title:"), name), F.concat(F.lit('"'), name, F.lit(' seized"~10')), F.concat(name, F.lit(" AND fake")), F.concat(name, F.lit(" AND raid*")), F.concat(F.lit("mustard oil "), name)]
    out = F.concat(F.lit("spurious AND fssai "), name)
    for n, c in enumerate(cases):
        out = F.when(k == n, c).otherwise(out)
    return out


FRAUD, ENFORCEMENT = ["spurious", "fake"], ["fssai", "raid*"]


@query(f"""WITH q AS (SELECT p_partkey, lower({ASKED}) AS q, CASE WHEN p_partkey % 7 = 0 THEN 'mediacloud_phrase' ELSE 'feed' END AS m FROM part)
SELECT p_partkey, CASE WHEN m = 'mediacloud_phrase' THEN 'phrase' WHEN contains(q, 'article_title:') THEN 'title_only' WHEN contains(q, '~') THEN 'proximity' ELSE 'boolean' END AS family,
 CASE WHEN contains(q, 'article_title:') AND contains(q, 'fssai') THEN 'title_oils_enforcement' WHEN contains(q, 'article_title:') AND contains(q, 'mustard oil') THEN 'title_named_oils_fraud' WHEN contains(q, 'article_title:') THEN 'title_core_oils_fraud'
  WHEN contains(q, '~') THEN 'proximity_' || regexp_replace(trim(split_part(q, '"', 2)), '\\s+', '_', 'g') WHEN (contains(q, 'fssai') OR contains(q, 'raid*')) AND NOT (contains(q, 'spurious') OR contains(q, 'fake')) THEN 'boolean_oils_enforcement_only'
  WHEN contains(q, 'fssai') OR contains(q, 'raid*') THEN 'boolean_oils_enforcement_evidence' WHEN contains(q, 'mustard oil') THEN 'boolean_named_oils_fraud' ELSE 'boolean_core_oils_fraud' END AS query_id FROM q""")
def query_names(spark, sf_dir):
    """PRJ-06: the family and the name of a query, from its method and its syntax."""
    method = F.when(F.col("p_partkey") % 7 == 0, "mediacloud_phrase").otherwise("feed")
    return table(spark, sf_dir, "part").select("p_partkey", relevance.query_family(method, asked()).alias("family"), relevance.query_id(asked(), FRAUD, ENFORCEMENT, "fssai", "mustard oil").alias("query_id"))


@query("""WITH o AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE '' END AS keep FROM documents WHERE n_chars % 3 = 0),
j AS (SELECT l.doc_id, CASE WHEN o.doc_id IS NOT NULL THEN o.keep ELSE l.quality::VARCHAR END AS k, o.doc_id IS NOT NULL AS hit FROM labels l LEFT JOIN o USING (doc_id))
SELECT doc_id, k AS final_keep, CASE k WHEN '1' THEN 'relevant' WHEN '0' THEN 'irrelevant' ELSE '' END AS final_label, CASE WHEN k IN ('0', '1') THEN 'human_reviewed' ELSE 'needs_review' END AS review_status, CASE WHEN hit AND k <> '' THEN 'labels; second' ELSE 'labels' END AS source FROM j""")
def label_overlay(spark, sf_dir):
    """JN-10: a second review's label wins where it has the row, an empty one too."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    override = d.where("n_chars % 3 = 0").select(F.col("doc_id").cast("string").alias("key"), F.when(k == 0, "1").when(k == 1, "0").otherwise("").alias("keep"), F.col("doc_id").alias("position"))
    base = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("quality").cast("string").alias("keep"), F.lit("labels").alias("source"))
    return merge.overlay_labels(base, override, "key", "keep", "source", "second").select("doc_id", "final_keep", "final_label", "review_status", "source")


@query("SELECT l.doc_id, coalesce(d.lang, 'none') AS lang, coalesce(d.n_chars, 0) AS n_chars FROM labels l LEFT JOIN (SELECT doc_id, lang, n_chars FROM documents WHERE source <> 'src1') d USING (doc_id)")
def attached_fields(spark, sf_dir):
    """JN-11: fields of another table where it has them."""
    other = table(spark, sf_dir, "documents").where("source <> 'src1'").select("doc_id", "lang", "n_chars")
    return merge.attach(table(spark, sf_dir, "labels").select("doc_id", F.lit("none").alias("lang"), F.lit(0).cast("long").alias("n_chars")), other, "doc_id", ["lang", "n_chars"])


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def strict_names(spark, sf_dir):
    """JN-12: a look-up in which no key may lack its row."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return merge.strict_look_up(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey").select("o_orderkey", "c_name")


@query("SELECT o_custkey AS k, min(o_orderstatus) AS label FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def resolved_conflicts(spark, sf_dir):
    """DD-14: conflicting labels with the decision that was made; no decision is none of the labels."""
    votes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("s"))
    _, conflicts = merge.merge_labels(votes, "k", "label", "s")
    decisions = votes.groupBy("k").agg(F.min("label").alias("label"))
    return merge.resolve(conflicts, decisions, "k", "label").select("k", "label")


HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"


@query(f"WITH p AS (SELECT page_id, {HOST} AS host, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t FROM pages), seen AS (SELECT host AS k FROM p WHERE page_id % 4 = 0 UNION SELECT t FROM p WHERE page_id % 4 = 1) SELECT page_id, host IN (SELECT k FROM seen WHERE k <> '') OR t IN (SELECT k FROM seen WHERE k <> '') AS seen FROM p")
def seen_rows(spark, sf_dir):
    """JN-05, JN-06, SET-04: keys of several tables in any form, and the rows one of whose keys is among them."""
    p = table(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url")).alias("host"), F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("t"))
    none = F.lit(None).cast("string")
    known = merge.seen_keys([p.where("page_id % 4 = 0").select("host", none.alias("t")), p.where("page_id % 4 = 1").select(none.alias("host"), "t")], [F.col("host"), F.col("t")])
    fresh, old = merge.split_seen(p, known, "page_id", [F.col("host"), F.col("t")])
    return fresh.select("page_id", F.lit(False).alias("seen")).unionByName(old.select("page_id", F.lit(True).alias("seen")))


# ---- Reports


def section(name: str, df: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """A report's section: (section, key, n), the most frequent first."""
    counts = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))
    counts = counts.orderBy(F.desc("n"), "key").limit(most) if most else counts
    return counts.select(F.lit(name).alias("section"), "key", "n")


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query(f"""SELECT * FROM (SELECT 'discovery' AS section, event_type AS key, count(*) AS n FROM events GROUP BY ALL) UNION ALL SELECT * FROM (SELECT 'labels', coalesce(quality::VARCHAR, 'unknown'), count(*) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)
UNION ALL SELECT 'duplicates', 'removed', count(*) - count(DISTINCT text) FROM documents UNION ALL SELECT * FROM (SELECT 'sources', source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, source LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'terms', t, count(*) AS n FROM (SELECT unnest(list_filter(['that', 'with', 'en', 'de'], lambda x: contains({PAD.format('text')}, ' ' || x || ' '))) AS t FROM documents) GROUP BY ALL ORDER BY n DESC, t LIMIT 10)""")
def run_report(spark, sf_dir):
    """AGG-05: the sections of a run's report: statuses, labels, duplicates, sources and terms."""
    d = table(spark, sf_dir, "documents")
    terms = d.select(F.explode(T.padded_terms(F.col("text"), ["that", "with", "en", "de"])).alias("t"))
    removed = d.agg((F.count("*") - F.countDistinct(F.sha2("text", 256))).alias("n")).select(F.lit("duplicates").alias("section"), F.lit("removed").alias("key"), "n")
    labels = d.select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return stacked([section("discovery", table(spark, sf_dir, "events"), "event_type"), section("labels", labels, "quality"), removed, section("sources", d, "source", 15), section("terms", terms, "t", 10)])


OILS = ["that", "with", "which", "absent"]


@query(f"""WITH k AS (SELECT d.* FROM documents d JOIN labels USING (doc_id) WHERE quality = 1), p AS (SELECT {HOST} AS domain FROM pages), t AS (SELECT list_filter(['that', 'with', 'from', 'which'], lambda x: contains({PAD.format('text')}, ' ' || x || ' ')) AS ts FROM k)
SELECT 'language' AS section, lang AS key, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT * FROM (SELECT 'domains', domain, count(*) AS n FROM p GROUP BY ALL ORDER BY n DESC, domain LIMIT 15)
UNION ALL SELECT 'years', left(ts::VARCHAR, 4), count(*) FROM events GROUP BY ALL UNION ALL SELECT 'kinds', x, count(*) FROM (SELECT unnest(ts) AS x FROM t) WHERE x IN ('that', 'with', 'which', 'absent') GROUP BY ALL""")
def corpus_stats(spark, sf_dir):
    """AGG-06: relevant documents by language, pages by domain, years, and which of a fixed list each document has."""
    kept = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    found = kept.select(F.explode(T.padded_terms(F.col("text"), ["that", "with", "from", "which"])).alias("x")).where(F.col("x").isin(OILS))
    years = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy").alias("y")).where("length(y) >= 4")
    pages = table(spark, sf_dir, "pages").select(T.domain(F.col("url")).alias("domain"))
    return stacked([section("language", kept, "lang"), section("domains", pages, "domain", 15), section("years", years, "y"), section("kinds", found, "x")])


@query("SELECT term, count(*) FILTER (contains(lower(text), term)) AS n FROM documents, (SELECT unnest(['th', 'edible', 'en', 'Été']) AS raw, lower(unnest(['th', 'edible', 'en', 'Été'])) AS term) GROUP BY term")
def substring_counts(spark, sf_dir):
    """AGG-07: documents that hold a string anywhere, inside words, too."""
    low = F.lower(F.coalesce("text", F.lit("")))
    terms = ["th", "edible", "en", "Été"]
    one = table(spark, sf_dir, "documents").agg(*(F.count_if(F.contains(low, F.lit(t.lower()))).alias(t.lower()) for t in terms))
    return one.unpivot([], [t.lower() for t in terms], "term", "n")


@query("""WITH a AS (SELECT d.doc_id, d.lang, d.source, n_chars, CASE quality WHEN 1 THEN 'relevant' WHEN 0 THEN 'irrelevant' ELSE 'pending' END AS human, nullif(lang, 'en') AS food, CASE WHEN n_chars > 2000 THEN 'x' END AS issue, CASE WHEN n_chars % 2 = 0 THEN n_chars / 10.0 END AS score FROM documents d LEFT JOIN labels USING (doc_id))
SELECT count(*) AS total, count(*) FILTER (human <> 'pending') AS reviewed, count(*) FILTER (human = 'relevant') AS relevant, count(*) FILTER (human = 'irrelevant') AS irrelevant, count(*) FILTER (human = 'pending') AS pending, count(DISTINCT food) AS categories, count(score) AS scored,
 count(*) FILTER (food IS NOT NULL OR issue IS NOT NULL) AS complete, round(count(*) FILTER (food IS NOT NULL OR issue IS NOT NULL) / count(*), 6) AS coverage, round(count(source) / count(*), 6) AS located FROM a""")
def dashboard(spark, sf_dir):
    """AGG-09: the ten numbers of a dashboard, in one aggregation."""
    a = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n, food, issue = F.col("n_chars"), F.nullif("lang", F.lit("en")), F.when(F.col("n_chars") > 2000, "x")
    human = F.when(F.col("quality") == 1, "relevant").when(F.col("quality") == 0, "irrelevant").otherwise("pending")
    done = food.isNotNull() | issue.isNotNull()
    ratio = lambda c: F.round(F.coalesce(F.try_divide(c, F.count("*")), F.lit(0.0)), 6)
    return a.agg(
        F.count("*").alias("total"), F.count_if(human != "pending").alias("reviewed"), *(F.count_if(human == k).alias(k) for k in ("relevant", "irrelevant", "pending")), F.countDistinct(food).alias("categories"),
        F.count(F.when(n % 2 == 0, n / 10)).alias("scored"), F.count_if(done).alias("complete"), ratio(F.count_if(done)).alias("coverage"), ratio(F.count("source")).alias("located"),
    )


@query("WITH b AS (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0) SELECT event_type, count(*) AS raw, count(DISTINCT e.user_id) AS saved, count(*) - count(DISTINCT e.user_id) AS duplicates, count(DISTINCT CASE WHEN b.user_id IS NOT NULL THEN e.user_id END) AS baseline, count(DISTINCT CASE WHEN b.user_id IS NULL THEN e.user_id END) AS novel FROM events e LEFT JOIN b USING (user_id) GROUP BY 1")
def query_counters(spark, sf_dir):
    """AGG-16: records, kept ones, duplicates, and which a baseline has, by query; event types stand for queries."""
    e = table(spark, sf_dir, "events")
    once = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    met = once.join(e.where("event_id % 2 = 0").select("user_id").distinct().withColumn("known", F.lit(True)), "user_id", "left")
    return met.groupBy("event_type").agg(F.sum("n").alias("raw"), F.count("*").alias("saved"), (F.sum("n") - F.count("*")).alias("duplicates"), F.count("known").alias("baseline"), (F.count("*") - F.count("known")).alias("novel"))


@query("SELECT lang, 'found' AS stage, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT lang, 'distinct', count(DISTINCT text) FROM documents GROUP BY ALL UNION ALL SELECT lang, 'labelled', count(*) FROM documents JOIN labels USING (doc_id) GROUP BY ALL UNION ALL SELECT lang, 'relevant', count(*) FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY ALL")
def funnel(spark, sf_dir):
    """AGG-19: how many rows of each round reach each stage; languages stand for rounds."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    one = d.groupBy("lang").agg(F.count("*").alias("found"), F.countDistinct(F.sha2("text", 256)).alias("distinct"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("relevant"))
    return one.unpivot(["lang"], ["found", "distinct", "labelled", "relevant"], "stage", "n").where("n > 0")


@query("SELECT lower(source || '-' || lang) AS keyword, round(avg(n_chars), 4) AS score FROM documents GROUP BY 1")
def keyword_means(spark, sf_dir):
    """AGG-20: the mean score of each keyword, whatever its case."""
    found = table(spark, sf_dir, "documents").select(F.concat_ws("-", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")), "lang").alias("keyword"), F.col("n_chars").cast("double").alias("score"))
    return rounds.mean_scores(found).select("keyword", F.round("score", 4).alias("score"))


@query(f"WITH r AS (SELECT 'body' AS form, trim(text, {BLANK}) AS t FROM documents UNION ALL SELECT 'title_and_body', left(trim(left(text, 60), {BLANK}) || chr(10) || chr(10) || trim(text, {BLANK}), 15000) FROM documents) SELECT form, (sum(length(t)) // count(*))::BIGINT AS mean_length, max(length(t)) AS longest, max(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> ''))) AS most_words FROM r GROUP BY form")
def representation_sizes(spark, sf_dir):
    """AGG-22: mean and largest length of each representation, and its most words."""
    d = table(spark, sf_dir, "documents")
    forms = {"body": T.trimmed(F.coalesce("text", F.lit(""))), "title_and_body": windows.title_and_body(title(), F.col("text"))}
    r = d.select(F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("t")) for k, v in forms.items()))).alias("f")).select("f.*")
    return r.groupBy("form").agg(F.floor(F.sum(F.length("t")) / F.count("*")).alias("mean_length"), F.max(F.length("t")).cast("long").alias("longest"), F.max(T.word_count(F.col("t"))).cast("long").alias("most_words"))


# ---- Orders


def ranked(df: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first rows in an order, numbered; the order tells all rows apart."""
    rows = df.orderBy(*order).limit(most).select(F.struct("*").alias("r"))
    return rows.agg(F.collect_list("r").alias("rs")).select(F.posexplode("rs").alias("place", "r")).select((F.col("place") + 1).cast("long").alias("place"), "r.*")


DATED = "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '202' || (n_chars % 7) || '-01-0' || (1 + doc_id % 9) END"


def dated() -> Column:
    return F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("202"), (F.col("n_chars") % 7).cast("string"), F.lit("-01-0"), (1 + F.col("doc_id") % 9).cast("string")))


@query(f"SELECT row_number() OVER (ORDER BY day DESC NULLS LAST, n_chars DESC, doc_id) AS place, doc_id, day FROM (SELECT doc_id, n_chars, {DATED} AS day FROM documents) QUALIFY place <= 60")
def newest_first(spark, sf_dir):
    """SRT-01: the newest first, rows without a date last, then by a second date."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", dated().alias("day"))
    return ranked(d, 60, F.desc_nulls_last("day"), F.desc("n_chars"), F.col("doc_id")).select("place", "doc_id", "day")


RANKS = {"keep_core": 0, "manual_review": 1, "drop": 2}


@query("SELECT row_number() OVER (ORDER BY CASE label WHEN 'keep_core' THEN 0 WHEN 'manual_review' THEN 1 WHEN 'drop' THEN 2 ELSE 3 END, score DESC, n_chars DESC, doc_id) AS place, doc_id FROM (SELECT doc_id, n_chars, ['drop', 'keep_core', 'other', 'manual_review'][1 + doc_id % 4] AS label, (n_chars % 11) / 10 AS score FROM documents) QUALIFY place <= 60")
def keyword_order(spark, sf_dir):
    """SRT-02: by label rank, then score and frequency, then name."""
    label = F.get(F.array(*map(F.lit, ("drop", "keep_core", "other", "manual_review"))), (F.col("doc_id") % 4).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", label.alias("label"), (F.col("n_chars") % 11 / 10).alias("score"))
    return ranked(d, 60, relevance.chosen(F.col("label"), RANKS, 3), F.desc("score"), F.desc("n_chars"), F.col("doc_id")).select("place", "doc_id")


@query(f"SELECT row_number() OVER (ORDER BY CASE label WHEN 'likely_relevant' THEN 0 WHEN 'manual_review' THEN 1 WHEN 'metadata_drop' THEN 2 ELSE 9 END, score DESC, coalesce(day, ''), doc_id) AS place, doc_id FROM (SELECT doc_id, ['metadata_drop', 'likely_relevant', 'manual_review'][1 + doc_id % 3] AS label, n_chars % 100 AS score, {DATED} AS day FROM documents) QUALIFY place <= 60")
def review_order(spark, sf_dir):
    """SRT-04: by label, best score first, oldest first."""
    label = F.get(F.array(*map(F.lit, ("metadata_drop", "likely_relevant", "manual_review"))), (F.col("doc_id") % 3).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", label.alias("label"), (F.col("n_chars") % 100).alias("score"), F.coalesce(dated(), F.lit("")).alias("day"))
    return ranked(d, 60, relevance.chosen(F.col("label"), {"likely_relevant": 0, "manual_review": 1, "metadata_drop": 2}, 9), F.desc("score"), F.col("day"), F.col("doc_id")).select("place", "doc_id")


@query(f"""WITH d AS (SELECT doc_id, {DATED} AS day, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars % 101 END AS score, {TITLE} AS t FROM documents)
SELECT * FROM (SELECT 'newest' AS sort, row_number() OVER (ORDER BY coalesce(day, '0000') DESC, doc_id) AS place, doc_id FROM d QUALIFY place <= 12) UNION ALL SELECT * FROM (SELECT 'oldest', row_number() OVER (ORDER BY coalesce(day, '9999'), doc_id) AS place, doc_id FROM d QUALIFY place <= 12)
UNION ALL SELECT * FROM (SELECT 'confidence', row_number() OVER (ORDER BY coalesce(score, -1) DESC, doc_id) AS place, doc_id FROM d QUALIFY place <= 12) UNION ALL SELECT * FROM (SELECT 'title', row_number() OVER (ORDER BY lower(t), doc_id) AS place, doc_id FROM d QUALIFY place <= 12)""")
def explorer_sorts(spark, sf_dir):
    """SRT-05: the explorer's four orders, with what stands for a missing value; titles by their letters in any case."""
    d = table(spark, sf_dir, "documents").select("doc_id", dated().alias("day"), F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") % 101).alias("score"), F.lower(title()).alias("t"))
    orders = {"newest": F.coalesce("day", F.lit("0000")).desc(), "oldest": F.coalesce("day", F.lit("9999")), "confidence": F.coalesce("score", F.lit(-1)).desc(), "title": F.col("t")}
    return stacked([ranked(d, 12, o, F.col("doc_id")).select(F.lit(k).alias("sort"), "place", "doc_id") for k, o in orders.items()])


BONUS = {"title_only": 20, "phrase": 10}


@query(f"""WITH d AS (SELECT doc_id, lower({TITLE}) AS t, ['strong_title_match', 'ghee_context_only_in_title', 'broad_food_safety_title', 'weak_or_body_only_match'][1 + doc_id % 4] AS label, ['title_only', 'phrase', 'boolean'][1 + n_chars % 3] AS family, {DATED} AS day FROM documents),
s AS (SELECT *, [100, 70, 45, 10][1 + doc_id % 4] + [20, 10, 0][1 + list_position(['title_only', 'phrase', 'boolean'], family) - 1] + 3 * {many('t', ['the', 'of'])} + 5 * {many('t', ['and', 'in'])} AS score FROM d)
SELECT row_number() OVER (ORDER BY doc_id % 4, score DESC, family, coalesce(day, ''), doc_id) AS place, doc_id, score::INT AS score FROM s QUALIFY place <= 60""")
def priority_order(spark, sf_dir):
    """TXT-11, SRT-10: points of a match, and the order of the review queue."""
    names = F.array(*map(F.lit, ("strong_title_match", "ghee_context_only_in_title", "broad_food_safety_title", "weak_or_body_only_match")))
    family = F.get(F.array(*map(F.lit, ("title_only", "phrase", "boolean"))), (F.col("n_chars") % 3).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", title().alias("t"), F.get(names, (F.col("doc_id") % 4).cast("int")).alias("label"), family.alias("family"), F.coalesce(dated(), F.lit("")).alias("day"))
    d = d.withColumn("score", relevance.priority_score(F.col("label"), F.col("family"), T.terms_in(F.col("t"), ["the", "of"]), T.terms_in(F.col("t"), ["and", "in"]), BONUS))
    return ranked(d, 60, F.col("doc_id") % 4, F.desc("score"), F.col("family"), F.col("day"), F.col("doc_id")).select("place", "doc_id", "score")


# ---- Scores and keyword rules


FAMILIES = ["title_only", "phrase", "boolean", "proximity"]


@query(f"""WITH d AS (SELECT doc_id, trim(regexp_replace(replace(regexp_replace({TITLE} || ' ' || {SITE}, '<[^>]+>', ' ', 'g'), chr(160), ' '), '\\s+', ' ', 'g')) AS clean, ['title_only', 'phrase', 'boolean', 'proximity'][1 + doc_id % 4] AS family, CASE WHEN doc_id % 3 = 0 THEN 'about the and fake' WHEN doc_id % 3 = 1 THEN 'fake' ELSE 'none' END AS q FROM documents),
h AS (SELECT *, lower(clean) AS low, {some('lower(clean)', ['the', 'of'])} AS p, {some('lower(clean)', ['and', 'in'])} AS s, {some('lower(clean)', ['the and', 'of in'])} AS i FROM d),
pos AS (SELECT doc_id, substring(low, greatest(1, x - 80), x + n + 80 - greatest(1, x - 80)) AS snip FROM (SELECT doc_id, low, unnest(list_filter(range(1, length(low) + 1), lambda k: substring(low, k, 3) = 'the')) AS x, 3 AS n FROM h UNION ALL SELECT doc_id, low, unnest(list_filter(range(1, length(low) + 1), lambda k: substring(low, k, 2) = 'of')), 2 FROM h)),
close AS (SELECT DISTINCT doc_id FROM pos WHERE {some('snip', ['and', 'in'])}),
n AS (SELECT h.*, least(100, CASE WHEN i THEN 60 WHEN p THEN 35 WHEN contains(q, 'the') THEN 10 ELSE 0 END + CASE WHEN s THEN 35 WHEN contains(q, 'fake') THEN 12 ELSE 0 END + [18, 14, 8, 5][1 + doc_id % 4] + CASE WHEN close.doc_id IS NOT NULL THEN 20 ELSE 0 END) AS score FROM h LEFT JOIN close USING (doc_id))
SELECT doc_id, score::INT AS score, CASE WHEN score >= 75 AND (p OR i) AND (s OR i) THEN 'likely_relevant' WHEN score >= 45 THEN 'manual_review' ELSE 'metadata_drop' END AS label, CASE WHEN score >= 75 AND (p OR i) AND (s OR i) THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS priority FROM n""")
def metadata_scores(spark, sf_dir):
    """TXT-10: points, label and priority of a row by title, URL and the query that found it."""
    k = F.col("doc_id") % 3
    asked_ = F.when(k == 0, "about the and fake").when(k == 1, "fake").otherwise("none")
    family = F.get(F.array(*map(F.lit, FAMILIES)), (F.col("doc_id") % 4).cast("int"))
    m = relevance.metadata_score(F.concat(title(), F.lit(" "), site()), family, asked_, ["the", "of"], ["and", "in"], ["the and", "of in"], "the", ["fake"])
    return table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).select("doc_id", "m.score", "m.label", "m.priority")


@query("""WITH d AS (SELECT doc_id, ['title_only', 'phrase', 'boolean', 'proximity'][1 + doc_id % 4] AS f, CASE WHEN n_chars % 2 = 0 THEN 'proximity_oil_seized' ELSE 'other' END AS q, ['relevant', 'manual_review', 'irrelevant'][1 + n_chars % 3] AS l, CASE WHEN n_chars % 5 = 0 THEN 'non_food_oil' ELSE 'adjacent_or_unclear' END AS r, n_chars % 7 < 3 AS c FROM documents)
SELECT doc_id, CASE WHEN l = 'relevant' THEN 'high' WHEN f = 'title_only' AND c THEN 'high' WHEN f = 'proximity' AND q <> 'proximity_oil_seized' AND l <> 'irrelevant' THEN 'high' WHEN l = 'manual_review' THEN 'medium' WHEN f = 'title_only' AND r <> 'non_food_oil' THEN 'medium' WHEN f IN ('phrase', 'boolean') AND l <> 'irrelevant' THEN 'medium' ELSE 'drop' END AS crawl_priority FROM d""")
def crawl_priorities(spark, sf_dir):
    """TXT-12: whether a found row is crawled first, later or not."""
    n = F.col("n_chars")
    family, label = F.get(F.array(*map(F.lit, FAMILIES)), (F.col("doc_id") % 4).cast("int")), F.get(F.array(*map(F.lit, ("relevant", "manual_review", "irrelevant"))), (n % 3).cast("int"))
    p = relevance.crawl_priority(family, F.when(n % 2 == 0, "proximity_oil_seized").otherwise("other"), label, F.when(n % 5 == 0, "non_food_oil").otherwise("adjacent_or_unclear"), n % 7 < 3, "proximity_oil_seized")
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("crawl_priority"))


CATEGORIES = ["oil/product", "incident/action phrase", "adulteration/fraud", "location", "other_candidate"]


@query("""WITH c AS (SELECT p_partkey, lower(p_type) AS term, ['oil/product', 'incident/action phrase', 'adulteration/fraud', 'location', 'other_candidate'][1 + p_partkey % 5] AS cat, (p_partkey % 100) / 100 AS score, 1 + p_size % 3 AS m, p_size AS df, p_size * 2 AS tf FROM part),
f AS (SELECT *, contains(term, 'steel') AS prod, contains(term, 'brass') AS drifts, CASE WHEN starts_with(term, 'promo') THEN 'frame' END AS gone FROM c)
SELECT p_partkey, CASE WHEN gone IS NOT NULL THEN 'drop' WHEN cat = 'location' THEN 'manual_review' WHEN drifts THEN 'manual_review' WHEN cat = 'oil/product' AND prod AND score >= 0.35 THEN 'keep_core' WHEN cat = 'oil/product' THEN 'manual_review'
 WHEN cat = 'incident/action phrase' AND score >= 0.40 AND (prod OR m >= 2) THEN 'keep_core' WHEN cat = 'incident/action phrase' THEN 'manual_review' WHEN cat = 'adulteration/fraud' AND score >= 0.45 AND (m >= 2 OR df >= 2 OR tf >= 3) THEN 'keep_core'
 WHEN cat = 'adulteration/fraud' AND (score >= 0.20 OR m >= 2) THEN 'manual_review' WHEN cat = 'adulteration/fraud' THEN 'drop' WHEN m >= 2 AND score >= 0.45 THEN 'manual_review' ELSE 'drop' END AS label FROM f""")
def keyword_labels(spark, sf_dir):
    """TXT-30: keep, review or drop of keyword candidates; part types stand for them."""
    term, score = F.lower("p_type"), F.col("p_partkey") % 100 / 100
    category = F.get(F.array(*map(F.lit, CATEGORIES)), (F.col("p_partkey") % 5).cast("int"))
    r = rounds.keyword_label(term, category, score, 1 + F.col("p_size") % 3, F.col("p_size"), F.col("p_size") * 2, F.when(F.startswith(term, F.lit("promo")), "frame"), F.contains(term, F.lit("steel")), F.contains(term, F.lit("brass")))
    return table(spark, sf_dir, "part").select("p_partkey", r["label"].alias("label"))


@query("""WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(left(text, 40), '\\s+', ' ', 'g'), ' '), lambda w: w <> '') AS w, lower(left(text, 40)) AS low FROM documents)
SELECT doc_id, coalesce(len(w) = 0 OR len(list_filter(w, lambda x: length(x) > 35)) > 0 OR w[1] IN ('the', 'of') OR w[len(w)] IN ('the', 'of') OR regexp_matches(low, 'https?|www|\\.com|copyright|advertisement|subscribe'), true) AS bad, contains(low, 'th') OR contains(low, 'oil') AS domainish FROM p""")
def phrase_checks(spark, sf_dir):
    """TXT-31: phrases that are no keywords, and those that sound of the domain."""
    phrase = F.left(F.coalesce("text", F.lit("")), F.lit(40))
    return table(spark, sf_dir, "documents").select("doc_id", rounds.bad_phrase(phrase, ["the", "of"]).alias("bad"), rounds.domainish(phrase, ["th", "oil"]).alias("domainish"))


CANDIDATES = ["of the", "that the", "in the", "with", "oil price", "no such phrase", "and"]


@query("""WITH c AS (SELECT unnest(['of the', 'that the', 'in the', 'with', 'oil price', 'no such phrase', 'and']) AS term), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9&/-]*') AS w FROM documents WHERE contains(lower(text), 'which') OR contains(lower(text), 'oil')),
g AS (SELECT DISTINCT doc_id, w[i] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) UNION SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d))
SELECT term FROM c WHERE contains(term, 'oil') OR contains(term, 'which') OR (SELECT count(*) FROM g WHERE g.term = c.term) >= 3""")
def domain_keywords(spark, sf_dir):
    """TXT-32: candidates that hold a domain word or stand in enough documents that do."""
    c = spark.createDataFrame([(t,) for t in CANDIDATES], "term string")
    return rounds.domain_relevant(c, table(spark, sf_dir, "documents"), "doc_id", "text", ["which", "oil"], 3)


@query(f"SELECT doc_id, md5('Title: ' || {TITLE} || chr(10) || 'URL: ' || {SITE} || chr(10) || 'Text: ' || left(coalesce(text, ''), 6500)) AS prompt FROM documents")
def prompts(spark, sf_dir):
    """TXT-48: what a reader model would be asked."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(relevance.prompt(title(), site(), F.col("text"), 6500)).alias("prompt"))


@query("SELECT doc_id, CASE WHEN l IN ('relevant', 'unclear') OR (r = 'adulterated_product' AND c < 0.95) THEN 'rescue_review' ELSE 'confirm_reject' END AS decision FROM (SELECT doc_id, ['relevant', 'irrelevant', 'unclear', 'irrelevant'][1 + doc_id % 4] AS l, CASE WHEN n_chars % 2 = 0 THEN 'adulterated_product' ELSE 'adulterant' END AS r, (n_chars % 101) / 100 AS c FROM documents)")
def audit_decisions(spark, sf_dir):
    """TXT-51: which rejected rows are looked at again."""
    label = F.get(F.array(*map(F.lit, ("relevant", "irrelevant", "unclear", "irrelevant"))), (F.col("doc_id") % 4).cast("int"))
    role = F.when(F.col("n_chars") % 2 == 0, "adulterated_product").otherwise("adulterant")
    return table(spark, sf_dir, "documents").select("doc_id", relevance.audit_decision(label, F.col("n_chars") % 101 / 100, role).alias("decision"))
