"""Queries for keyword and URL merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import duplicates, keywords, relevance, rounds
from newsloom.plans.catalogue import query
from newsloom.sources.tables import table

TERMS = ["that the", "of the", "the and", "in the"]
TOK = "list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9&/-]*'), lambda t: length(t) >= 1)"


@query(f"WITH w AS (SELECT doc_id, {TOK} AS w FROM documents), g AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)) SELECT term, count(*) AS total_frequency, count(DISTINCT doc_id) AS document_frequency FROM g WHERE term IN ({', '.join(repr(t) for t in TERMS)}) GROUP BY 1")
def term_document_join(spark, sf_dir):
    """JN-17, TXT-19: terms meet documents as n-grams, by equal keys, in one pass for all terms."""
    words = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text"), least=1).alias("w"))
    grams = words.select("doc_id", F.explode(T.ngrams(F.col("w"), 2)).alias("term"))
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    met = grams.join(F.broadcast(terms), "term").groupBy("term", "doc_id").agg(F.count("*").alias("n"))  # a list of terms
    return met.groupBy("term").agg(F.sum("n").alias("total_frequency"), F.count("*").alias("document_frequency"))


@query("WITH c AS (SELECT DISTINCT lower(p_type) AS term FROM part), p AS (SELECT unnest(['brass', 'steel', 'x small']) AS positive) SELECT DISTINCT term FROM c JOIN p ON contains(term, positive) OR contains(positive, term)")
def overlap_risk(spark, sf_dir):
    """JN-19."""
    c = table(spark, sf_dir, "part").select(F.lower("p_type").alias("term")).distinct()
    return keywords.overlap_risk(c, ["brass", "steel", "x small"])


KEPT, DOMAIN, JUNK = ["brushed brass", "steel", "tin", "standard"], ["econ", "med"], {"price": ["nickel", "large"], "place": ["copper", "promo"]}


@query("""WITH c AS (SELECT DISTINCT lower(p_type) AS term FROM part), o AS (SELECT term, list_filter(['brushed brass', 'steel', 'tin', 'standard'], lambda k: contains(term, k) OR contains(k, term)) AS o FROM c)
SELECT term, CASE WHEN term IN ('brushed brass', 'steel', 'tin', 'standard') THEN 'kept_keyword' WHEN len(o) > 0 THEN 'overlaps' WHEN contains(term, 'econ') OR contains(term, 'med') THEN 'domain_term' ELSE 'possible' END AS risk,
 CASE WHEN term IN ('brushed brass', 'steel', 'tin', 'standard') THEN term ELSE array_to_string(o[1:3], '; ') END AS overlap, CASE WHEN contains(term, 'nickel') OR contains(term, 'large') THEN 'price' WHEN contains(term, 'copper') OR contains(term, 'promo') THEN 'place' ELSE 'other' END AS category FROM o""")
def exclusion_risks(spark, sf_dir):
    """TXT-34, JN-19: what terms would cost as exclusions, and what kind of junk they are."""
    c = table(spark, sf_dir, "part").select(F.lower("p_type").alias("term")).distinct()
    return c.select("term", rounds.exclusion_risk(F.col("term"), KEPT, DOMAIN).alias("r"), rounds.first_category(F.col("term"), JUNK, "other").alias("category")).select("term", "r.risk", "r.overlap", "category")


VARIANTS = {"example.com": ["{base}/amp{path}{query}", "{base}{path}/amp{query}"], "example.org": ["{base}/amp{path}{query}", "{base}{path}?amp=1"]}


@query("""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS base, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p, CASE WHEN regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) END AS q FROM pages)
SELECT page_id, unnest(list_distinct(CASE WHEN contains(host, 'example.com') THEN [url, base || '/amp' || p || q, base || p || '/amp' || q] WHEN contains(host, 'example.org') THEN [url, base || '/amp' || p || q, base || p || '?amp=1'] ELSE [url] END)) AS variant FROM u""")
def url_variants(spark, sf_dir):
    """SRC-22: what else a page may stand under, by its host."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.variants(F.col("url"), VARIANTS)).alias("variant"))


@query("WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(lower(source || 's ' || lang || 'ies'), '(\\w{2,})ies\\b', '\\1y', 'g'), '(\\w{3,}[^s])s\\b', '\\1', 'g') AS form FROM documents) SELECT form, min(doc_id) AS first_doc, count(*) AS n FROM n GROUP BY form")
def stem_forms(spark, sf_dir):
    """DD-16: keywords by their normal form, the first of each."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.stem_key(F.concat("source", F.lit("s "), "lang", F.lit("ies"))).alias("form"))
    return d.groupBy("form").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("WITH f AS (SELECT o_orderpriority AS q, min(o_orderkey) AS pos FROM orders GROUP BY 1) SELECT q, pos, row_number() OVER (ORDER BY pos) AS query_number FROM f")
def plan_dedup(spark, sf_dir):
    """DD-17, WIN-03: the first of each query over all plan files, numbered again."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("q")).agg(F.min("o_orderkey").alias("pos"))
    return o.withColumn("query_number", F.row_number().over(Window.orderBy("pos")).cast("long"))  # a plan's few queries


@query("""WITH RECURSIVE o AS (SELECT page_id AS r, row_number() OVER (ORDER BY page_id) AS n, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS u, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t FROM pages),
s AS (SELECT 0::BIGINT AS n, []::STRUCT(r BIGINT, u VARCHAR, t VARCHAR)[] AS led, NULL::BIGINT AS r, NULL::BIGINT AS leader, NULL::INT AS layer
  UNION ALL
  SELECT n, CASE WHEN coalesce(l0, l1) IS NULL THEN list_append(led, {'r': r, 'u': u, 't': t}) ELSE led END, r, coalesce(l0, l1), CASE WHEN l0 IS NOT NULL THEN 0 WHEN l1 IS NOT NULL THEN 1 END
  FROM (SELECT o.n, s.led, o.r, o.u, o.t, list_filter(s.led, lambda x: x.u = o.u AND o.u <> '')[1].r AS l0, list_filter(s.led, lambda x: x.t = o.t AND o.t <> '')[1].r AS l1 FROM s JOIN o ON o.n = s.n + 1))
SELECT r AS page_id, leader, layer FROM s WHERE r IS NOT NULL""")
def or_key_dedup(spark, sf_dir):
    """DD-12, DD-18: rows that share a URL key or a title with an earlier kept row; the twin scans row by row."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    members = duplicates.memberships(p, "page_id", [T.plain_url_key(F.col("url")), F.lower("title")])
    return duplicates.leaders(p, members, None, "page_id")


def _word(term: str) -> str:
    return f"regexp_matches(low, '(^|[^\\pL\\pN_]){term}([^\\pL\\pN_]|$)')::INT"


@query(f"""WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), n AS (SELECT doc_id, low, {_word('that')} + {_word('which')} AS p, {_word('the')} AS b, {_word('and')} + {_word('of')} + {_word('in')} + {_word('de')} AS o FROM l)
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(low, 'with[^.]{{0,40}}that') THEN 'reuse' END, CASE WHEN p = 0 AND b = 0 THEN 'no_product' WHEN p = 0 THEN 'only_bare' END, CASE WHEN o >= 3 AND p <= 1 THEN 'others_dominate' END], lambda x: x IS NOT NULL), '|') AS flags FROM n""")
def suspect_flags(spark, sf_dir):
    """TXT-50."""
    flags = relevance.suspect_flags(F.col("text"), ["that", "which"], "the", ["and", "of", "in", "de"], "with[^.]{0,40}that")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(flags, "|").alias("flags"))


P = "(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ')"


@query(f"SELECT doc_id, CASE WHEN contains({P}, ' that ') THEN 'product' WHEN contains({P}, ' with ') OR contains({P}, ' from ') THEN 'signal' ELSE 'context' END AS term_class FROM documents")
def term_classes(spark, sf_dir):
    """TXT-29."""
    return table(spark, sf_dir, "documents").select("doc_id", rounds.term_class(F.col("text"), {"product": ["that"], "signal": ["with", "from"]}).alias("term_class"))


KINDS = ["oil/product", "fraud/adulteration", "adulterant/mixing", "enforcement/evidence", "incident/action phrase", "support/other", "unknown"]


@query("""WITH t AS (SELECT p_partkey, lower(p_type) AS term, ['oil/product', 'fraud/adulteration', 'adulterant/mixing', 'enforcement/evidence', 'incident/action phrase', 'support/other', 'unknown'][1 + p_partkey % 7] AS c, p_partkey % 7 AS k, contains(lower(p_type), 'tin') AND p_size < 10 AS comb FROM part),
r AS (SELECT *, CASE WHEN p_partkey IN (SELECT p_partkey FROM part WHERE lower(p_type) IN ('small plated tin', 'large brushed steel')) THEN 'combine_only' WHEN k < 5 THEN ['product', 'fraud_signal', 'adulterant_or_mixing_signal', 'enforcement_signal', 'exact_incident_phrase'][k + 1] ELSE 'support_only' END AS role FROM t)
SELECT p_partkey, role, CASE WHEN role IN ('combine_only', 'support_only') THEN 'combine_only' ELSE 'query_component' END AS use, CASE WHEN k < 6 THEN k ELSE 99 END::BIGINT AS category_rank,
 list_position(['product', 'fraud_signal', 'adulterant_or_mixing_signal', 'enforcement_signal', 'exact_incident_phrase', 'combine_only', 'support_only'], role)::BIGINT - 1 AS role_rank FROM r""")
def keyword_roles(spark, sf_dir):
    """TXT-33: what keywords are good for in queries, and the order in which they are listed."""
    category = F.get(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 7).cast("int"))
    r = rounds.query_role(F.lower("p_type"), category, ["small plated tin", "large brushed steel"])
    out = table(spark, sf_dir, "part").select("p_partkey", r.alias("r"))
    return out.select("p_partkey", "r.role", "r.use", F.col("r.category_rank").cast("long").alias("category_rank"), F.col("r.role_rank").cast("long").alias("role_rank"))


@query("""WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w, lower(p_type) AS t FROM part), q AS (SELECT p_partkey, t, '(' || array_to_string(list_transform(list_concat(w, [t, 'seiz*', 'lang:en']), lambda x: CASE WHEN contains(x, ':') OR contains(x, '*') THEN x WHEN contains(x, ' ') OR contains(x, '-') THEN '"' || x || '"' ELSE x END), ' OR ') || ')' AS g FROM p)
SELECT p_partkey, '(' || g || ' AND (article_title:fake OR article_title:"food safety")) AND NOT ("stock market" OR ipl)' AS query, '"' || t || '"~10' AS near FROM q""")
def boolean_queries(spark, sf_dir):
    """TXT-35: search strings of OR groups, fields, exclusions and distances."""
    terms = F.concat(F.split(F.lower("p_name"), " "), F.array(F.lower("p_type"), F.lit("seiz*"), F.lit("lang:en")))
    words = lambda *ws: F.array(*map(F.lit, ws))
    base = F.concat(T.or_group(terms), F.lit(" AND "), T.or_group(words("fake", "food safety"), "article_title"))
    return table(spark, sf_dir, "part").select("p_partkey", T.scoped(base, words("stock market", "ipl")).alias("query"), T.within(F.lower("p_type"), 10).alias("near"))


@query("""WITH d AS (SELECT doc_id, text, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS s, ['3', ' 12', 'Round B!', '100'][1 + doc_id % 4] AS r FROM documents)
SELECT doc_id, CASE WHEN left(s, 80) = '' THEN left(sha1(text), 16) ELSE left(s, 80) END AS slug, ['round_03', 'round_12', 'round_round_b', 'round_100'][1 + doc_id % 4] AS round FROM d""")
def safe_names(spark, sf_dir):
    """TXT-37: slugs of at most 80 characters and names of rounds."""
    r = F.get(F.array(*map(F.lit, ("3", " 12", "Round B!", "100"))), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"), T.round_name(r).alias("round"))


@query("WITH r AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'adulterant' ELSE 'adjacent_or_unclear' END AS role, CASE WHEN n_chars % 2 = 0 THEN 'relevant' ELSE 'irrelevant' END AS llm, (n_chars % 101) / 100.0 AS conf FROM documents) SELECT doc_id, CASE WHEN role <> 'adulterant' AND conf >= 0.65 THEN llm WHEN role = 'adulterant' AND llm = 'relevant' AND conf >= 0.90 THEN 'manual_review' ELSE 'irrelevant' END AS label, round(CASE WHEN role <> 'adulterant' AND conf >= 0.65 THEN greatest(0.7, conf) WHEN role = 'adulterant' AND llm = 'relevant' AND conf >= 0.90 THEN 0.6 ELSE 0.7 END, 3)::DOUBLE AS confidence FROM r")
def merged_readings(spark, sf_dir):
    """TXT-08."""
    n = F.col("n_chars")
    role = F.when(n % 3 == 0, "adulterant").otherwise("adjacent_or_unclear")
    m = relevance.merge_reading(role, F.lit("irrelevant"), F.lit(0.7), F.when(n % 2 == 0, "relevant").otherwise("irrelevant"), (n % 101) / 100.0, F.lit("evidence"))
    return table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).select("doc_id", "m.label", F.col("m.confidence").cast("double").alias("confidence"))
