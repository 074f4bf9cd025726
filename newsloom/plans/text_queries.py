"""Queries over documents and pages: text functions, keywords, relevance, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import duplicates, keywords, metrics, relevance, windows, yake
from newsloom.plans.catalogue import query
from newsloom.sources.shared import cut, written
from newsloom.sources.tables import table, urls_in

#: A test profile of words that occur in documents: the shipped domains' words do not.
PRODUCT, SIGNAL, ACTION, PLACES, COUNTRY = ["the", "that", "le"], ["with", "was", "en"], ["for", "from", "de"], ["are", "of", "la"], ["to", "and", "un"]
PROFILE = relevance.Profile(
    product=["that", "thing"], adulteration=["with"], action=["from"], places=["are", "of"], country=["are"], country_names=["are"], non_food=["was"], business=["for"], out_of_scope=["by"], other_food=["his"], excluded=[" which "],
    reject=["###"], strong=["the that"], as_adulterant=["is the of"],
)
#: A title and a URL for documents, which have neither.
TITLE, SITE = "left(coalesce(text, ''), 60)", "'https://www.' || source || '.example/' || n_chars || '?utm_source=x'"


def title() -> Column:
    return F.left(F.coalesce("text", F.lit("")), F.lit(60))


def site() -> Column:
    return F.concat(F.lit("https://www."), "source", F.lit(".example/"), F.col("n_chars").cast("string"), F.lit("?utm_source=x"))


def word(text: str, term: str) -> str:
    """SQL: whether a term stands in a lower-cased text between characters that are no letters or digits of any script."""
    return f"regexp_matches({text}, '(^|[^\\pL\\pN_]){term}([^\\pL\\pN_]|$)')"


def some(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(word(text, t) for t in terms) + ")"


def many(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"{word(text, t)}::INT" for t in terms) + ")"


def around(at: str, length: int, before: int, after: int) -> str:
    """SQL: text of clean around a place."""
    return f"trim(substring(clean, greatest(1, {at} - {before}), {at} + {length + after} - greatest(1, {at} - {before})))"


def beside(terms: list[str]) -> str:
    """SQL: text of clean around the first of the terms that is a word of low."""
    cases = [f"WHEN {word('low', t)} THEN " + around(f"instr(low, '{t}')", len(t), 100, 140) for t in terms]
    return " ".join(["CASE", *cases, "ELSE '' END"])


def lit(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


PAD = "(' ' || trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g')) || ' ')"
HAS = lambda pad, words: "(" + " OR ".join(f"contains({pad}, ' {w} ')" for w in words) + ")"
COUNT = lambda pad, words: "(" + " + ".join(f"contains({pad}, ' {w} ')::INT" for w in words) + ")"


@query(f"""
WITH p AS (SELECT source, {PAD.format('text')} AS p FROM documents),
l AS (SELECT source, CASE WHEN {HAS('p', PRODUCT)} AND {HAS('p', SIGNAL)} THEN 'product_and_signal' WHEN {HAS('p', PRODUCT)} THEN 'product_only' WHEN {HAS('p', SIGNAL)} THEN 'signal_only' ELSE 'neither' END AS title_label FROM p)
SELECT source, title_label, count(*) AS n FROM l GROUP BY ALL""")
def discovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-02, TXT-04, AGG-01: documents by source and screen label."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", relevance.title_label(F.col("text"), PRODUCT, SIGNAL).alias("title_label")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform([1,2,3,4,5], lambda i: CASE WHEN contains({PAD.format('text')}, ' ' || {lit(['that', 'with', 'the', 'and', 'of'])}[i] || ' ') THEN {lit(['that', 'with', 'the', 'and', 'of'])}[i] END), lambda x: x IS NOT NULL)[1:3], '; ') AS hits FROM documents")
def lexicon_hits(spark, sf_dir):
    """TXT-02: whole-word terms, longest first, capped."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.padded_terms(F.col("text"), ["that", "with", "the", "and", "of"], 3), "; ").alias("hits"))


CANON = """regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"""
PATH = """regexp_replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"""
URL_PARTS = f"""u AS (SELECT page_id, url, {CANON.format('url')} AS h, {PATH.format('url')} AS p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s FROM pages),
kv AS (SELECT page_id, i, url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')) AS k, url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' ')) AS v
  FROM (SELECT page_id, i, string_split(q, '&')[i] AS x FROM (SELECT page_id, q, unnest(range(1, len(string_split(q, '&')) + 1)) AS i FROM u WHERE q <> '')) WHERE x <> '')"""


@query(f"""WITH {URL_PARTS},
firsts AS (SELECT page_id, k, min_by(v, i) AS v FROM kv WHERE v <> '' AND lower(k) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'referrer', 'fbclid', 'gclid', 'msclkid', '_ga', 'source', 'from', 'via', 'share', 's', 'cmpid', 'mod') GROUP BY ALL),
q AS (SELECT page_id, string_agg(k || '=' || v, '&' ORDER BY k) AS q FROM firsts GROUP BY page_id)
SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN coalesce(q.q, '') = '' THEN '' ELSE '?' || q.q END AS canonical FROM u LEFT JOIN q USING (page_id)""")
def url_canonical(spark, sf_dir):
    """DD-01."""
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query(f"""WITH {URL_PARTS},
q AS (SELECT page_id, string_agg(url_encode(k) || '=' || url_encode(v), '&' ORDER BY k, v) AS q FROM kv WHERE NOT starts_with(lower(k), 'utm_') AND lower(k) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'source', 'utm') GROUP BY page_id)
SELECT page_id, s || '://' || h || CASE WHEN p = '' AND regexp_matches(url, '^[^/]*//[^/?#]*/') THEN '/' ELSE p END || CASE WHEN coalesce(q.q, '') = '' THEN '' ELSE '?' || q.q END AS review_key FROM u LEFT JOIN q USING (page_id)""")
def url_review_key(spark, sf_dir):
    """DD-02."""
    return table(spark, sf_dir, "pages").select("page_id", T.review_url(F.col("url")).alias("review_key"))


#: SQL: letters of the fixed tables that fall apart, each into a letter and a mark, which becomes a space.
APART = {"àâäáãå": "a", "ç": "c", "éèêë": "e", "îïíì": "i", "ñ": "n", "ôöóòõ": "o", "ùûüú": "u", "ÿý": "y"}


def plain_title(x: str) -> str:
    """SQL: a title as the normal form has it."""
    for letters, plain in APART.items():
        x = f"regexp_replace({x}, '[{letters}]', '{plain} ', 'g')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(\\p{{Nd}})[,.](\\p{{Nd}})', '\\1\\2', 'g'), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'), '(\\p{{Nd}}) (\\p{{Nd}})', '\\1\\2', 'g'))"


@query(f"SELECT page_id, {plain_title("lower(regexp_extract(html, '<title>([^<]*)</title>', 1))")} AS plain_title FROM pages")
def normal_titles(spark, sf_dir):
    """DD-04 of all pages."""
    return table(spark, sf_dir, "pages").select("page_id", T.normal_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("plain_title"))


@query(f"SELECT page_id, {CANON.format('url')} AS domain, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) || {PATH.format('url')} AS plain_key, regexp_replace({CANON.format('url')}, '[^A-Za-z0-9_.-]', '_', 'g') || '/' || left(sha256(url), 16) || '.txt' AS text_path FROM pages")
def url_domain(spark, sf_dir):
    """TXT-45, DD-03, SNK-12."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.domain(u).alias("domain"), T.plain_url_key(u).alias("plain_key"), T.cleaned_text_path(u).alias("text_path"))


@query("""
SELECT doc_id, CASE WHEN text <> '' THEN sha256(text) END AS text_hash, left(sha1(text), 16) AS short_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, coalesce(len(regexp_extract_all(lower(text), '[a-z][a-z0-9&/-]*')), 0) AS tokens,
 trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug_whole FROM documents""")
def text_scalars(spark, sf_dir):
    """DD-05, TXT-22, TXT-39; slugs before they are cut."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.text_hash(t).alias("text_hash"), F.left(F.sha1(t), F.lit(16)).alias("short_id"), T.word_count(t).cast("long").alias("words"), F.size(T.tokens(t, least=1)).cast("long").alias("tokens"), F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-|-$", "").alias("slug_whole"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(left(text, 200), '\\s+\\S*$', '') || '...' END AS excerpt, (length(lower(text)) - length(replace(lower(text), 'th', ''))) // 2 AS th_count, CASE WHEN instr(lower(text), 'that') > 0 THEN trim(substring(text, greatest(1, instr(lower(text), 'that') - 100), instr(lower(text), 'that') + 4 + 140 - greatest(1, instr(lower(text), 'that') - 100))) ELSE '' END AS evidence FROM documents")
def text_excerpts(spark, sf_dir):
    """PRJ-03, TXT-16, TXT-20."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(t, 200).alias("excerpt"), T.phrase_count(t, "th").cast("long").alias("th_count"), T.snippet(t, ["that"]).alias("evidence"))


@query("SELECT page_id, array_to_string(found, ' ') AS urls FROM (SELECT page_id, list_transform(regexp_extract_all(html, 'https?://[^\\s\"''<>]+'), lambda u: regexp_replace(u, '[.,;)]+$', '')) AS found FROM pages)")
def url_extract(spark, sf_dir):
    """SRC-08: the fixture's pages hold no URL twice."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls_in(F.col("html")), " ").alias("urls"))


@query("SELECT page_id, nullif(regexp_extract(html, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS day, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n_chars FROM pages")
def html_meta(spark, sf_dir):
    """HTM-03, HTM-04, TXT-15."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", T.clean_date(h).alias("day"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.length(T.strip_markup(h)).cast("long").alias("n_chars"))


DUP = "WITH d AS (SELECT doc_id, source, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS f, count(*) OVER (PARTITION BY sha256(text)) AS c FROM documents)"


@query(f"{DUP} SELECT doc_id, f AS duplicate_of FROM d WHERE rn > 1")
def dup_exact_hash(spark, sf_dir):
    """DD-05, DD-13, WIN-01: later copies with the first; hot groups are a pre-aggregated minimum and a join."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.text_hash(F.col("text")).alias("h")).where("h is not null")
    first = cut(d.groupBy("h").agg(F.min("doc_id").alias("duplicate_of")))
    return d.join(first, "h").where("doc_id <> duplicate_of").select("doc_id", "duplicate_of")


@query(f"{DUP} SELECT doc_id, c > 1 AS shared FROM d")
def dup_flag_all(spark, sf_dir):
    """DD-15, WIN-05."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(cut(d.groupBy("h").agg((F.count("*") > 1).alias("shared"))), "h").select("doc_id", "shared")


SHINGLES = """
f AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text <> '' GROUP BY text),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM f),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)"""


@query(f"WITH {SHINGLES} SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.75")
def shingle_jaccard_pairs(spark, sf_dir):
    """DD-06, DD-07, JN-15: all near pairs of distinct texts, each told by its first document."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")
    # Digests are grouped, not texts.
    firsts = docs.groupBy(F.unhex(F.sha2("text", 256))).agg(F.min("doc_id").alias("r")).select("r")
    return duplicates.near_pairs(docs, "doc_id", F.col("text"), 0.75, firsts=firsts).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {SHINGLES} SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.75
UNION ALL SELECT f.doc_id, d.doc_id, 1.0 FROM documents d JOIN f USING (text) JOIN n ON n.doc_id = f.doc_id WHERE d.doc_id <> f.doc_id""")
def shingle_jaccard_pairs_all(spark, sf_dir):
    """DD-06, DD-07, JN-15 over all documents; copies are told of their text's first row. Held against brute force, too."""
    found = duplicates.near_pairs_folded(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 0.75)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


LEADERS = """
rows AS (SELECT doc_id AS r, row_number() OVER (ORDER BY doc_id) AS n, 'https://' || source || '.example/' || n_chars AS u, CASE WHEN text <> '' THEN sha256(text) END AS h,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '([0-9])[,.]([0-9])', '\\1\\2', 'g'), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'), '([0-9]) ([0-9])', '\\1\\2', 'g')) AS t FROM documents),
near AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.75),
near2 AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
h1 AS (SELECT doc_id AS g, sha256(text) AS h FROM f)"""


@query(f"""WITH RECURSIVE {SHINGLES},
{LEADERS},
nb AS (SELECT y.r, list(x.r ORDER BY x.r) AS xs FROM rows y JOIN h1 fy ON fy.h = y.h JOIN near2 ON near2.b = fy.g JOIN h1 fx ON fx.g = near2.a JOIN rows x ON x.h = fx.h AND x.r < y.r GROUP BY y.r),
o AS (SELECT rows.*, coalesce(xs, []) AS xs FROM rows LEFT JOIN nb USING (r)),
scan AS (SELECT 0::BIGINT AS n, []::STRUCT(r BIGINT, u VARCHAR, t VARCHAR, h VARCHAR)[] AS led, NULL::BIGINT AS r, NULL::BIGINT AS leader, NULL::INT AS layer
  UNION ALL
  SELECT n, CASE WHEN leader IS NULL THEN list_append(led, {{'r': r, 'u': u, 't': t, 'h': h}}) ELSE led END, r, leader, layer
  FROM (SELECT *, coalesce(l0, l1, l2, l3) AS leader, CASE WHEN l0 IS NOT NULL THEN 0 WHEN l1 IS NOT NULL THEN 1 WHEN l2 IS NOT NULL THEN 2 WHEN l3 IS NOT NULL THEN 3 END AS layer
    FROM (SELECT o.n, scan.led, o.r, o.u, o.t, o.h, list_filter(scan.led, lambda x: x.u = o.u)[1].r AS l0, CASE WHEN length(o.t) > 10 THEN list_filter(scan.led, lambda x: x.t = o.t)[1].r END AS l1,
      list_filter(scan.led, lambda x: x.h = o.h)[1].r AS l2, list_filter(scan.led, lambda x: list_contains(o.xs, x.r))[1].r AS l3 FROM scan JOIN o ON o.n = scan.n + 1)))
SELECT r AS doc_id, leader IS NOT NULL AS is_duplicate, leader AS duplicate_of, layer AS duplicate_layer FROM scan WHERE r IS NOT NULL""")
def leader_dedup(spark, sf_dir):
    """DD-08..DD-11: layers of URL, title, text and near text over all documents; the twin scans row by row."""
    docs = table(spark, sf_dir, "documents")
    out = duplicates.layered(docs, "doc_id", site(), F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"))
    return out.select("doc_id", "is_duplicate", "duplicate_of", "duplicate_layer")


TOK = "SELECT doc_id, source, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9&/-]*'), lambda t: length(t) >= 3 AND t NOT IN ('the', 'and')) AS w FROM documents"
def grams(most: int, words: str = TOK) -> str:
    """SQL: (doc_id, source, term) of all n-grams up to most words."""
    each = [f"SELECT doc_id, source, {' || chr(32) || '.join(f'w[i + {k}]' for k in range(n))} AS term FROM (SELECT doc_id, source, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w)" for n in range(1, most + 1)]
    return f"w AS ({words}), g AS ({' UNION ALL '.join(each)})"


GRAMS = grams(2)


@query(f"WITH {grams(4)} SELECT term, count(*) AS n FROM g GROUP BY term ORDER BY n DESC, term LIMIT 120")
def ngram_topk(spark, sf_dir):
    """TXT-23, SRT-07: runs of 1 to 4 words, after stop words are out."""
    words = table(spark, sf_dir, "documents").select(T.tokens(F.col("text"), ["the", "and"]).alias("w"))
    return keywords.frequent_runs(words, (1, 2, 3, 4), 120)


LONG = "SELECT doc_id, source, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda t: length(t) > 3 AND t NOT IN ('that', 'with')) AS w FROM documents"


@query(f"WITH {grams(3, LONG)} SELECT term, count(*) AS n FROM g WHERE contains(term, ' ') GROUP BY term ORDER BY n DESC, term LIMIT 100")
def phrase_topk(spark, sf_dir):
    """TXT-24: runs of two and three words of over three letters; none runs over the end of a document."""
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9_]+", " ")
    words = table(spark, sf_dir, "documents").select(F.filter(F.split(plain, " "), lambda t: (F.length(t) > 3) & ~t.isin("that", "with")).alias("w"))
    return keywords.frequent_runs(words, (2, 3), 100)


TFIDF = f"""WITH {GRAMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT doc_id, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term), n), m AS (SELECT doc_id, sqrt(sum(v * v)) AS m FROM v GROUP BY doc_id)"""


@query(f"{TFIDF} SELECT term, round(sum(v / m), 4) AS score FROM v JOIN m USING (doc_id) GROUP BY term ORDER BY sum(v / m) DESC, term LIMIT 100")
def tfidf_topk(spark, sf_dir):
    """TXT-25."""
    docs = table(spark, sf_dir, "documents")
    weights = keywords.tfidf(keywords.grams(docs, "doc_id", F.col("text"), (1, 2), ["the", "and"]), "doc_id", docs.count(), min_df=2, sublinear=True)
    return keywords.tfidf_top(weights, 100).select("term", F.round("score", 4).alias("score"))


#: Stop words of keyphrases.
STOP = ["the", "and", "that", "with", "for", "was", "are", "les", "des", "und", "die", "que", "los"]
FIT = "IN ('a', 'n', 'p')"
STOPS = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"


def _runs(n: int) -> str:
    """SQL: runs of n words that may be phrases; the next words stand beside each word."""
    of = range(n)
    fit = [f"kind{j} {FIT} AND i{j} = i0 + {j}" for j in of] + ["NOT stop0", f"NOT stop{n - 1}"]
    return f"SELECT doc_id, {' || chr(32) || '.join(f'low{j}' for j in of)} AS phrase, [{', '.join(f'term{j}' for j in of)}] AS terms, [{', '.join(f'stop{j}' for j in of)}] AS stops FROM kl WHERE {' AND '.join(fit)}"


BESIDE = ", ".join(f"lead({c}, {j}) OVER w AS {c}{j}" for j in range(4) for c in ("i", "low", "term", "stop", "kind"))
PHRASES = f"""sent AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, i) - 1 AS s, part FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+\\s+|[\\r\\n]+'), lambda x: regexp_matches(x, '\\S')) AS parts FROM documents))),
tk AS (SELECT doc_id, s, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, s, regexp_extract_all(part, '[\\pL\\pM\\pN_]+(?:[''’.,:/&@+-][\\pL\\pM\\pN_]+)*|[^\\s\\pL\\pM\\pN_]') AS w FROM sent)),
k0 AS (SELECT doc_id, s, i, w, lower(w) AS low, CASE WHEN length(w) > 3 AND ends_with(lower(w), 's') THEN left(lower(w), -1) ELSE lower(w) END AS term, length(w) - length(regexp_replace(w, '\\pN', '', 'g')) AS nd, length(w) - length(regexp_replace(w, '\\pL', '', 'g')) AS nl,
  length(w) - length(regexp_replace(w, '[!-/:-@\\[-`{{-~]', '', 'g')) AS np, length(w) - length(regexp_replace(w, '\\p{{Lu}}', '', 'g')) AS nu FROM tk WHERE regexp_matches(w, '^[\\pL\\pM\\pN_]')),
k AS MATERIALIZED (SELECT doc_id, s, i, low, term, low IN {STOPS} OR term IN {STOPS} OR length(regexp_replace(term, '[!-/:-@\\[-`{{-~]', '', 'g')) < 3 AS stop,
  CASE WHEN regexp_full_match(replace(w, ',', ''), '[0-9]+\\.?[0-9]*|\\.[0-9]+') THEN 'd' WHEN (nd > 0 AND nl > 0) OR (nd = 0 AND nl = 0) OR np > 1 THEN 'u' WHEN nu = length(w) THEN 'a' WHEN nu = 1 AND length(w) > 1 AND regexp_matches(w, '^\\p{{Lu}}') AND i > 0 THEN 'n' ELSE 'p' END AS kind FROM k0),
kl AS MATERIALIZED (SELECT doc_id, {BESIDE} FROM k WINDOW w AS (PARTITION BY s ORDER BY i)),
tm AS (SELECT term, count(*) AS tf, count(*) FILTER (kind = 'a') AS caps, count(*) FILTER (kind = 'n') AS names, count(DISTINCT s) AS spread, bool_or(stop) AS stop, median(DISTINCT s) AS mid FROM k GROUP BY term),
e AS MATERIALIZED (SELECT term0 AS a, term1 AS b, count(*) AS n FROM kl WHERE kind0 {FIT} AND kind1 {FIT} AND i1 = i0 + 1 GROUP BY ALL),
el AS (SELECT b AS term, count(*) AS d, sum(n) AS n FROM e GROUP BY b), er AS (SELECT a AS term, count(*) AS d, sum(n) AS n FROM e GROUP BY a),
mx AS (SELECT max(tf) AS m, avg(tf) + stddev_pop(tf) AS ms FROM tm WHERE NOT stop), ns AS (SELECT count(*) AS n FROM sent),
rel AS (SELECT tm.*, ms, ns.n AS ns, 0.5::DOUBLE + coalesce(el.d / el.n, 0) * (tf / m) + coalesce(el.d, 0) / m + (0.5::DOUBLE + coalesce(er.d / er.n, 0) * (tf / m) + coalesce(er.d, 0) / m) AS rel FROM tm LEFT JOIN el USING (term) LEFT JOIN er USING (term), mx, ns),
h AS MATERIALIZED (SELECT term, tf, CASE WHEN NOT stop THEN ln(ln(3 + mid)) * rel / (greatest(caps, names) / (1 + ln(tf)) + tf / ms / rel + spread / ns / rel) END AS h FROM rel),
ph AS (SELECT phrase, count(*) AS tf, count(DISTINCT doc_id) AS df, any_value(terms) AS terms, any_value(stops) AS stops FROM ({" UNION ALL ".join(map(_runs, range(1, 5)))}) GROUP BY phrase),
pt AS (SELECT phrase, unnest(terms) AS term, unnest(stops) AS stop, unnest([NULL] || terms[: len(terms) - 1]) AS bef, unnest(terms[2 :] || [NULL]) AS aft, generate_subscripts(terms, 1) AS i FROM ph),
pw AS (SELECT phrase, i, CASE WHEN NOT pt.stop THEN h.h END AS h, CASE WHEN pt.stop THEN coalesce(e1.n / hb.tf, 0) * coalesce(e2.n / ha.tf, 0) END AS tied FROM pt JOIN h ON h.term = pt.term LEFT JOIN e e1 ON e1.a = bef AND e1.b = pt.term LEFT JOIN h hb ON hb.term = bef LEFT JOIN e e2 ON e2.a = pt.term AND e2.b = aft LEFT JOIN h ha ON ha.term = aft),
ys AS (SELECT phrase, ph.tf, ph.df, p / nullif((t + 1) * ph.tf, 0) AS raw FROM (SELECT phrase, list_reduce(list(coalesce(h, 2 - tied) ORDER BY i), lambda a, x: a * x) AS p, list_reduce(list(coalesce(h, tied - 1) ORDER BY i), lambda a, x: a + x) AS t FROM pw GROUP BY phrase) JOIN ph USING (phrase)),
yr AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY raw, phrase) AS n FROM ys WHERE raw IS NOT NULL QUALIFY n <= 5000),
yf AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS led, NULL::VARCHAR AS phrase, NULL::BIGINT AS tf, NULL::BIGINT AS df, NULL::DOUBLE AS raw
  UNION ALL
  SELECT yr.n, CASE WHEN near = 0 THEN list_append(led, yr.phrase) ELSE led END, CASE WHEN near = 0 THEN yr.phrase END, yr.tf, yr.df, yr.raw
  FROM (SELECT yr.*, led, len(list_filter(led, lambda x: 1 - levenshtein(yr.phrase, x) / greatest(length(yr.phrase), length(x)) > 0.75)) AS near FROM yf JOIN yr ON yr.n = yf.n + 1 WHERE len(led) < 80) yr),
yk AS (SELECT phrase AS term, tf, df, 1 / (1 + raw) AS yake FROM yf WHERE phrase IS NOT NULL)"""


@query(f"WITH RECURSIVE {PHRASES} SELECT term, tf AS total_frequency, df AS document_frequency, round(yake, 6) AS score FROM yk")
def keyphrase_topk(spark, sf_dir):
    """TXT-26: the 80 best phrases of up to 4 words by the statistics of the corpus as one text, near ones folded."""
    found = yake.keyphrases(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), STOP)
    return found.select("term", F.col("tf").alias("total_frequency"), F.col("df").alias("document_frequency"), F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {GRAMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), f AS (SELECT term, sum(tf) AS tf, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT doc_id, tf.term, tf.tf * (ln((1 + n) / (1 + f.df)) + 1) AS v FROM tf JOIN f USING (term), n), m AS (SELECT doc_id, sqrt(sum(v * v)) AS m FROM v GROUP BY doc_id),
t AS (SELECT term, sum(v / m) AS score FROM v JOIN m USING (doc_id) GROUP BY term ORDER BY round(sum(v / m), 6) DESC, term LIMIT 80),
o AS (SELECT term FROM f ORDER BY tf DESC, term LIMIT 120),
{PHRASES},
c AS (SELECT term, coalesce(f.tf, yk.tf) AS tf, coalesce(f.df, yk.df) AS df, score, yake, o.term IS NOT NULL AS often FROM f FULL JOIN yk USING (term) LEFT JOIN t USING (term) LEFT JOIN o USING (term) WHERE t.term IS NOT NULL OR o.term IS NOT NULL OR yk.term IS NOT NULL)
SELECT term, tf::BIGINT AS total_frequency, df AS document_frequency, round(0.35 * coalesce(score / max(score) OVER (), 0) + 0.25 * coalesce(yake / nullif(greatest(max(yake) OVER (), 0), 0), 0) + 0.15 * tf / max(tf) OVER () + 0.15 * df / n + 0.10 * ((score IS NOT NULL)::INT + (yake IS NOT NULL)::INT + often::INT) / 3, 6) AS composite_score FROM c, n""")
def keyword_composite(spark, sf_dir):
    """TXT-28, WIN-06: candidates are the 120 most frequent terms, the 80 best by TF-IDF and the 80 best keyphrases, which
    bring their own counts where they are no runs of the other two's tokens."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    terms = written(keywords.grams(docs, "doc_id", F.col("text"), (1, 2), ["the", "and"]).groupBy("doc_id", "term").agg(F.count("*").alias("tf")))
    counts = written(terms.groupBy("term").agg(F.sum("tf").alias("total_frequency"), F.count("*").alias("document_frequency")))
    best = keywords.tfidf_of(terms, "doc_id", n).groupBy("term").agg(F.sum("weight").alias("tfidf")).orderBy(F.desc(F.round("tfidf", 6)), "term").limit(80)
    often = counts.orderBy(F.desc("total_frequency"), "term").limit(120).select("term", F.lit(True).alias("often"))
    phrases = yake.keyphrases(docs, "doc_id", F.col("text"), STOP).withColumnRenamed("score", "yake")
    chosen = cut(best.join(often, "term", "full_outer").join(phrases, "term", "full_outer"))  # 280 candidates
    # All candidates stay, those without counts of their own, too: the few are broadcast on the side that is not kept whole.
    own = counts.join(F.broadcast(chosen.select("term")), "term", "left_semi")
    found = chosen.join(own, "term", "left").select("term", "tfidf", "yake", "often", *(F.coalesce(a, b).alias(a) for a, b in (("total_frequency", "tf"), ("document_frequency", "df"))))
    return keywords.composite(found, n)


ROUNDS = f"WITH w AS ({TOK}), t AS (SELECT source, unnest(w) AS term FROM w), c AS (SELECT source, term, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT source, term, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS k FROM c QUALIFY k <= 30)"


def _rounds(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    c = docs.select("source", F.explode(T.tokens(F.col("text"), ["the", "and"])).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "term"))).where("k <= 30")


@query(f"{ROUNDS}, s AS (SELECT source, list(term) AS ts FROM r GROUP BY source), l AS (SELECT source, ts, lag(ts) OVER (ORDER BY source) AS b FROM s) SELECT source, CASE WHEN b IS NOT NULL THEN round(len(list_intersect(ts, b)) / len(list_distinct(list_concat(ts, b))), 6) END AS similarity FROM l")
def kw_convergence(spark, sf_dir):
    """ITR-02, WIN-07: sources stand for rounds."""
    sets = _rounds(spark, sf_dir).groupBy("source").agg(F.collect_list("term").alias("terms"))
    return keywords.convergence(sets, "source", "terms").select("source", F.round("similarity", 6).alias("similarity"))


@query(f"{ROUNDS} SELECT term, min(source) AS first_round FROM r GROUP BY term")
def kw_first_seen(spark, sf_dir):
    """ITR-05."""
    return keywords.first_seen(_rounds(spark, sf_dir), "source", "term")


ANCHORS = ["that", "les"]


@query(f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_distinct(w) AS w FROM ({TOK})),
r AS (SELECT -1 AS round, []::VARCHAR[] AS terms, false AS settled
  UNION ALL
  SELECT round + 1, new, round >= 0 AND len(list_intersect(new, terms)) / len(list_distinct(list_concat(new, terms))) >= 0.85
  FROM (SELECT round, terms, list(term ORDER BY n DESC, term) AS new FROM (
    SELECT round, terms, term, count(*) AS n, row_number() OVER (PARTITION BY round ORDER BY count(*) DESC, term) AS k
    FROM (SELECT round, terms, unnest(w.w) AS term FROM r JOIN w ON list_has_any(w.w, list_concat({lit(ANCHORS)}, terms)[1 : 30]) WHERE NOT settled AND round < 4) GROUP BY round, terms, term)
    WHERE k <= 30 GROUP BY round, terms))
SELECT round, place, terms[place] AS term, settled FROM (SELECT round, terms, settled, unnest(range(1, len(terms) + 1)) AS place FROM r WHERE round >= 0)""")
def keyword_loop(spark, sf_dir):
    """ITR-01, ITR-04: rounds of queries, the documents that they find and the words of these, until the words settle."""
    from newsloom.operators.rounds import augment

    words = cut(table(spark, sf_dir, "documents").select(F.array_distinct(T.tokens(F.col("text"), ["the", "and"])).alias("w")))

    def step(_: int, queries: list[str]) -> DataFrame:
        return words.where(F.arrays_overlap("w", F.array(*map(F.lit, queries)))).select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("score"))

    known, settled = augment(step, ANCHORS, most=30)
    rows = [(k, place, term, settled and k == len(known) - 1) for k, terms in enumerate(known) for place, term in enumerate(terms, 1)]
    return spark.createDataFrame(rows, "round long, place long, term string, settled boolean")


STEM = "CASE WHEN ends_with(term, 'ies') AND length(term) > 4 THEN left(term, -3) || 'y' WHEN ends_with(term, 's') AND NOT ends_with(term, 'ss') AND length(term) > 3 THEN left(term, -1) ELSE term END"


@query(f"{ROUNDS}, f AS (SELECT source, term, r.n, {STEM} AS form FROM r), b AS (SELECT term, sum(n) AS score, form FROM f WHERE source >= 'src5' AND length(term) >= 4 AND form NOT IN (SELECT form FROM f WHERE source < 'src5') GROUP BY ALL) SELECT term, score::BIGINT AS score FROM b QUALIFY row_number() OVER (PARTITION BY form ORDER BY score DESC, term) = 1 ORDER BY score DESC, term LIMIT 50")
def kw_novel(spark, sf_dir):
    """ITR-03, ITR-08, JN-05: the best candidates whose normal form no earlier round has; sources stand for rounds."""
    r = _rounds(spark, sf_dir)
    late = r.where("source >= 'src5'").groupBy("term").agg(F.sum("n").alias("score"))
    return keywords.novel(late, r.where("source < 'src5'").select("term"), least_words=1, top=50)


P = PAD.format("text")
W = PROFILE
DAY = "'20' || (10 + doc_id % 20) || '-05-01T00:00'"


@query(f"""WITH l AS (SELECT doc_id, {DAY} AS day, lower(coalesce(text, '')) AS low FROM documents),
n AS (SELECT doc_id, day, contains(low, '###') AS rej, {many('low', W.product)} AS a, {many('low', W.adulteration)} AS b, {many('low', W.action)} AS c, {word('low', 'of')} AS pl, {word('low', 'are')} AS ind FROM l),
s AS (SELECT *, round(least(1.0, least(a * 0.25, 0.30) + least(b * 0.20, 0.25) + least(c * 0.15, 0.20) + least(0.10 + CASE WHEN pl THEN 0.05 ELSE 0 END, 0.15) + CASE WHEN left(day, 10) BETWEEN '2021-01-01' AND '2026-12-31' THEN 0.10 ELSE 0 END), 4) AS t FROM n)
SELECT doc_id, round(CASE WHEN rej OR NOT ind OR a = 0 THEN 0.0 WHEN b + c = 0 THEN 0.05 ELSE t END::DOUBLE, 4) AS score, CASE WHEN rej OR NOT ind OR a = 0 OR b + c = 0 OR t < 0.25 THEN 'irrelevant' WHEN t >= 0.55 THEN 'relevant' ELSE 'maybe_relevant' END AS label FROM s""")
def lexicon_score(spark, sf_dir):
    """TXT-01, TXT-05, TXT-06: over all documents, with a day for each."""
    day = F.concat(F.lit("20"), (10 + F.col("doc_id") % 20).cast("string"), F.lit("-05-01T00:00"))
    r = relevance.score(PROFILE, F.lit(""), F.col("text"), F.lit(""), day)
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", F.round("r.score", 4).alias("score"), "r.label")


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {word(chr(108), t)} THEN {t!r} END' for t in ['with', 'that', 'en', 'für', 'été', 'the'])}], lambda x: x IS NOT NULL), '; ') AS hits FROM (SELECT doc_id, lower(coalesce(text, '')) AS l FROM documents)")
def word_hits(spark, sf_dir):
    """TXT-01: whole words of any script, in the order of the list."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.terms_in(F.col("text"), ["with", "that", "en", "für", "été", "the"]), "; ").alias("hits"))


STRIP = "trim(regexp_replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), chr(160), ' '), '\\s+', ' ', 'g'))"
NEAR = "regexp_matches(t, '(thing|that).{{0,90}}(with|from)|(with|from).{{0,90}}(thing|that)')".replace("{{", "{").replace("}}", "}")
CLOSE = f"""c AS (SELECT doc_id, clean, lower(clean) AS low, head FROM (SELECT doc_id, {STRIP.format(f"{TITLE} || ' ' || coalesce(text, '') || ' ' || {SITE}")} AS clean, {STRIP.format(f"{TITLE} || ' ' || {SITE}")} AS head FROM documents)),
pr AS (SELECT doc_id, li, l, len(parts) AS m, unnest(range(1, len(parts) + 1)) AS i, unnest(list_transform(parts, lambda x: length(x))) AS k FROM (SELECT doc_id, li, l, string_split(low, l) AS parts FROM c, (VALUES (1, 'that'), (2, 'thing')) t(li, l) WHERE contains(low, l))),
pl AS (SELECT doc_id, li, l, i, p, clean FROM (SELECT doc_id, li, l, i, m, (sum(k) OVER (PARTITION BY doc_id, li ORDER BY i) + (i - 1) * length(l) + 1)::BIGINT AS p FROM pr) JOIN c USING (doc_id) WHERE i < m),
sn AS (SELECT doc_id, li, i, substring(clean, greatest(1, p - 90), p + length(l) + 90 - greatest(1, p - 90)) AS s FROM pl),
ev AS (SELECT doc_id, min_by(trim(s), li * 1e9 + ri * 1e7 + i) AS evidence FROM (SELECT *, 1 AS ri FROM sn WHERE {word('lower(s)', 'with')} UNION ALL SELECT *, 2 FROM sn WHERE {word('lower(s)', 'from')}) GROUP BY doc_id)"""


@query(f"WITH {CLOSE} SELECT c.doc_id, coalesce(evidence, '') AS evidence FROM c LEFT JOIN ev USING (doc_id)")
def proximity_evidence(spark, sf_dir):
    """TXT-17, JN-16: the text around the first product that has a signal as a word nearby."""
    clean = T.strip_markup(F.concat_ws(" ", title(), F.coalesce("text", F.lit("")), site()))
    docs = table(spark, sf_dir, "documents").select("doc_id", clean.alias("clean"))
    return docs.select("doc_id", T.proximity_evidence(F.col("clean"), PROFILE.product, PROFILE.adulteration + PROFILE.action).alias("evidence"))


@query(f"""WITH {CLOSE},
n AS (SELECT c.doc_id, clean, low, head, coalesce(evidence, '') AS ev, {some('low', W.product)} AS a, {some('low', W.adulteration + W.action)} AS b, {some('low', W.non_food)} AS nf, {some('low', W.business)} AS bu, {some('low', W.out_of_scope)} AS oo FROM c LEFT JOIN ev USING (doc_id)),
k AS (SELECT *, CASE WHEN nf AND NOT a THEN 1 WHEN contains(low, 'is the of') THEN 2 WHEN oo AND NOT a THEN 3 WHEN bu AND NOT b THEN 4 WHEN contains(low, 'the that') THEN 5 WHEN a AND b AND ev <> '' AND contains(head, ev) THEN 6 WHEN a AND b AND ev <> '' THEN 7 WHEN a AND b THEN 8 WHEN a THEN 9 WHEN b THEN 10 ELSE 11 END AS k FROM n)
SELECT doc_id, ['non_food_oil', 'adulterant', 'adjacent_or_unclear', 'adjacent_or_unclear', 'adulterated_product', 'adulterated_product', 'adulterated_product', 'adjacent_or_unclear', 'adjacent_or_unclear', 'adjacent_or_unclear', 'adjacent_or_unclear'][k] AS role,
 ['irrelevant', 'irrelevant', 'irrelevant', 'irrelevant', 'relevant', 'relevant', 'manual_review', 'manual_review', 'irrelevant', 'irrelevant', 'irrelevant'][k] AS label, [0.95, 0.90, 0.85, 0.85, 0.94, 0.82, 0.74, 0.55, 0.70, 0.70, 0.80][k]::DOUBLE AS confidence,
 CASE k WHEN 1 THEN {beside(W.non_food)} WHEN 2 THEN {around("instr(low, 'is the of')", 9, 80, 100)} WHEN 3 THEN {beside(W.out_of_scope)} WHEN 4 THEN {beside(W.business)} WHEN 5 THEN {around("instr(low, 'the that')", 8, 80, 100)} WHEN 6 THEN ev WHEN 7 THEN ev
  WHEN 8 THEN {beside(W.product + W.adulteration + W.action)} WHEN 9 THEN {beside(W.product)} WHEN 10 THEN {beside(W.adulteration + W.action)} ELSE '' END AS evidence FROM k""")
def cascade_label(spark, sf_dir):
    """TXT-07, TXT-16, TXT-18: role, label, confidence and evidence of all documents, with a title and a URL."""
    r = relevance.cascade(PROFILE, title(), F.col("text"), site())
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.role", "r.label", F.col("r.confidence").cast("double").alias("confidence"), "r.evidence")


@query("""WITH l AS (SELECT doc_id, ' ' || replace(lower(text), '-', ' ') || ' ' AS t FROM documents),
h AS (SELECT doc_id, (contains(t, 'that') OR contains(t, 'thing')) AS a, contains(t, 'with') AS b, contains(t, 'from') AS c, contains(t, 'are') AS i, contains(t, ' which ') AS x, contains(t, 'for') AS bu, """ + NEAR + """ AS n FROM l)
SELECT doc_id, 3 * a::INT + 4 * b::INT + 2 * c::INT + 2 * i::INT - 6 * x::INT - 5 * bu::INT + 4 * n::INT AS points, CASE WHEN a AND i AND NOT x AND NOT bu AND n AND b THEN 'strict_rescue_candidate' WHEN a AND i AND NOT x AND n THEN 'possible_review' ELSE 'confirm_metadata_drop' END AS decision FROM h""")
def audit_score(spark, sf_dir):
    """TXT-03, TXT-09."""
    return table(spark, sf_dir, "documents").select("doc_id", relevance.audit(PROFILE, F.col("text")).alias("r")).select("doc_id", "r.points", "r.decision")


BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"WITH d AS (SELECT doc_id, trim(left(text, 60), {BLANK}) AS t, trim(text, {BLANK}) AS b FROM documents) SELECT doc_id, t AS title_only, md5(b) AS body_only, md5(left(t || chr(10) || chr(10) || b, 15000)) AS title_and_body, md5(trim(t || chr(10) || chr(10) || b, {BLANK})) AS whole, length(left(t || chr(10) || chr(10) || b, 15000)) AS n FROM d")
def representations(spark, sf_dir):
    """TXT-41: title, body, both within 15,000 characters, and both whole."""
    t, b = title(), F.coalesce("text", F.lit(""))
    both = windows.title_and_body(t, b)
    return table(spark, sf_dir, "documents").select("doc_id", T.trimmed(t).alias("title_only"), F.md5(T.trimmed(b)).alias("body_only"), F.md5(both).alias("title_and_body"), F.md5(windows.title_and_body(t, b, None)).alias("whole"), F.length(both).cast("long").alias("n"))


@query()
def keyword_windows(spark, sf_dir):
    """TXT-21, TXT-40, TXT-42, TXT-43, WIN-04: sentence splitting is beyond the twin's regular expressions; tested against plain loops."""
    t = F.col("text")
    docs, s = table(spark, sf_dir, "documents").select("doc_id", "text", windows.sentences(t).alias("parts")), F.col("parts")
    return docs.select("doc_id", windows.title_windows(title(), t, ["that", "with"], parts=s).alias("windows"), windows.product_windows(title(), t, ["that"], parts=s).alias("product"), windows.context(t, "with").alias("context"))


SCORED = "WITH s AS (SELECT l.doc_id, l.quality, l.toxic, ((d.n_chars * 7919) % 1009) / 1009.0 AS score, ((d.n_chars * 104729) % 997) / 997.0 AS other, d.source, d.lang FROM labels l JOIN documents d USING (doc_id))"


def scored(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (((F.col("n_chars") * 7919) % 1009) / 1009.0).alias("score"), (((F.col("n_chars") * 104729) % 997) / 997.0).alias("other"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


@query(SCORED + " , c AS (SELECT count(*) FILTER (quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (quality = 0 AND score >= 0.5) AS fp, count(*) FILTER (quality = 1 AND score < 0.5) AS fn, count(*) FILTER (quality = 0 AND score < 0.5) AS tn FROM s) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(tp / (tp + fp), 4) AS \"precision\", round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c")
def label_metrics(spark, sf_dir):
    """AGG-21, ML-08."""
    return metrics.confusion(scored(spark, sf_dir), F.col("quality"), (F.col("score") >= 0.5).cast("int"))


@query(SCORED + " , r AS (SELECT quality, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS r FROM s) SELECT round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS roc_auc FROM r")
def auc(spark, sf_dir):
    """ML-09."""
    return metrics.roc_auc(scored(spark, sf_dir), "quality", "score")


@query(SCORED + " , g AS (SELECT score, sum(quality) AS p, count(*) AS n FROM s GROUP BY score), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM g) SELECT round(sum(p * tp / k) / sum(p), 6) AS average_precision FROM c")
def avg_precision(spark, sf_dir):
    """ML-09."""
    return metrics.average_precision(scored(spark, sf_dir), "quality", "score")


@query("WITH h AS (SELECT doc_id, quality, md5('42-' || doc_id) AS h FROM labels) SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality, left(h, 2) ORDER BY h) + ('0x' || left(h, 2))::INT) % 5)::INT AS fold FROM h")
def stratified_folds(spark, sf_dir):
    """ML-07."""
    return metrics.stratified_folds(table(spark, sf_dir, "labels"), "doc_id", "quality")


@query("SELECT label, i - 1 AS dim, round(avg(x), 4) AS mean, round(max(x), 4) AS max FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def embedding_pool(spark, sf_dir):
    """ML-18, WIN-08."""
    p = metrics.pooled(table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "label", "embedding")
    each = p.select("label", F.posexplode(F.arrays_zip("mean", "max")).alias("dim", "z"))
    return each.select("label", F.col("dim").cast("long").alias("dim"), F.round("z.mean", 4).alias("mean"), F.round("z.max", 4).alias("max"))


@query(f"WITH m AS (SELECT page_id, {CANON.format('url')} AS domain FROM pages), s AS (SELECT DISTINCT domain FROM m WHERE page_id % 3 = 0) SELECT page_id FROM m WHERE domain NOT IN (SELECT domain FROM s)")
def url_seen_antijoin(spark, sf_dir):
    """JN-05, JN-06, ITR-07: pages whose host no seen page has; every third page stands for a seen one."""
    m = table(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))
    return m.join(m.where("page_id % 3 = 0").select("domain").distinct(), "domain", "left_anti").select("page_id")


@query("SELECT source, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def label_crosstab(spark, sf_dir):
    """AGG-13 in long form."""
    return scored(spark, sf_dir).groupBy("source", "quality").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT doc_id, lower(left(text, 60) || ' ' || text) AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, 'xyz') OR contains(t, 'which') THEN 0.0 ELSE round(((contains(t, 'thing') OR contains(t, 'with'))::INT + contains(t, 'eran')::INT + contains(t, 'for')::INT) / 3, 6) END AS score FROM l")
def substring_score(spark, sf_dir):
    """TXT-13, TXT-14, FLT-05."""
    from newsloom.operators.rounds import substring_score as score

    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score(F.left(t, F.lit(60)), t, ["thing and with", "eran", "for"], ["xyz", "which"]), 6).alias("score"))


@query("WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages) SELECT page_id FROM p WHERE NOT regexp_matches(lower(url || ' ' || t), '(?:/es/)|(?:page=2)') AND NOT contains(lower(url), '#top') AND (length(t) <= 15 OR regexp_matches(lower(t), 'th|en'))")
def url_prefilter(spark, sf_dir):
    """FLT-03, FLT-06."""
    named = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").where(relevance.url_looks_relevant(F.col("url"), named, ["/es/", "page=2"], ["#top"], ["th", "en"])).select("page_id")


@query()
def html_fields(spark, sf_dir):
    """HTM-01..HTM-05: the standard parser's fields, the title of the head where a page says nothing else, and the way in
    which the text was found; tested on pages by hand."""
    from newsloom.operators import html

    named = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", html.overlay(F.col("fields.title"), named).alias("title"), "fields.canonical_url", "published_day", "fields.method", "extraction_status")
