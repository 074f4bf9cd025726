"""One query for each operator of this folder, over its whole tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import chunk_dedup, decontaminate, filter_audit, licenses, minhash, packing, prefix_trie, quality, simhash, token_files, url_trie, warc, wrappers
from newsloom.llm.common import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Fixed values of the URL query: (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URL_SQL = """
WITH rest AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path"""


@query(URL_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trie.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query()
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op1_minhash_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
run AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item FROM run JOIN win USING (n, s)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


@query(LEAKS_SQL)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, n, max(page_id) AS m FROM p GROUP BY d, n)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN p.n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.n >= 1000 AND page_id <> m THEN m END AS refers_to FROM p JOIN g USING (d, n)"""


@query(WARC_SQL)
def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query()
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.report(table(spark, sf_dir, "documents"))


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
first AS (SELECT x, min(doc_id) AS first FROM t GROUP BY x),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT t.*, first, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM t JOIN first USING (x)),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(x))::INT + 8 * regexp_matches(x, '[#$%&*|]')::INT
  + 16 * (first IS NOT NULL AND (doc_id IS NULL OR doc_id > first))::INT AS mask FROM w LEFT JOIN marks USING (doc_id)),
g AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY part, mask),
l(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM l p, l q, l r, l s, l t WHERE (p.b | q.b | r.b | s.b | t.b) = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before FROM (SELECT *, unnest(range(1, 6))::INT AS step FROM o)),
c AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER ((mask & (before | own)) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & own) > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER ((mask & before) > 0 AND (mask & own) > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & own) > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & own) > 0), 0)::BIGINT AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE own, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c"""


@query(AUDIT_SQL)
def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


TRIE_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'d': sha256(length(r)::VARCHAR || ':' || r || x), 'n': length(x)} ORDER BY turn NULLS FIRST, sha256(length(r)::VARCHAR || ':' || r || x)) AS l FROM t GROUP BY conv_id),
bits AS (SELECT conv_id, l, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda j: (ascii(c)::BIGINT >> j) & 1))) AS b FROM own),
h AS (SELECT conv_id, l, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda x, y: xor(x >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295) % 6 AS h FROM bits),
full_ AS (SELECT h.conv_id, list_concat(coalesce(b.l[1 : h.h], []), h.l[h.h + 1 :]) AS l FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, len(l) = d AS ends, CASE WHEN d > 0 THEN l[d].n ELSE 0 END AS n, sha256(array_to_string(list_transform(l[1 : d], lambda e: e.d), ',')) AS k,
  sha256(array_to_string(list_transform(l[1 : d - 1], lambda e: e.d), ',')) AS up FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM full_)),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, any_value(CASE WHEN d > 0 THEN up END) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
own_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
above AS (SELECT q.k AS node, o.n_children = 0 AS leaf, o.saved FROM own_ o JOIN p q ON q.conv_id = o.conv_id AND q.d <= o.d),
rolled AS (SELECT node AS k, count_if(leaf) AS n_leaves, sum(saved) AS saved FROM above GROUP BY node)
SELECT o.conv_id, o.d AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, r.n_leaves::BIGINT AS n_leaves, r.saved::BIGINT AS saved_tokens, o.ends_sha256
FROM own_ o JOIN rolled r USING (k) LEFT JOIN nodes u ON u.k = o.up"""


@query(TRIE_SQL)
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations"))
