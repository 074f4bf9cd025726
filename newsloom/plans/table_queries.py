"""Queries over the relational tables: merges, aggregations, orders, sets and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import merge, relevance
from newsloom.plans.catalogue import query
from newsloom.plans.report_queries import ranked
from newsloom.sources.tables import table
from newsloom.streaming import events as streams


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts::DATE)::VARCHAR AS first_day, max(ts::DATE)::VARCHAR AS last_day, count(*) FILTER (value > 50) AS large FROM events GROUP BY 1")
def event_summary(spark, sf_dir):
    """AGG-02, AGG-17."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min(F.to_date("ts")).cast("string").alias("first_day"), F.max(F.to_date("ts")).cast("string").alias("last_day"), F.count_if(F.col("value") > 50).alias("large"))


PLAN = [("view", "core"), ("click", "core"), ("share", "extra")]


@query("WITH p(event_type, family) AS (VALUES ('view', 'core'), ('click', 'core'), ('share', 'extra')), a AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, coalesce(family, 'not_in_plan') AS family, coalesce(n, 0) AS n, family IS NOT NULL AS in_plan FROM p FULL JOIN a USING (event_type)")
def plan_vs_actual(spark, sf_dir):
    """JN-03, JN-04."""
    plan = spark.createDataFrame(PLAN, "event_type string, family string")
    actual = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return merge.plan_against_actual(plan, actual, "event_type", "n").select("event_type", F.coalesce("family", F.lit("not_in_plan")).alias("family"), "n", "in_plan")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark, sf_dir):
    """SNK-02, WIN-02: the first half of the events as base, all as the batch."""
    e = table(spark, sf_dir, "events")
    return merge.upsert_latest(e.where("event_id % 2 = 0"), e, ["user_id"], "ts", "event_id").select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, event_id) AS rn FROM events) WHERE rn = 1 OR event_id % 2 = 0")
def insert_ignore(spark, sf_dir):
    """SNK-01, JN-14: even events are there; of the others the first of each new user comes in."""
    e = table(spark, sf_dir, "events")
    return merge.insert_new(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], F.col("event_id")).select("user_id", "event_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND value IS NOT NULL THEN 'patched' ELSE event_type END AS event_type FROM events WHERE NOT (event_type = 'error' AND event_id % 2 = 0)")
def patch_and_delete(spark, sf_dir):
    """SNK-03, SNK-04, SNK-05, SNK-06."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    patched = merge.patch(e, e.where("event_id % 3 = 0 and value is not null").select("event_id", F.lit("patched").alias("event_type")), ["event_id"], ["event_type"])
    return merge.delete_keys(patched, e.where("event_type = 'error' and event_id % 2 = 0").select("event_id"), ["event_id"]).select("event_id", "event_type")


VOTES = "v AS (SELECT o_custkey AS k, o_orderstatus AS label, o_orderpriority AS s FROM orders)"


@query(f"WITH {VOTES} SELECT k, array_to_string(list_sort(list(DISTINCT label)), '; ') AS labels, array_to_string(list_sort(list(DISTINCT s)), '; ') AS sources, count(DISTINCT label) > 1 AS conflict FROM v GROUP BY k")
def conflict_split(spark, sf_dir):
    """JN-13, DD-14: customers whose orders disagree on their status."""
    votes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("s"))
    agreed, conflicts = merge.merge_labels(votes, "k", "label", "s")
    return agreed.select("k", F.col("label").alias("labels"), "sources", F.lit(False).alias("conflict")).unionByName(conflicts.select("k", F.array_join("labels", "; ").alias("labels"), "sources", F.lit(True).alias("conflict")))


@query("WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS fs FROM orders) SELECT o_orderkey, f AS first_key, fs <> o_orderstatus AS differs FROM r WHERE rn > 1")
def duplicate_report(spark, sf_dir):
    """DD-13, DD-14, WIN-01: orders of a customer after the first one, beside it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    _, rest = merge.duplicates_of_first(o, ["o_custkey"], F.col("o_orderkey"))
    return rest.select("o_orderkey", F.col("first.o_orderkey").alias("first_key"), (F.col("first.o_orderstatus") != F.col("o_orderstatus")).alias("differs"))


@query("""WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer), s AS (SELECT s_nationkey, min_by(s_name, s_suppkey) AS s FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1), n AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0), t AS (SELECT lower(c_mktsegment) AS t, min_by(c_name, c_custkey) AS s FROM customer GROUP BY 1)
SELECT c_custkey, coalesce(n_name, s.s, t.s) AS found FROM c LEFT JOIN n ON n_nationkey = c_nationkey LEFT JOIN s ON s_nationkey = c_nationkey LEFT JOIN t ON t.t = lower(c_mktsegment)""")
def fallback_join(spark, sf_dir):
    """JN-08, JN-09: the nation's name where its key is even, else its first supplier, else the first of equal titles."""
    none, key = F.lit(None).cast("string"), F.col("c_nationkey").cast("string")
    c = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("string").alias("a"), none.alias("b"), none.alias("c"), F.col("n_name").alias("found"))
    supplier = table(spark, sf_dir, "supplier").where("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("id"), none.alias("a"), F.col("s_nationkey").cast("string").alias("b"), none.alias("c"), F.col("s_name").alias("found"))
    titles = c.select(F.col("c_custkey").alias("id"), none.alias("a"), none.alias("b"), F.lower("c_mktsegment").alias("c"), F.col("c_name").alias("found"))
    every = nation.unionByName(supplier).unionByName(titles)
    steps = [(F.col("k"), F.col("a")), (F.col("k"), F.col("b")), (F.col("t"), F.col("c"))]
    return merge.fallback_join(c.select("c_custkey", key.alias("k"), F.lower("c_mktsegment").alias("t")), every, steps, "found", "id").select("c_custkey", "found")


@query("SELECT o.o_orderkey, c.c_name AS first_name, n.n_name AS last_name FROM orders o LEFT JOIN customer c ON c_custkey = o_custkey LEFT JOIN (SELECT n_regionkey, max_by(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1) n ON n_regionkey = o_custkey % 5")
def lookups(spark, sf_dir):
    """JN-01 (last wins), JN-02 (first wins), JN-07."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_custkey") % 5).cast("int").alias("n_regionkey"))
    first = merge.keep_first(table(spark, sf_dir, "customer"), ["c_custkey"], F.col("c_name"))
    last = merge.keep_last(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey").withColumnRenamed("n_name", "last_name")
    out = merge.look_up(merge.look_up(o, first, ["c_custkey"], ["c_name"]), last, ["n_regionkey"], ["last_name"])
    return out.select("o_orderkey", F.col("c_name").alias("first_name"), "last_name")


@query("WITH f AS (SELECT * FROM (VALUES (1, 'oil'), (2, 'ghee'), (3, 'milk')) t(i, a)), d AS (SELECT n_nationkey AS j, lower(n_name) AS b FROM nation) SELECT row_number() OVER (ORDER BY i, j) AS n, a || ' ' || b AS q, '(' || a || ' OR \"' || a || '-' || b || '\")' AS boolean FROM f, d ORDER BY n LIMIT 60")
def query_product(spark, sf_dir):
    """JN-18, TXT-35, WIN-03: a list of literals by a dimension of fixed size, numbered in order."""
    food = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in ((1, "oil"), (2, "ghee"), (3, "milk"))))
    both = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("j"), F.lower("n_name").alias("b"), F.explode(food).alias("f")).select("f.i", "f.a", "j", "b")
    first = ranked(both, 60, F.col("i"), F.col("j"))
    return first.select(F.col("place").alias("n"), F.concat_ws(" ", "a", "b").alias("q"), F.concat(F.lit("("), "a", F.lit(' OR "'), "a", F.lit("-"), "b", F.lit('")')).alias("boolean"))


@query("SELECT left(o_orderdate::VARCHAR, 4) AS year, count(*) AS total, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1")
def year_pivot(spark, sf_dir):
    """AGG-10: totals and label counts by year, and a column for each category that there is."""
    o = table(spark, sf_dir, "orders").withColumn("year", F.date_format("o_orderdate", "yyyy"))
    pivot = o.groupBy("year").pivot("o_orderstatus").count()
    return o.groupBy("year").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent")).join(pivot, "year")


@query("SELECT source, count(*) AS n, count(*) FILTER (n_chars > 2000) AS long, count(DISTINCT lang) AS langs, round(count(*) FILTER (lang = 'en') / count(*), 6) AS english FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def source_agg(spark, sf_dir):
    """AGG-03, AGG-11."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long"), F.countDistinct("lang").alias("langs"), F.round(F.count_if(F.col("lang") == "en") / F.count("*"), 6).alias("english")).orderBy(F.desc("n"), "source").limit(10)


@query("WITH w AS (SELECT unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9&/-]*'), lambda t: length(t) >= 6)) AS term, source FROM documents) SELECT term, count(*) AS n, count(DISTINCT source) AS sources FROM w GROUP BY 1 ORDER BY n DESC, term LIMIT 50")
def list_topk(spark, sf_dir):
    """AGG-04, AGG-06: explode a list, count, top k."""
    t = table(spark, sf_dir, "documents").select("source", F.explode(T.tokens(F.col("text"), least=6)).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")).orderBy(F.desc("n"), "term").limit(50)


@query("SELECT 'o_orderstatus' AS col, count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus = 'P') AS missing, count(*) AS n FROM orders UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority IS NULL OR o_orderpriority = 'P'), count(*) FROM orders UNION ALL SELECT 'o_totalprice', count(*) FILTER (o_totalprice IS NULL), count(*) FROM orders")
def missingness(spark, sf_dir):
    """AGG-15: P stands for a missing token."""
    o = table(spark, sf_dir, "orders")
    cols = ["o_orderstatus", "o_orderpriority", "o_totalprice"]
    one = o.agg(F.count("*").alias("n"), *(F.count_if(T.missing(F.col(c).cast("string"), ["p"]).isNull()).alias(c) for c in cols))
    return one.unpivot(["n"], cols, "col", "missing").select("col", "missing", "n")


@query("SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN lang = 'en' THEN 'english' ELSE 'other' END AS category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 4) AS percent FROM documents GROUP BY 1")
def category_percent(spark, sf_dir):
    """AGG-08, AGG-14, AGG-18."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") < 500, "short").when(F.col("lang") == "en", "english").otherwise("other").alias("category"))
    g = d.groupBy("category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row for each category
    return g.select("category", "n", F.round(100 * F.col("n") / total, 4).alias("percent"))


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def funnel_rollup(spark, sf_dir):
    """Rows by language and source at every level; funnel has AGG-19's stages."""
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n")


@query("SELECT coalesce(nullif(event_type, 'view'), 'unknown') AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    """AGG-01: null counts as unknown."""
    return relevance.count_labels(table(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("view")).alias("status")), "status")


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 300 AND contains(lower(text), 'that') ORDER BY n_chars DESC, doc_id LIMIT 12 OFFSET 12")
def explorer_page(spark, sf_dir):
    """FLT-07, SRT-05, SRT-06."""
    d = table(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.col("n_chars") > 300) & F.contains(F.lower("text"), F.lit("that")))
    return d.select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(12).limit(12)


@query("SELECT event_id, ts, event_type FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts, event_id LIMIT 40")
def status_queue(spark, sf_dir):
    """SRC-02, FLT-02, SRT-03: oldest first."""
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup")).select("event_id", "ts", "event_type").orderBy("ts", "event_id").limit(40)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 20")
def label_sample(spark, sf_dir):
    """SRT-08: the first rows of each label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("k <= 20").drop("k")


@query("SELECT doc_id FROM documents ORDER BY md5('7-' || doc_id) LIMIT 25")
def audit_sample(spark, sf_dir):
    """SRT-09: a seeded sample that any engine can draw again."""
    return table(spark, sf_dir, "documents").orderBy(F.md5(F.concat_ws("-", F.lit(7), "doc_id"))).select("doc_id").limit(25)


@query("SELECT doc_id, CASE WHEN n_chars % 101 >= 80 THEN 'high' WHEN n_chars % 101 >= 60 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN n_chars % 101 >= 84 THEN 'relevant' WHEN n_chars % 101 >= 5 THEN 'review' ELSE 'irrelevant' END AS bucket FROM documents")
def score_buckets(spark, sf_dir):
    """PRJ-04, PRJ-05."""
    s = F.col("n_chars") % 101
    return table(spark, sf_dir, "documents").select("doc_id", relevance.bucket(s, 80, 60, ("high", "medium", "low")).alias("priority"), relevance.bucket(s, 84, 5).alias("bucket"))


@query("SELECT event_id, CASE WHEN event_type IN ('error') THEN 'irrelevant' WHEN event_type IN ('click', 'purchase') THEN 'pending' ELSE 'pending' END AS state, json_extract(props, '$.k')::BIGINT AS k, greatest(0, least(100, coalesce(value, 0)))::DOUBLE AS clamped FROM events")
def normalised_events(spark, sf_dir):
    """TXT-44, TXT-46, TXT-47."""
    e = table(spark, sf_dir, "events")
    state = T.tri_state(F.when(F.col("event_type") == "error", "no").otherwise(F.col("event_type")))
    return e.select("event_id", state.alias("state"), T.json_object(F.col("props"), "k long")["k"].alias("k"), T.clamp(F.col("value").cast("string"), 0, 100).alias("clamped"))


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, array_to_string(list(role ORDER BY turn), '>') AS path, max(length(text)) AS longest FROM conversations GROUP BY 1")
def conversation_rollup(spark, sf_dir):
    """AGG-12: rows collected in order; a conversation is bounded by its turns."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">").alias("path"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT conv_id, turn, max(h) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near_hit FROM (SELECT conv_id, turn, contains(lower(text), 'that')::INT AS h FROM conversations)")
def turn_neighbours(spark, sf_dir):
    """WIN-04 over turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.contains(F.lower("text"), F.lit("that")).cast("int").alias("h"))
    return c.select("conv_id", "turn", F.max("h").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 1)).alias("near_hit"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)) AS either, (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)) AS both, (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)) AS only_first, (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM labels WHERE quality = 1)) AS only_second")
def set_operations(spark, sf_dir):
    """SET-01..SET-04: union, intersection and both differences, so whether two label sets are one."""
    ls = table(spark, sf_dir, "labels")
    a, b = ls.where("quality = 1").select("doc_id"), ls.where("toxic = 1").select("doc_id")
    sets = ((a.union(b).distinct(), "either"), (a.intersect(b), "both"), (a.exceptAll(b).distinct(), "only_first"), (b.exceptAll(a).distinct(), "only_second"))
    each = [x.select(F.lit(n).alias("name")) for x, n in sets]
    return each[0].union(each[1]).union(each[2]).union(each[3]).groupBy().pivot("name", [n for _, n in sets]).count().na.fill(0)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    """STR-02: the batch twin of the stream."""
    return streams.tumbling(table(spark, sf_dir, "events"), "1 hour")


@query("WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL")
def sliding_counts(spark, sf_dir):
    """STR-03."""
    return streams.sliding(table(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '10 minutes' THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, sf_dir):
    """STR-04."""
    return streams.sessions(table(spark, sf_dir, "events"), "10 minutes")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def star_pricing(spark, sf_dir):
    """Engine breadth: a pricing summary."""
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def star_revenue(spark, sf_dir):
    """Engine breadth: a join over four tables."""
    l, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))  # noqa: E741
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("SELECT c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) QUALIFY place <= 10")
def star_idle_customers(spark, sf_dir):
    """Engine breadth: an anti-join and a rank."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return c.select("c_custkey", "c_mktsegment", F.rank().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("place")).where("place <= 10")
