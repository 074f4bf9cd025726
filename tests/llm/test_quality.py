import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    even = labels.where("doc_id % 2 = 0")
    texts = docs.join(even, "doc_id").select(F.md5("text").alias("m")).distinct()
    held = labels.where("doc_id % 2 = 1").join(docs.select("doc_id", F.md5("text").alias("m")), "doc_id").join(texts, "m", "left_anti")
    rows = quality.report(docs, even).join(held, "doc_id").collect()
    assert len(rows) > 1200
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic and r.quality]
    poor = [r for r in rows if not r.quality]
    caught = [sum(r.rejected for r in part) / len(part) for part in (toxic, clean, poor)]
    print("rejected: toxic, clean, poor", caught)
    assert caught[0] > 0.97 and caught[1] < 0.01 and caught[2] > 0.95


def test_sparse_sites_are_shrunk(spark):
    rows = [(k, f"h{k % 40}", "p") for k in range(4000)] + [(4000, "rare", "p"), (4001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string")
    rng = np.random.default_rng(1)
    labels = spark.createDataFrame([(k, int(rng.random() < (0.2 if k % 40 < 4 else 0.9)), 0) for k in range(4000)] + [(4000, 0, 0), (4001, 1, 0)], "doc_id long, quality int, toxic int")
    sites, rates = quality.posteriors(docs, labels)
    got = {r.host: r for r in sites.collect()}
    assert abs(rates["quality"] - 0.83) < 0.03 and got["h0"].path_quality < 0.35 and got["h9"].path_quality > 0.8
    assert 0.3 < got["rare"].path_quality < rates["quality"] and got[""].path_quality > rates["quality"]


def test_edges(spark):
    good, bad = "Some plain words stand here in a row, as they do. ", "Ha Ha Ha Ha Ha Ha ### $$$ *** "
    rows = [(k, (good + f"w{k} ") * 5 if k % 2 else (bad + f"x{k} ") * 5, None if k % 3 else "s", "en") for k in range(80)] + [(None, None, None, None), (900, "", "s", "en"), (901, good * 3000, "s", "en"), (901, good * 3000, "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "'x' host", "0 n", "1 judged", "'k' path")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (61, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.keep_good(docs, labels)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and {k for k in kept if k is not None and k < 80} == set(range(1, 80, 2)) and kept.count(901) == 2
    assert quality.keep_good(docs, labels.limit(0)).count() == len(rows)
    assert quality.report(docs.limit(0), labels).count() == 0


def brute_posteriors(rows):
    """(host, path, label, evidence) -> {(host, path): (host rate, path rate, news)}, with plain loops."""
    import math

    def mean(xs):
        return sum(xs) / len(xs)

    rate = (sum(r[2] for r in rows) + 1) / (len(rows) + 2)
    hosts, paths = {}, {}
    for h, p, y, z in rows:
        e = 1 / (1 + math.exp(-(z + math.log(rate / (1 - rate)))))
        hosts.setdefault(h, []).append((y, e))
        paths.setdefault((h, p), []).append((y, e))
    # spread between hosts around the global rate, and within hosts around their own rate
    q = sum(len(v) * (mean([y for y, _ in v]) - rate) ** 2 for v in hosts.values())
    between = (q - len(hosts) * rate * (1 - rate)) / len(rows)
    over_hosts = 1000 if between <= 0 else min(1000, max(2, rate * (1 - rate) / between - 1))
    q = noise = room = v = 0.0
    for (h, _), own in paths.items():
        n, all_ = len(own), len(hosts[h])
        centre = mean([y for y, _ in hosts[h]])
        q += n * (mean([y for y, _ in own]) - centre) ** 2
        noise += (1 - n / all_) * centre * (1 - centre)
        room += n * (1 - n / all_)
        v += n * centre * (1 - centre) / len(rows)
    within = (q - noise) / room
    over_paths = 1000 if within <= 0 else min(1000, max(2, v / within - 1))
    out = {}
    for (h, p), own in paths.items():
        got = []
        for k in (0, 1):
            of_host = (sum(x[k] for x in hosts[h]) + over_hosts * rate) / (len(hosts[h]) + over_hosts)
            got.append((of_host, (sum(x[k] for x in own) + over_paths * of_host) / (len(own) + over_paths)))
        (host, path), (_, foreseen) = got
        out[h, p] = (host, path, math.log(path / (1 - path)) - math.log(foreseen / (1 - foreseen)))
    return out, over_hosts, over_paths


def test_posteriors_by_brute_force(spark):
    """Hosts far apart, paths near their host's rate: paths are held to their host more than hosts to all."""
    rng = np.random.default_rng(4)
    rows = []
    for h in range(30):
        at = rng.uniform(0.1, 0.95)
        for p in range(6):
            own = min(0.99, max(0.01, at + rng.normal(0, 0.05)))
            rows += [(f"h{h}", f"p{p}", int(rng.random() < own), float(rng.normal(0, 1))) for _ in range(int(rng.integers(1, 60)))]
    docs = spark.createDataFrame([(k, h, p, z, 0.0) for k, (h, p, _, z) in enumerate(rows)], "doc_id long, source string, lang string, own_quality double, own_toxic double")
    labels = spark.createDataFrame([(k, y, 0) for k, (_, _, y, _) in enumerate(rows)], "doc_id long, quality int, toxic int")
    want, over_hosts, over_paths = brute_posteriors(rows)
    assert over_paths > 3 * over_hosts
    got = {(r.host, r.path): (r.host_quality, r.path_quality, r.news_quality) for r in quality.posteriors(docs, labels)[0].collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_what_texts_show_already_is_no_news_of_the_site(spark):
    """A site whose texts are poor as their shape says adds nothing; one whose labels are worse than its texts does."""
    rows = [(k, "plain", "p", 0.0) for k in range(200)] + [(200 + k, "seen", "p", -4.0) for k in range(100)] + [(300 + k, "hidden", "p", 0.0) for k in range(100)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, source string, lang string, own_quality double, own_toxic double")
    labels = spark.createDataFrame([(k, int(h == "plain" and k % 20 > 0 or h != "plain" and k % 20 == 0), 0) for k, h, _, _ in rows], "doc_id long, quality int, toxic int")
    news = {r.host: r.news_quality for r in quality.posteriors(docs, labels)[0].collect()}
    assert news["hidden"] < -1.5 and abs(news["seen"]) < 0.5 * abs(news["hidden"])


def test_equal_texts_with_different_labels(spark):
    """The model is the same however rows are dealt out; a text's labels count as shares."""
    rows = [(k, f"Plain words stand here, number {k}. " * 4 if k % 3 else "Ha ### $$$ *** " * 9, "s", "en") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0 or k % 2), int(k % 12 == 0)) for k in range(60)] + [(1, 0, 1), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    models, verdicts = [], []
    for n in (1, 3, 7):
        models.append(quality.fit(docs.repartition(n), labels.repartition(n)))
        verdicts.append(sorted(map(tuple, quality.report(docs.repartition(n), labels).select("doc_id", "rejected").collect())))
    for m in models[1:]:
        assert m.lexicon == models[0].lexicon
        assert all(np.array_equal(m.weights[k], models[0].weights[k]) for k in quality.KINDS)
    assert verdicts[0] == verdicts[1] == verdicts[2]


def test_shares_are_fractions_of_both_classes():
    """A row of share 1/2 weighs as two rows, one of each class, of half the weight."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2))
    y = np.where(np.arange(40) < 10, 0.5, (x[:, 0] > 0).astype(float))
    twice = np.concatenate([x, x])
    apart = np.concatenate([np.ceil(y), np.floor(y)])
    assert np.allclose(quality.logistic(x, y), quality.logistic(twice, apart), atol=1e-8)
