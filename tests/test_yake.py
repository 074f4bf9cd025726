"""Keyphrases against plain loops over one text."""

import math
import random
import re
import statistics
import unicodedata
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from newsloom.operators import running, yake

STOP = ["the", "and", "of", "in", "a"]


def kind(word, at):
    if re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", word.replace(",", "")):
        return "d"
    cats = [unicodedata.category(c) for c in word]
    digits, letters, upper = sum(c[0] == "N" for c in cats), sum(c[0] == "L" for c in cats), sum(c == "Lu" for c in cats)
    signs = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in word)
    if digits and letters or not digits and not letters or signs > 1:
        return "u"
    if upper == len(word):
        return "a"
    return "n" if upper == 1 and len(word) > 1 and cats[0] == "Lu" and at > 0 else "p"


def brute(texts, most=4, top=80, alike=0.75):
    letter = lambda c: unicodedata.category(c)[0] in "LMN" or c == "_"
    sentences = [s for t in texts for s in re.split(r"[.!?]+[ \t\n\r\f\v]+|[\r\n]+", t or "") if s.strip(" \t\n\r\f\v")]
    tf, caps, names, where, stops, edges, count, parts_of = Counter(), Counter(), Counter(), defaultdict(set), set(), Counter(), Counter(), {}
    for n, s in enumerate(sentences):
        tokens, i = [], 0
        while i < len(s):
            j = i
            while j < len(s) and (letter(s[j]) or j > i and s[j] in "'’.,:/&@+-" and j + 1 < len(s) and letter(s[j + 1])):
                j += 1
            if j > i:
                tokens.append(s[i:j])
            elif not s[i].isspace():
                tokens.append(None)
                j = i + 1
            i = max(j, i + 1)
        rows = []
        for at, w in enumerate(tokens):
            if w is None:
                rows.append(None)
                continue
            low = w.lower()
            term = low[:-1] if len(low) > 3 and low.endswith("s") else low
            stop = low in STOP or term in STOP or len(re.sub(r"[!-/:-@\[-`{-~]", "", term)) < 3
            rows.append((low, term, kind(w, at), stop))
            tf[term] += 1
            caps[term] += rows[-1][2] == "a"
            names[term] += rows[-1][2] == "n"
            where[term].add(n)
            if stop:
                stops.add(term)
        fit = lambda r: r is not None and r[2] in "anp"
        for x, y in zip(rows, rows[1:], strict=False):
            if fit(x) and fit(y):
                edges[x[1], y[1]] += 1
        for k in range(1, most + 1):
            for i in range(len(rows) - k + 1):
                run = rows[i : i + k]
                if all(map(fit, run)) and not run[0][3] and not run[-1][3]:
                    name = " ".join(r[0] for r in run)
                    count[name] += 1
                    parts_of[name] = [(r[1], r[3]) for r in run]
    valid = [tf[t] for t in tf if t not in stops]
    high, mean, spread = max(valid), statistics.fmean(valid), statistics.pstdev(valid)
    h = {}
    for t in tf:
        if t in stops:
            continue
        left, right = [c for (a, b), c in edges.items() if b == t], [c for (a, b), c in edges.items() if a == t]
        rel = sum(0.5 + (len(e) / sum(e) if e else 0) * tf[t] / high + len(e) / high for e in (left, right))
        h[t] = math.log(math.log(3 + statistics.median(where[t]))) * rel / (max(caps[t], names[t]) / (1 + math.log(tf[t])) + tf[t] / (mean + spread) / rel + len(where[t]) / len(sentences) / rel)
    scores = []
    for name, ps in parts_of.items():
        product, total = 1.0, 0.0
        for k, (t, stop) in enumerate(ps):
            if not stop:
                product, total = product * h[t], total + h[t]
                continue
            tied = edges[ps[k - 1][0], t] / tf[ps[k - 1][0]] * edges[t, ps[k + 1][0]] / tf[ps[k + 1][0]]
            product, total = product * (2 - tied), total - (1 - tied)
        scores.append((product / ((total + 1) * count[name]), name))
    taken = []
    for raw, name in sorted(scores):
        if len(taken) < top and all(1 - distance(name, o) / max(len(name), len(o)) <= alike for o, _ in taken):
            taken.append((name, raw))
    return {n: (r, count[n]) for r, n in scores}, taken


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def texts():
    rng = random.Random(4)
    words = ["oil", "Milk", "the", "of", "in", "FSSAI", "adulterated", "adulteration", "market", "markets", "Delhi", "2,000", "litres", "3.5", "A1b", "और", "दूध", "don't", "x", "é", "mid-day", "police"]
    return [" ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", ".", "!", " (", "\n"]) for _ in range(rng.randrange(5, 60))) for _ in range(25)] + [None, "", " . ", "One. Two"]


def test_phrases_against_plain_loops(spark):
    found = texts()
    docs = spark.createDataFrame([(k * 3 - 5, t, "x") for k, t in enumerate(found)], "doc long, text string, term string").repartition(4)
    every, best = brute(found)
    got = {r.phrase: (r.raw, r.tf) for r in yake.scored(docs, "doc", F.col("text"), STOP).collect()}
    assert got.keys() == every.keys()
    assert all(math.isclose(got[p][0], every[p][0], rel_tol=1e-9) and got[p][1] == every[p][1] for p in got)
    top = [(r.term, r.score) for r in yake.keyphrases(docs, "doc", F.col("text"), STOP, top=30).collect()]
    assert [t for t, _ in top] == [n for n, _ in best[:30]]
    assert all(math.isclose(s, 1 / (1 + r), rel_tol=1e-9) for (_, s), (_, r) in zip(top, best[:30], strict=True))
    assert yake.keyphrases(docs.limit(0), "doc", F.col("text"), STOP).count() == 0


def test_near_phrases_are_folded_over_blocks(spark):
    names = [f"word {'abcdefghij'[k % 10] * (1 + k // 10)}" for k in range(60)]
    ranked = spark.createDataFrame([(n, k / 7) for k, n in enumerate(names)], "phrase string, raw double")
    want = []
    for n in names:
        if all(1 - distance(n, o) / max(len(n), len(o)) <= 0.75 for o in want):
            want.append(n)
    for block in (3, 7, 100):
        assert [r.phrase for r in yake.folded(ranked, 50, 0.75, block)] == want[:50]
        assert [r.phrase for r in yake.folded(ranked, 4, 0.75, block)] == want[:4]


def test_running_sums_and_medians(spark, monkeypatch):
    monkeypatch.setattr(running, "BUCKETS", 5)
    rng = random.Random(1)
    rows = [(k * 7 % 1009, rng.randrange(9)) for k in range(1009)]
    got = {r.o: r.before for r in running.sums_before(spark.createDataFrame(rows, "o long, v long").repartition(7), "o", "v", "before").collect()}
    total, want = 0, {}
    for o, v in sorted(rows):
        want[o], total = total, total + v
    assert got == want
    rows = [(f"k{rng.randrange(20)}" if k % 3 else "hot", rng.randrange(200)) for k in range(3000)] + [("one", 5), ("two", 1), ("two", 4)]
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    got = {r.k: r.median for r in running.medians(spark.createDataFrame(rows, "k string, v long"), "k", "v").collect()}
    assert got == {k: statistics.median(v) for k, v in by.items()}


def test_parts_follow_from_a_phrase(spark):
    """Shuffles hold phrases and counts, not their terms: these are told by the words alone."""
    told = spark.createDataFrame([(["Raids", "of", "Oil's", "É", "as", "It"],)], "w array<string>").select(yake.told(F.col("w"), STOP).alias("t"))
    low = F.array_join(F.transform("t", lambda t: t["low"]), " ")
    got = told.select(yake.parts_of(low, STOP).alias("p"), F.transform("t", lambda t: F.struct(t["term"].alias("term"), t["stop"].alias("stop"))).alias("q")).first()
    assert got.p == got.q and len(got.p) == 6
    rows = told.select(F.lit(1).alias("doc"), F.lit(0).alias("sentence"), F.col("t").alias("tokens"))
    assert yake.phrases(rows, 4).columns == ["phrase", "tf", "df"]


def test_scores_below_zero_suffice_where_they_can(spark, monkeypatch):
    """Phrases without two stop words within are counted only where those with two leave places open; same phrases."""
    rng = random.Random(3)
    names = ["oil", "Milk", "police", "Market", "sugar", "butter", "Honey", "flour"]
    stops = ["of", "in", "a", "the", "and", "to", "it", "is", "on", "by", "at", "as", "be", "he", "an", "or", "if", "so", "we", "us"]
    word, stop, rare = (lambda: rng.choice(names)), (lambda: rng.choice(stops)), (lambda: "".join(rng.choice("bcdfgklm") for _ in range(7)))
    found = [" ".join(f"{rare()} {rare()} {word()} {stop()} {stop()} {word()} {rare()} {rare()} {word()}." for _ in range(5)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(found)), "doc long, text string")
    _, best = brute(found)
    below = sum(r < 0 for _, r in best)
    assert 2 < below < 70
    asked, phrases = [], yake.phrases
    monkeypatch.setattr(yake, "phrases", lambda rows, most, loose=0: asked.append(loose) or phrases(rows, most, loose))
    for top, want in ((below, [2]), (below + 5, [2, 0])):
        got = [(r.term, r.score) for r in yake.keyphrases(docs, "doc", F.col("text"), STOP, top=top).collect()]
        assert [t for t, _ in got] == [n for n, _ in best[:top]] and asked == want
        asked.clear()


def test_words_of_letters_are_told_at_once(spark):
    """As by counting letters, digits, signs and capitals."""
    words = ["raid", "Raid", "RAID", "É", "é", "Ét", "ǅa", "aB", "aÉ", "x1", "12", "12.5", "don't", "Don't", "mid-day", "दूध", "और", "a_b", "_", "As", "It's", "oils", "Oil", "The", "²", "ß", "Straße", "İx", "-"]
    got = spark.createDataFrame([(words,)], "w array<string>").select(yake.told(F.col("w"), STOP).alias("t"), F.transform("w", yake.kind_of).alias("k")).first()
    whole = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.lower("w").alias("low"), yake.term_of(F.col("w")).alias("term"), yake.is_stop(F.lower("w"), yake.term_of(F.col("w")), STOP).alias("stop")).collect()
    for token, kind_, r in zip(got.t, got.k, whole, strict=True):
        assert token is None and r.w == "-" or (token.low, token.term, token.kind, token.stop) == (r.low, r.term, kind_, r.stop), r


def test_medians_of_values_that_are_distinct(spark, monkeypatch):
    """Nothing is kept for them."""
    monkeypatch.setattr(running, "BUCKETS", 5)
    rng = random.Random(2)
    by = {f"k{k}": rng.sample(range(200), rng.randrange(1, 90)) for k in range(30)}
    once = spark.createDataFrame([(k, v) for k, vs in by.items() for v in vs], "k string, v long")
    assert {r.k: r.median for r in running.medians(once, "k", "v", 199).collect()} == {k: statistics.median(v) for k, v in by.items()}
