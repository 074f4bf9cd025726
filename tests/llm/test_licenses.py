import re

from newsloom.llm import licenses

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(k, label) for label, phrase in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = sorted(k for k, _ in places)
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


def test_base_places_against_every_place_tried(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    rows = licenses.report(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert any(r.n_base for r in rows)


def test_edges(spark):
    texts = [
        "Under the MIT license", "under the mit licenses", "x cc by nc cc by nc", "cc-by-nc 4.0; Apache License, Version 2.0. under the mit license!", "nc by cc by", None, "", "...", "license version 2 apache",
        "redistribution and use in source and binary forms with or without modification are allowed", "gnu general public license version 3", "under the the mit license", "apache " * 5000, "cc by nc" + " by nc" * 3,
    ]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, license int")
    rows = {r.doc_id: r for r in licenses.report(docs).collect()}
    for k, t in enumerate(texts):
        assert tuple(rows[k][1:6]) == brute(t)
    assert rows[9].labels == "bsd" and rows[10].labels == "gpl-3" and rows[9].base_labels == "" and rows[9].score < 1
    assert licenses.report(docs.limit(0)).count() == 0
    assert licenses.report(docs.union(docs)).count() == 2 * len(texts)


def test_no_python_in_the_plan(spark):
    plan = licenses.report(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def brute_labels(text: str | None, idf: dict[str, float]) -> tuple[str, float]:
    """labels and score: every template at every place that one of its anchors asks for, word by word."""
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    labels, score, whole_base = set(), 0.0, False
    for label, words, key, base in licenses.templates():
        lead = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
        total = sum(idf[x] for x in words)
        for at in {p - q for q in licenses.anchors_of(words, idf) for p in range(len(w)) if w[p] == words[q]}:
            share = sum(idf[x] for k, x in enumerate(words) if 0 <= at + k < len(w) and w[at + k] == x) / total
            whole = at + lead >= 0 and w[at + lead : at + lead + len(key)] == key
            score = max(score, share)
            whole_base |= base and whole
            if whole and (base or share >= licenses.ENOUGH - 1e-9):
                labels.add(label)
    return ",".join(sorted(labels)), 1.0 if whole_base else min(1.0, score)


NOTICES = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3",
    "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "gpl-2",
    "# SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: Apache-2.0": "apache-2", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3", "license = Apache-2.0": "apache-2",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-3",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2", "This work is under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl", "GNU Affero General Public License": "agpl-3",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.": "cc0", "Distributed under the Boost Software License, Version 1.0.": "bsl-1",
    "This is free and unencumbered software released into the public domain.": "unlicense", "the general public has no license to this software": "",
    "Eclipse Public License 1.0 applies": "", "Eclipse Public License, version 2.0": "epl-2", "the terms of the Eclipse Public License v. 2.0": "epl-2", "Mozilla Public License, version 1.1": "", "Mozilla Public License Version 2.0": "mpl-2",
}


def test_labels_and_scores_against_brute_force(spark):
    """Notices as they stand in files, each also with words left out, put in and changed, and the fixed documents."""
    import random

    rng = random.Random(7)
    texts = list(NOTICES)
    for text in list(NOTICES) * 4:
        words = text.split()
        k = rng.randrange(len(words))
        texts.append(" ".join([*words[:k], *rng.choice([[], ["other"], [words[k], "more"]]), *words[k + 1 :]]) + " " + rng.choice(texts[:10]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").selectExpr("doc_id + 100000 doc_id", "text"))
    idf = licenses.licence_idf(docs)
    rows = {r.doc_id: r for r in licenses.report(docs).collect()}
    for doc, text in docs.collect():
        labels, score = brute_labels(text, idf)
        assert rows[doc].labels == labels and abs(rows[doc].score - score) < 1e-9, text
    assert [rows[k].labels for k in range(len(NOTICES))] == list(NOTICES.values())
    assert len({label for label, _, _, _ in licenses.templates()}) >= 15


def test_scan_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "Under the MIT license", "a", "b")], "doc_id long, text string, license string, row string")
    r = licenses.scan(docs).first()
    assert tuple(r["row"]) == (1, "Under the MIT license", "a", "b") and r["license"]["labels"] == ["mit"]
