"""License scans by a positional index of rare words.

DataFrame expressions only, and no shuffle but for the document frequencies. One pass counts in how many documents
each licence word stands; this gives its IDF. Each template (a passage of a licence, of its notice, or a tag) is posted
under its words of highest IDF (its anchors), with their places in it: word -> (template, place). A file's anchors are
found by one filter over its words; an anchor at place p that is posted at place q asks for the template at p - q, and
there the words are held against the template's by relative place: their IDF-weighted share is the score. A label is
given where the score suffices and every mandatory key phrase stands whole at its place.

Postings and templates are literals of the plan: their size is that of the licences' texts, and the plan has one
expression for all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import carried, let, lower_words

# Label, words, mandatory key phrase (its first word's place and its words). A base template is its own key phrase.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# Passages of public licences and of their notices, with the phrase that has to stand whole.
MORE = [
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "agreed to in writing software distributed under the license"),
    ("apache-2", "apache license 2 0", "apache license 2 0"),
    ("apache-2", "apache 2 0", "apache 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "merge publish distribute sublicense"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "must reproduce the above copyright notice"),
    ("bsd-3", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products"),
    ("gpl-3", "gnu general public license version 3", "general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "either version 3 of the license"),
    ("gpl-3", "gnu gpl v3", "gnu gpl v3"),
    ("gpl-2", "gnu general public license version 2", "general public license version 2"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "either version 2 of the license"),
    ("gpl-2", "gnu gpl v2", "gnu gpl v2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl-3", "gnu affero general public license", "affero general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "affero general public license"),
    ("mpl-2", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute"),
    ("isc", "this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "use compile sell or distribute this software"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "must be plainly marked as such"),
    ("bsl-1", "boost software license version 1 0", "boost software license version 1 0"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization obtaining a copy"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("epl-2", "eclipse public license 2 0", "eclipse public license 2 0"),
    ("epl-2", "eclipse public license v 2 0", "eclipse public license v 2 0"),
    ("epl-2", "eclipse public license version 2 0", "eclipse public license version 2 0"),
    ("artistic-2", "the artistic license 2 0", "artistic license 2 0"),
    ("ms-pl", "microsoft public license ms pl", "microsoft public license"),
    ("eupl", "european union public licence", "european union public licence"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("psf-2", "python software foundation license version 2", "python software foundation license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "related or neighboring rights"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc-by", "creative commons attribution 4 0 international license", "attribution 4 0 international"),
    ("cc-by", "creative commons attribution 3 0", "attribution 3 0"),
    ("cc-by-nc", "creative commons attribution noncommercial", "attribution noncommercial"),
    ("cc-by-nc", "content is licensed cc by nc 4 0", "cc by nc"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike", "attribution noncommercial sharealike"),
    ("cc-by-sa", "creative commons attribution sharealike", "attribution sharealike"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-nd", "creative commons attribution noderivatives", "attribution noderivatives"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
]
# Labels and the words of their identifiers behind "SPDX-License-Identifier:".
TAGS = [
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl-3", "agpl 3 0"), ("mpl-2", "mpl 2 0"), ("isc", "isc"),
    ("unlicense", "unlicense"), ("zlib", "zlib"), ("bsl-1", "bsl 1 0"), ("epl-2", "epl 2 0"), ("artistic-2", "artistic 2 0"), ("ms-pl", "ms pl"), ("eupl", "eupl 1 2"), ("ofl", "ofl 1 1"), ("psf-2", "psf 2 0"), ("cc0", "cc0 1 0"), ("cc-by", "cc by 4 0"),
    ("cc-by-nc", "cc by nc 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nd", "cc by nd 4 0"), ("cc-by-nc-sa", "cc by nc sa 4 0"),
]
#: A template's anchors, and the share of its IDF that has to stand for a label of the method.
ANCHORS, ENOUGH = 3, 0.8


def templates() -> list[tuple[str, list[str], list[str], bool]]:
    """(label, words, key phrase's words, is base)."""
    found = [(label, words.split(), words.split(), True) for label, words in BASE] + [(label, words.split(), key.split(), False) for label, words, key in MORE]
    for label, words in TAGS:
        tag = f"spdx license identifier {words}".split()
        found.append((label, tag, tag, False))
    return found


def anchors_of(words: list[str], idf: dict[str, float]) -> list[int]:
    """The places of a template's words of highest IDF; of one word one place."""
    places = sorted({w: q for q, w in reversed(list(enumerate(words)))}.values())
    return sorted(places, key=lambda q: (-idf[words[q]], q))[:ANCHORS]


def lead_of(words: list[str], key: list[str]) -> int:
    return next(k for k in range(len(words)) if words[k : k + len(key)] == key)


def licence_idf(docs: DataFrame) -> dict[str, float]:
    """The IDF of each licence word over all documents. The driver gets one row a word."""
    words = sorted({w for _, ws, _, _ in templates() for w in ws})
    own = let(lower_words(F.col("text")), lambda w: F.concat(F.array_distinct(F.filter(w, lambda x: x.isin(words))), F.array(F.lit(""))))
    counts = {r["w"]: r["count"] for r in docs.select(F.explode(own).alias("w")).groupBy("w").count().collect()}
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in words}


def _literals(idf: dict[str, float]) -> tuple[Column, Column, list[str]]:
    """The templates as an array of structs, the postings as a map from words to (t, place), and the words posted."""
    known, posted = templates(), {}
    rows = []
    for t, (label, words, key, base) in enumerate(known):
        total = sum(idf[w] for w in words)
        weights = " ".join(repr(idf[w] / total) for w in words)
        rows.append(F.struct(
            F.lit(label).alias("label"), F.split(F.lit(" ".join(words)), " ").alias("words"), F.split(F.lit(weights), " ").cast("array<double>").alias("weights"),
            F.lit(lead_of(words, key)).alias("lead"), F.lit(len(key)).alias("n_key"), F.lit(" ".join(key)).alias("key"), F.lit(base).alias("base"),
        ))
        for q in anchors_of(words, idf):
            posted.setdefault(words[q], []).append((t, q))
    postings = F.create_map(*(x for w, ps in sorted(posted.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(q).alias("place")) for t, q in ps)))))
    return F.array(*rows), postings, sorted(posted)


def found(text: Column, idf: dict[str, float]) -> Column:
    """n_words, base (sorted places of base phrases, one entry for each phrase), base_labels, labels (sorted distinct
    arrays) and score of a text, as a struct. Null texts have no words."""
    known, postings, rare = _literals(idf)
    none = F.array().cast("array<struct<t:int,at:int>>")

    def judged(w: Column, c: Column) -> Column:
        def against(t: Column) -> Column:
            share = F.aggregate(F.transform(t["words"], lambda x, k: F.when(F.get(w, c["at"] + k) == x, F.get(t["weights"], k)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
            lead = c["at"] + t["lead"]
            whole = (lead >= 0) & (F.array_join(F.slice(w, F.greatest(lead, F.lit(0)) + 1, t["n_key"]), " ") == t["key"])
            return F.struct(t["label"].alias("label"), t["base"].alias("base"), c["at"].alias("at"), F.least(share, F.lit(1.0)).alias("score"), F.coalesce(whole, F.lit(False)).alias("whole"))

        return let(F.get(known, c["t"]), against)

    def scanned(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(rare), i)), lambda i: i.isNotNull())

        def asked(p: Column) -> Column:
            return F.transform(F.element_at(postings, F.get(w, p)), lambda q: F.struct(q["t"].alias("t"), (p - q["place"]).alias("at")))

        # No rare word: nothing to look up. This is so for nearly all files.
        candidates = let(places, lambda ps: F.when(F.size(ps) == 0, none).otherwise(F.array_distinct(F.flatten(F.transform(ps, asked)))))
        return let(F.transform(candidates, lambda c: judged(w, c)), lambda h: summed(w, h))

    def summed(w: Column, h: Column) -> Column:
        base = F.filter(h, lambda c: c["base"] & c["whole"])
        good = F.filter(h, lambda c: c["whole"] & (c["base"] | (c["score"] >= ENOUGH)))
        of = lambda cs: F.sort_array(F.array_distinct(F.transform(cs, lambda c: c["label"])))
        best = F.coalesce(F.array_max(F.transform(h, lambda c: c["score"])), F.lit(0.0))
        return F.struct(F.size(w).alias("n_words"), F.sort_array(F.transform(base, lambda c: c["at"])).alias("base"), of(base).alias("base_labels"), of(good).alias("labels"), F.when(F.size(base) > 0, 1.0).otherwise(best).alias("score"))

    return let(lower_words(text), scanned)


def scan(docs: DataFrame, idf: dict[str, float] | None = None) -> DataFrame:
    """Each row of docs as a struct column row, and license: what found() says of its text. Columns may have any names."""
    return carried(docs, found(F.col("text"), idf or licence_idf(docs)).alias("license"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    first_word and last_word are null where no base phrase stands; a null or empty text, or one without words, has no
    labels and score 0; texts of any length are read whole. score is 1 where a base phrase stands, else the best
    template's IDF-weighted share. Repeated rows stay; an empty table gives an empty one; other columns are not looked
    at, whatever their names.
    """
    seen = scan(docs.select("doc_id", "text")).select("row.doc_id", "license.*")
    size = F.size("base")
    return seen.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), size.cast("long").alias("n_base"), F.get("base", F.lit(0)).cast("long").alias("first_word"), F.when(size > 0, F.get("base", size - 1)).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
