"""Benchmark decontamination: windows of benchmark words, broadcast as a hash set, are sought in whole documents.

DataFrame expressions only. Wherever a window of n words stands in a document, one of its runs of g = n div 2 words
(rounded up) starts at a multiple of n - g + 1 there. So only these runs of a document are looked up: they are exploded
and meet the broadcast runs of all windows within one stage, where the words around each hit are compared with the
whole window. Only hits are shuffled, pre-aggregated by document.

The windows are broadcast in blocks of at most block_windows, without the items that have them, which meet the hits
afterwards; a benchmark of more takes as many passes over the documents, so no broadcast grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import ANY_WORD, NOT_WORD, carried, cut, let, lower_words, restored, row_key, words_of

WINDOW, BLOCK_WINDOWS = 10, 40_000
#: Stands for the hash of "this document exists"; it meets a row of its own among the windows.
MARK = -1


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: length, text (words joined by a space), items (sorted distinct ids as strings).

    An item of fewer than window words, but not none, is one window; a null text has none, a null id is left out of items.
    """
    spans = benchmark.select(F.col("item_id").cast("string").alias("item"), lower_words(F.col("text")).alias("w")).where("size(w) > 0")
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))), lambda i: F.slice("w", i, window))
    found = spans.select("item", F.explode(each).alias("run"))
    found = found.groupBy(F.array_join("run", " ").alias("text"), F.size("run").alias("length")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    return found.select("length", "text", "items")


def _run(length: int) -> tuple[int, int]:
    """Words of the run that is looked up for windows of this length, and the step between a document's runs."""
    words = (length + 1) // 2
    return words, length - words + 1


def _runs(words: Column, length: int) -> Column:
    """The hashes of a document's runs for windows of this length."""
    n, step = _run(length)
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)), F.lit(step))
    return F.when(F.size(words) >= length, F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, n), " ")))).otherwise(F.array().cast("array<bigint>"))


def _index(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Every run of every window: length, hit (its hash), offset in the window, text, wid."""
    words = F.split("text", " ")

    def of(length: int) -> Column:
        n, step = _run(length)
        return F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, n), " ")))

    each = F.lit(None)
    for length in lengths:
        each = F.when(F.col("length") == length, of(length)).otherwise(each)
    return windows.select("length", F.posexplode(each.cast("array<bigint>")).alias("offset", "hit"), "text", "wid")


def _hits(docs: DataFrame, windows: DataFrame, block_windows: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, copies, n_words, found (sorted distinct (place, length)), wids (distinct windows) for every distinct
    (doc_id, text); copies counts its rows. And (wid, item)."""
    spark = docs.sparkSession
    windows = cut(windows.withColumn("wid", F.monotonically_increasing_id()))
    shape = windows.groupBy("length").count().collect()  # as many rows as there are lengths, the window's at most
    lengths = sorted(r["length"] for r in shape)
    blocks = max(1, -(-sum(r["count"] for r in shape) // block_windows))
    mark = spark.range(1).select(F.lit(0).alias("length"), F.lit(0).alias("offset"), F.lit(MARK).cast("long").alias("hit"), F.lit("").alias("text"), F.lit(None).cast("long").alias("wid"))
    words = docs.select("doc_id", row_key(F.col("text")).alias("key"), let(lower_words(F.col("text")), lambda w: F.struct(w.alias("w"), F.array(*(_runs(w, n) for n in lengths)).alias("h"))).alias("d"))
    parts = []
    for block in range(blocks):
        own = _index(windows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block), lengths).unionByName(mark) if lengths else mark
        rows = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(_run(n)[1]).alias("step"), F.get(F.col("d.h"), F.lit(k)).alias("hs")) for k, n in enumerate(lengths)), F.struct(F.lit(0).alias("n"), F.lit(0).alias("step"), F.array(F.lit(MARK).cast("long")).alias("hs")))
        each = words.select("doc_id", "key", "d", F.explode(rows).alias("r")).select("doc_id", "key", "d", F.col("r.n").alias("n"), F.col("r.step").alias("step"), F.posexplode("r.hs").alias("at", "hash"))
        met = each.join(F.broadcast(own), (F.col("hash") == F.col("hit")) & (F.col("n") == F.col("length")))
        met = met.withColumn("place", F.col("at") * F.col("step") - F.col("offset"))
        same = F.when(F.col("place") >= 0, F.array_join(F.slice("d.w", F.greatest("place", F.lit(0)) + 1, F.col("n")), " ") == F.col("text"))
        met = met.where((F.col("n") == 0) | same)
        parts.append(met.select("doc_id", "key", F.size("d.w").alias("n_words"), F.when(F.col("n") > 0, F.struct("place", "length")).alias("at"), "wid", F.lit(int(block == 0)).alias("counts")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    grouped = every.groupBy("doc_id", "key").agg(F.sum(F.when(F.col("at").isNull(), F.col("counts"))).alias("copies"), F.max("n_words").alias("n_words"), F.collect_set("at").alias("found"), F.collect_set("wid").alias("wids"))
    return grouped.select("doc_id", "key", "copies", "n_words", F.sort_array("found").alias("found"), "wids"), windows.select("wid", F.explode("items").alias("item"))


def hits(docs: DataFrame, windows: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, key, copies, n_words, found (sorted distinct (place, length)), items (sorted distinct) for every
    distinct (doc_id, text); copies counts its rows."""
    found, items = _hits(docs, windows, block_windows)
    found = cut(found)
    own = found.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.explode("wids").alias("wid")).join(items, "wid")
    own = own.groupBy("_doc", "_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    met = found.join(own, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    return met.select("doc_id", "key", "copies", "n_words", "found", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def merged(found: Column, window: int = WINDOW) -> Column:
    """Sorted (place, length), no length over window -> disjoint spans of words (start, stop), in order.

    A hit that reaches another's place, or has the last stop of a span, is among the window * window before it, so this
    takes time in proportion to the hits.
    """
    back = window * window
    stop = lambda h: h["place"] + h["length"]

    def spans(f: Column) -> Column:
        def apart(h: Column, i: Column) -> Column:
            before = F.slice(f, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back)))
            return F.when(~F.exists(before, lambda x: stop(x) >= h["place"]), i)

        def of(b: Column) -> Column:
            def span(first: Column, j: Column) -> Column:
                end = F.coalesce(F.get(b, j + 1), F.size(f))
                last = F.slice(f, F.greatest(end - back, first) + 1, F.least(end - first, F.lit(back)))
                return F.struct(F.get(f, first)["place"].alias("start"), F.array_max(F.transform(last, stop)).alias("stop"))

            return F.transform(b, span)

        return let(F.filter(F.transform(f, apart), lambda i: i.isNotNull()), of)

    return let(found, spans)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row.

    A word inside any occurrence of a window is hit. Null and empty texts have no words; texts of any length are read
    whole. An empty benchmark leaves all clean; an empty table gives an empty one. Repeated rows each get their row;
    other columns are not looked at, whatever their names.
    """
    found = hits(docs.select("doc_id", "text"), windows_of(benchmark, window))
    n_hit = F.aggregate(
        "found", F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["place"] + h["length"] - F.greatest(a["stop"], h["place"]))).alias("n"), F.greatest(a["stop"], h["place"] + h["length"]).alias("stop")),
    )["n"]
    out = found.select("doc_id", "copies", F.col("n_words").cast("long"), n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("c")).drop("c", "copies")


def without_spans(text: Column, spans: Column) -> Column:
    """text without the words of the spans and what stands before each of them; the rest as it was. Only what is
    between spans is put together again, piece by piece."""

    def rebuilt(w: Column, gaps: Column, z: Column) -> Column:
        # gaps[i] stands before word i; a text that starts with a word has an empty gaps[0]
        def joined(parts: Column) -> Column:
            def piece(k: Column) -> Column:
                start, stop = F.coalesce(F.get(z, k - 1)["stop"], F.lit(0)), F.coalesce(F.get(z, k)["start"], F.size(w))
                return F.array_join(F.slice(parts, start + 1, stop - start), "")

            return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(z)), piece), ""), F.coalesce(F.get(gaps, F.size(w)), F.lit("")))

        return let(F.transform(w, lambda x, i: F.concat(F.get(gaps, i), x)), joined)

    return let(words_of(text, NOT_WORD), lambda w: let(F.split(text, ANY_WORD), lambda g: let(spans, lambda z: rebuilt(w, g, z))))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, whole_documents: bool = False) -> DataFrame:
    """docs without benchmark passages: hit words are cut out of the text (n_chars follows), or with whole_documents
    the rows that have any go. All columns, whatever their names, and all other rows stay as they are; null and empty
    texts too. Texts of any length are read whole."""
    found, _ = _hits(docs.select("doc_id", "text"), windows_of(benchmark, window), BLOCK_WINDOWS)
    found = found.where(F.size("found") > 0).select(F.col("doc_id").alias("doc"), "key", merged(F.col("found"), window).alias("spans"))
    rows = carried(docs, F.col("doc_id").alias("own"), row_key(F.col("text")).alias("own_key"))
    on = F.col("own").eqNullSafe(F.col("doc")) & (F.col("own_key") == F.col("key"))
    if whole_documents:
        return restored(rows.join(found, on, "left_anti"), docs.columns)
    touched = F.col("spans").isNotNull()
    new = let(without_spans(F.col("row.text"), F.col("spans")), lambda t: F.struct(t.alias("text"), F.char_length(t).alias("n_chars")))
    met = rows.join(found, on, "left").select("row", touched.alias("touched"), F.when(touched, new).alias("new"))
    changed = {"text": F.when(F.col("touched"), F.col("new.text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("touched"), F.col("new.n_chars").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return restored(met, docs.columns, **changed)
