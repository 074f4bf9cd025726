"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Everything is DataFrame expressions. A text's shingle hashes are made once and sorted; the top bits of a hash are its
bin, and the first hash of each bin is the bin's minimum. An empty bin takes the value of another bin, found by
probing pseudo-random bins until one is filled; the probes depend on the bin and the attempt alone, so that two
fingerprints agree there as often as their texts do. The low bits of each bin are kept, and a likeness is corrected
for the bits that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import ascii_lower, cut, let, row_key

#: Words of a shingle, log2 of the number of bins, probes for an empty bin before all filled bins are ranked. Of each bin the low 8 bits are kept.
SHINGLE, BIN_BITS, PROBES = 5, 7, 8
WHITE = " \t\n\x0b\x0c\r"


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all runs of shingle words (ASCII white space apart, A-Z lower-cased); a shorter text is one run; no words: empty."""
    clean = ascii_lower(F.coalesce(text, F.lit("")))
    for c in "\t\n\x0b\x0c\r":
        clean = F.replace(clean, F.lit(c), F.lit(" "))
    clean = F.btrim(clean)

    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - shingle, F.lit(0))
        many = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(shingle))))
        return F.when(F.size(w) >= shingle, many).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))

    def split(t: Column) -> Column:
        w = F.split(t, " ")  # one character: no regular expression is run
        w = F.when(F.contains(t, F.lit("  ")), F.filter(w, lambda x: x != "")).otherwise(w)
        return F.when(t == "", F.array().cast("array<bigint>")).otherwise(let(w, runs))

    return let(clean, split)


def fingerprint(text: Column, shingle: int = SHINGLE, bin_bits: int = BIN_BITS) -> Column:
    """The packed fingerprint, a byte for each bin, as binary; empty where the text has no words.

    Every bin also gets its largest possible hash, so that the sorted hashes show one minimum for each bin, and that
    hash for the empty ones.
    """
    bins, low = 1 << bin_bits, (1 << (64 - bin_bits)) - 1
    ends = F.array(*(F.lit(((i << (64 - bin_bits)) | low) - ((1 << 64) if i >> (bin_bits - 1) else 0)) for i in range(bins)))

    def bin_of(h: Column) -> Column:
        return F.shiftright(h, 64 - bin_bits)

    def dense(own: Column) -> Column:
        def filled(known: Column) -> Column:
            def probe(i: Column) -> Column:
                tries = [F.get(own, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(bins)).cast("int")) for t in range(PROBES)]
                ranks = F.transform(known, lambda h: F.struct(F.xxhash64(i, bin_of(h), F.lit(-1)).alias("r"), h.alias("h")))
                return F.coalesce(*tries, F.array_min(ranks)["h"])

            return F.transform(own, lambda h, i: F.coalesce(h, probe(i)))

        known = F.filter(own, lambda h: h.isNotNull())
        full = F.when(F.size(known) == bins, own).otherwise(let(known, filled))
        digits = F.array(*(F.lit(f"{i:02X}") for i in range(256)))
        return F.unhex(F.array_join(F.transform(full, lambda h: F.get(digits, h.bitwiseAND(F.lit(255)).cast("int"))), ""))

    def pack(hashes: Column) -> Column:
        firsts = F.filter(hashes, lambda h, i: (i == 0) | (bin_of(F.get(hashes, F.greatest(i - 1, F.lit(0)))) != bin_of(h)))
        return let(F.transform(firsts, lambda h: F.when(h.bitwiseAND(F.lit(low)) != low, h)), dense)

    def whole(hashes: Column) -> Column:
        return F.when(F.size(hashes) == 0, F.unhex(F.lit(""))).otherwise(let(F.sort_array(F.concat(hashes, ends)), pack))

    return let(shingle_hashes(text, shingle), whole)


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two texts by their fingerprints, 0 to 1: the share of bins that agree, less what agrees by
    chance. Two texts without words are alike (1), one without is unlike any other (0)."""
    bins, chance = F.octet_length(a), 2.0**-8
    same = F.size(F.filter(F.sequence(F.lit(1), bins), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    corrected = (same / bins - chance) / (1 - chance)
    none = (F.octet_length(a) == 0) | (F.octet_length(b) == 0)
    return F.when(a == b, 1.0).when(none, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), corrected)))


def ranked(ids: DataFrame, *order: Column) -> DataFrame:
    """ids with a column rank, 0, 1, ... in the given order, and no task that holds all rows.

    Rows are dealt by ranges and sorted; a row's place is the number of rows of all ranges before plus its place in its
    own. The driver sees one count for each range only.
    """
    spark = ids.sparkSession
    placed = cut(ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    total, before = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        before.append((r["part"], total))
        total += r["count"]
    offsets = spark.createDataFrame(before, "_part long, _before long")
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn("rank", F.col("_before") + row).drop("_at", "_part", "_before")


def with_successors(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, text (null: empty), fp, edited, next_fp.

    The next document is the one with the next smaller doc_id, after the smallest the largest; of one doc_id's rows the
    order is by a hash of the text. Equal rows follow one another, so all but the last have themselves as the next.
    A null doc_id comes last. A single row follows itself.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", row_key(F.col("text")))
    rows = docs.groupBy("doc_id", "key").agg(F.count("*").alias("copies"), F.max(F.char_length("text")).alias("n"))
    order = ranked(rows, F.col("doc_id").desc_nulls_last(), F.col("key"))
    order = cut(order)
    total = order.count()
    after = order.select(F.expr(f"pmod(rank - 1, {max(total, 1)})").alias("rank"), F.col("doc_id").alias("next_id"), F.col("key").alias("next_key"), F.col("n").alias("next_n"))
    pairs = order.join(after, "rank")
    needs = pairs.select(F.col("next_id").alias("doc_id"), F.col("next_key").alias("key"), F.col("doc_id").alias("for_id"), F.col("key").alias("for_key"), F.expr("cast(n div 2 as int)").alias("need"), "n", "copies")
    printed = docs.withColumn("fp", fingerprint(F.col("text")))

    def keyed(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> Column:
        return a["doc_id"].eqNullSafe(b[names[0]]) & (a["key"] == b[names[1]])

    one = printed.dropDuplicates(["doc_id", "key"]) if order.where("copies > 1").limit(1).count() else printed
    heads = one.join(needs, keyed(one, needs, ("doc_id", "key"))).select("for_id", "for_key", "copies", F.expr("substring(text, 1, need)").alias("head"), F.col("fp").alias("next_fp"))
    own = one.join(heads, keyed(one, heads, ("for_id", "for_key")))
    half = F.expr("substring(text, 1, char_length(text) - cast(char_length(text) div 2 as int))")
    last = own.select("doc_id", "text", "fp", "copies", F.concat(half, "head").alias("edited"), "next_fp")
    itself = F.expr("concat(substring(text, 1, char_length(text) - cast(char_length(text) div 2 as int)), substring(text, 1, cast(char_length(text) div 2 as int)))")
    repeats = last.where("copies > 1").select("doc_id", "text", "fp", itself.alias("edited"), F.col("fp").alias("next_fp"), F.explode(F.sequence(F.lit(2), F.col("copies"))).alias("c"))
    return last.drop("copies").unionByName(repeats.drop("c"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text keeps the first half (the larger one) and goes on with as many characters from the start of the
    next document as were cut, or all it has. Null texts count as empty, texts of any length are read whole. Repeated
    rows each get their row. An empty table gives an empty one. Other columns are not looked at, whatever their names.
    """
    found = with_successors(docs).withColumn("other", fingerprint(F.col("edited")))
    return found.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.lower(F.hex("fp")).alias("fingerprint"),
        F.lower(F.hex("other")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("other")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
