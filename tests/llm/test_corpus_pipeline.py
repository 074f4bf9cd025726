import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from newsloom.llm import chunk_dedup, packing, quality
from tests.llm.test_decontaminate import LOWER, WORD, words
from tests.llm.test_near_texts import brute_groups

SF = "/root/testdata/sf0.001"


def without_windows(text: str, items: list[str]) -> str:
    """Cuts the words of every benchmark window out, each with what stands before it."""
    wins = {tuple(w[k : k + 10]) for w in map(words, items) for k in range(max(1, len(w) - 9) if w else 0)}
    places = [(m.start(), m.end()) for m in WORD.finditer(text.translate(LOWER))]
    own = words(text)
    hit = {j for n in {len(w) for w in wins} for k in range(len(own) - n + 1) if tuple(own[k : k + n]) in wins for j in range(k, k + n)}
    if not hit:
        return text
    out, last = [], 0
    for k, (_, b) in enumerate(places):
        if k not in hit:
            out.append(text[last:b])
        last = b
    return "".join(out) + text[last:]


def without_repeats(rows: list[tuple[int, str]]) -> dict[int, str]:
    """Document by document, in the order of ids, against the digests of all chunks that came before."""
    seen, out = {}, {}
    for doc, text in rows:
        own = chunk_dedup.Words(text)
        known = np.array([d for d in set(chunk_dedup.chunks(own)[2].tolist()) if seen.setdefault(d, doc) != doc], dtype=np.int64)
        spans = chunk_dedup.spans_of(own, known, True, chunk_dedup.MIN_WORDS) if len(own) else []
        out[doc] = own.without(spans) if spans else text
    return out


def test_run_is_the_stages_by_brute_force(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = quality.keep_good(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = sorted((r.doc_id, r.text) for r in good.collect())
    assert 0.5 * docs.count() < len(left) < docs.count()
    roots = brute_groups([t for _, t in left])
    left = [r for k, r in enumerate(left) if roots[k] == k]
    cut = without_repeats(left)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {k: without_windows(t, items) for k, t in cut.items()}
    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    sizes = {k: len(own.encode(t, add_special_tokens=False).ids) + 1 for k, t in want.items()}
    got: dict[int, int] = {}
    places: dict[int, list] = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == sizes
    for parts in places.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF).schema.names == docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_odd_tables_go_through_all_stages(spark):
    """Null ids, texts and other columns, empty and very long texts, repeated rows, rows that share an id, columns with
    the names that stages use, and an empty table."""
    rows = [(1, "A first text of some words that says little. " * 3, "en", "s", 5), (1, "Another text under the same id, which is not the same. ", "en", None, None), (2, None, None, None, None), (3, "", "en", "s", 0)]
    rows += [(4, "the long " * 60_000, "en", "s", 1), (None, "A text without an id, as may be. ", "en", "s", 1), (None, None, None, None, None)] + [(7, "Repeated rows stay once, as the same text. ", "en", "s", 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'a' `row`", "'b' known", "'c' judged", "'d' spans", "'e' doc", "'f' rk")
    names, packed = docs.columns, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k == len(corpus_pipeline.STAGES) - 1:
            packed = out.collect()
            break
        assert out.columns == names
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert all(tuple(r)[5:] == tuple("abcdef") for r in docs.collect())
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert packed and {r.doc_id for r in packed} <= {1, 2, 3, 4, 7, None} and sum(r.doc_id == 7 for r in packed) <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
