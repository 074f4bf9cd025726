import random

import public_tokenizers
from tokenizers import Tokenizer

from newsloom.operators import token_windows as tw


def test_windows_are_the_text(spark):
    own, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    texts = [None, "", " ", "one two", "नमस्ते दुनिया " * 30, "😀" * 50, "".join(rng.choice("ab \né語😀") for _ in range(3000)), "word " * 2000]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id long, body string, text string")
    for size in (1, 7, 512):
        rows = {}
        for r in tw.token_windows(df, "id", "body", size).collect():
            rows.setdefault(r.doc, []).append(r)
        assert rows.keys() == set(range(len(texts)))
        for k, text in enumerate(texts):
            found, n = sorted(rows[k], key=lambda r: r.place), len(own.encode(text or "", add_special_tokens=False).ids)
            assert "".join(r.text for r in found) == (text or "")
            assert [r.place for r in found] == list(range(max(1, -(-n // size))))
            assert sum(r.n_tokens for r in found) == n and all(r.n_tokens == size for r in found[:-1])
            assert [r.first for r in found[1:]] == [r.last for r in found[:-1]]
    assert tw.token_windows(df.limit(0), "id", "body").count() == 0


def test_latin_texts_are_split_into_pieces(spark, monkeypatch):
    """Windows of Latin texts are those by the tokenizer's offsets over the whole text, which it never sees."""
    own, rng, seen = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3), []

    class Watched:
        def encode(self, text, add_special_tokens):
            seen.append(text)
            return own.encode(text, add_special_tokens=add_special_tokens)

        def to_str(self):
            return own.to_str()

    monkeypatch.setattr(tw, "tokenizer_of", lambda name: Watched())
    tw._kept.clear()
    tw.splitter.cache_clear()
    words = ["the", "Émile's", "don't", "naïve", "x²", "12½", "…", "—", "’", "\x1c", "\n\n", "\t ", "  ", "__", "ǅ", "ª", "they'LL", "\x85"[:0], "!?"]
    for size in (1, 7, 64):
        for _ in range(200):
            text = "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60)))
            offsets = own.encode(text, add_special_tokens=False).offsets
            starts = [0, *(offsets[k][0] for k in range(size, len(offsets), size))]
            assert [w[0] for w in tw.windows_of(text, "own", size)] == starts
            assert sum(w[2] for w in tw.windows_of(text, "own", size)) == len(offsets)
    assert max(map(len, seen)) < 64
    for text in ("a<|endoftext|>b" * 3, "हिन्दी word", "a\xa0b   c"):
        assert sum(w[2] for w in tw.windows_of(text, "own", 2)) == len(own.encode(text, add_special_tokens=False).ids)
    tw._kept.clear()
    tw.splitter.cache_clear()
