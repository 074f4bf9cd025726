import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import token_files

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(own, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_come_back(spark, own):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, token_files.round_trip(docs.repartition(5)).collect())) == expected(own, rows)


ODD = ["", None, " ", "  ", "a  b", "a   b", " a", "a ", "a  ", "\n\na\n b \n\n c\t\td", "a \n b", "x  y  z", "don't we'll", "नमस्ते दुनिया  ।", "語 語語", "a<|endoftext|>b <|endoftext|> ", "!", "! !", "😀 😀x", "\u0000 \u001c \u0085"]


def test_odd_texts(spark, own, tmp_path):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(len(ODD), "ab c. " * 60_000), (len(ODD) + 1, "x" * 30_000)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start int, ids string")
    assert sorted(map(tuple, token_files.round_trip(docs).collect())) == expected(own, rows)
    assert token_files.round_trip(docs.limit(0)).count() == 0
    # Repeated rows, rows of one doc_id, rows without one: each is there, the ids are gapless.
    rows = [(None, "b c"), (None, "b c"), (3, "x"), (3, "x"), (3, None), (-5, "y")]
    got = sorted(map(tuple, token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [-5, 3, 3, 3, None, None]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]


@pytest.mark.parametrize("tokenizer", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_sequences_and_masks_are_views_of_the_file(spark, tmp_path, tokenizer):
    own = Tokenizer.from_file(public_tokenizers.path(tokenizer))
    texts = [f"some words {k} of a text " * (k % 7) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = f"file://{tmp_path}/{tokenizer}"
    token_files.write(docs, path, tokenizer, 0, length=16, rows=8)
    about = token_files.manifest(path)
    assert (about["length"], about["rows"], about["width"]) == (16, 8, 2)
    flat = [i for t in texts for i in (*own.encode(t, add_special_tokens=False).ids, 0)]
    at = 0
    for one in about["shards"]:
        shard, whole = token_files.Shard(f"{path}/{one['name']}.ids.arrow", 8), flat[at : at + one["ids"]]
        assert len(shard) == -(-one["ids"] // 16)
        for j in np.random.default_rng(1).permutation(len(shard)):
            ids, mask = shard.sequence(int(j))
            want = whole[j * 16 : j * 16 + 16]
            assert ids.tolist() == want + [0] * (16 - len(want))
            assert not ids.flags.owndata
            assert mask.to_pylist() == [True] * len(want) + [False] * (16 - len(want))
        assert shard.ids(5, one["ids"] - 5).tolist() == whole[5:]
        at += one["ids"]
    assert at == len(flat)
    with pytest.raises(Exception, match="already"):
        token_files.write(docs, path, tokenizer)


def test_what_no_manifest_names_is_not_read(spark, tmp_path):
    """A lost attempt's files stay beside those of the one that counts."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    path = f"file://{tmp_path}/t"
    token_files.write(docs, path)
    (tmp_path / "t" / "000000-lost.ids.arrow").write_bytes(b"half")
    (tmp_path / "t" / "000000-lost.docs.arrow").write_bytes(b"")
    assert token_files.read(spark, path).count() == 50


def test_pieces_of_any_texts():
    """Random texts of blanks, line ends, apostrophes, signs, letters and numbers, plain and not, several in a batch."""
    encoder, signs = token_files.Encoder("byte_bpe_50k.json"), list("ab Z1  \n\t\r'stredvml.!?-é×²ª¿\u0000\u001cሴ\u0085 中ı")
    random.seed(5)
    for _ in range(60):
        texts = ["".join(random.choices(signs[: random.choice([12, 25, 34, 40])], k=random.randrange(40))) for _ in range(200)]
        assert encoder.encode_all(pa.array(texts)) == [encoder.encode(t) for t in texts]
