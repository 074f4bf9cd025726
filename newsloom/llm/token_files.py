"""Token ids in Arrow files of fixed-size-list batches: equal-length sequences and masks, read without copying.

The ids of all documents stand one after the other in ascending order of doc_id and are cut into sequences of equal
length. A shard is what one task writes: a file of sequences (Arrow's stream format with the footer that tells where its
batches are), in batches of the same number of sequences, so that sequence j is row j % rows of batch j // rows and its
ids and mask are slices of the mapped file; and a file of its documents (doc_id, start, n_tokens). Only the last sequence
of a shard is padded, which its mask says. Ids take two bytes where the vocabulary fits them, else four.

Files are a Spark data source of their own, token_files: tasks write shards under names that no other attempt uses, and
the manifest, which names the shards in order with their counts, is written last, when all tasks are done. A task that is
lost is run again and leaves at most a file that no manifest names. Readers follow the manifest, a task for each shard.
Paths are any that Arrow's file systems know, local files among them.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from newsloom.llm.common import doc_order, row_key, shared_path
from newsloom.llm.packing import byte_letters

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: Ids of a sequence, sequences of a batch.
LENGTH, ROWS = 2048, 256
#: Texts that are encoded together: rows and bytes at most, but for a single longer one.
STEP_ROWS, STEP_BYTES = 6000, 8_000_000
#: Pieces whose ids a worker remembers.
REMEMBERED = 500_000
MANIFEST = "manifest.json"
IDS = "doc_id long, ids binary"
DOCS = "doc_id long, start long, n_tokens long, ids binary"

# White space of ASCII but the blank, kinds of characters, and what stands after an apostrophe that begins a piece of its own.
SPACES = "\t\n\v\f\r"
LETTER, NUMBER, OTHER, WHITE, BLANK, NONE = range(6)
SHORT = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Texts of characters up to here are split by Spark's batches, others by the tokenizer itself.
LAST_PLAIN = 0x24F


def kind_of(c: str) -> int:
    return BLANK if c == " " else WHITE if c in SPACES else LETTER if unicodedata.category(c)[0] == "L" else NUMBER if unicodedata.category(c)[0] == "N" else OTHER


KINDS = np.array([kind_of(chr(c)) for c in range(LAST_PLAIN + 1)], dtype=np.uint8)


def piece_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces start in the UTF-8 bytes of plain texts that stand one after the other; texts: where each starts.

    A byte-level vocabulary's pieces are runs of letters, of numbers or of other signs, with the blank before them; what
    is left of white space; and short forms behind an apostrophe. The last of several white characters is left to what
    comes after them."""
    kind = KINDS[np.minimum(data, 127)]
    wide = np.flatnonzero(data >= 0xC2)
    kind[wide] = KINDS[((data[wide].astype(np.uint16) & 0x1F) << 6) | (data[wide + 1] & 0x3F)]
    kind[wide + 1] = kind[wide]
    before = np.concatenate([np.array([NONE], dtype=np.uint8), kind[:-1]])
    before[texts] = NONE
    after = np.concatenate([kind[1:], np.array([NONE], dtype=np.uint8)])
    after[texts[1:] - 1] = NONE
    white = kind >= WHITE
    start = np.where(white, ((before != WHITE) & (before != BLANK)) | (after < WHITE), (kind != before) & (before != BLANK))
    start[wide + 1] = False
    marks = np.flatnonzero((data == 0x27) & (before != OTHER) & (before != BLANK))
    if len(marks):
        ends = np.append(texts[1:], len(data))[np.searchsorted(texts, marks, side="right") - 1]
        for form in SHORT:
            fit = marks + len(form) < ends
            for k, c in enumerate(form, 1):
                fit &= data[np.minimum(marks + k, len(data) - 1)] == c
            at = marks[fit]
            start[at + 1] = False
            stop = at + 1 + len(form)
            stop = stop[stop < ends[fit]]
            # What follows is apart from the short form, unless it is the rest of white space.
            start[stop[kind[stop] < WHITE]] = True
    start[texts] = True
    return np.flatnonzero(start)


class Encoder(dict):
    """The tokenizer's ids of whole texts, in dtype: piece before byte-pair merges -> its ids, up to REMEMBERED pieces.

    Texts of ASCII and Latin characters (but for two kinds of white space) are split into pieces together, and each distinct piece of a batch is looked up
    once. Texts with other characters or with special tokens, and all texts of other kinds of vocabularies, go to the
    tokenizer whole. Both give the tokenizer's ids."""

    def __init__(self, tokenizer: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.dtype = np.dtype("<u2" if self.own.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.letters = self.own.model, byte_letters()
        about = json.loads(self.own.to_str())
        before = about["pre_tokenizer"] or {}
        by_piece = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not about["normalizer"]
        special = [re.escape(t["content"]) for t in about["added_tokens"]]
        self.whole = "|".join([rf"[^\x{{0}}-\x{{{LAST_PLAIN:X}}}]|[\x{{85}}\x{{A0}}]", *special]) if by_piece else "(?s)^.*$"

    def __missing__(self, piece: str) -> bytes:
        text = "".join(map(self.letters.__getitem__, piece.encode()))
        ids = array(self.dtype.char, [t.id for t in self.model.tokenize(text)]).tobytes()
        if len(self) < REMEMBERED:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text."""
        apart = pc.match_substring_regex(texts, self.whole)
        plain = pc.if_else(apart, "", texts)
        data = np.frombuffer(plain.buffers()[2] or b"", dtype=np.uint8)
        offsets = np.frombuffer(plain.buffers()[1], dtype=np.int32)[plain.offset : plain.offset + len(plain) + 1]
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        apart, full = apart.to_numpy(zero_copy_only=False), np.unique(offsets[:-1][np.diff(offsets) > 0])
        starts = piece_starts(data, full) if len(data) else np.zeros(0, dtype=np.int64)
        ends = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        got = list(map(self.__getitem__, pieces.dictionary.to_pylist()))
        width, which = self.dtype.itemsize, pieces.indices.to_numpy()
        ids, sizes = np.frombuffer(b"".join(got), dtype=self.dtype), np.fromiter(map(len, got), dtype=np.int32, count=len(got)) // width
        start, size = (np.cumsum(sizes, dtype=np.int32) - sizes)[which], sizes[which]
        done = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.repeat(start - done[:-1].astype(np.int32), size) + np.arange(done[-1], dtype=np.int32)].tobytes()
        own = (done[np.searchsorted(starts, offsets)] * width).tolist()
        return [self.encode(texts[k].as_py()) if apart[k] else flat[own[k] : own[k + 1]] for k in range(len(texts))]


@functools.cache
def encoder_of(tokenizer: str) -> Encoder:
    """One for each worker, which keeps what it remembers from task to task."""
    return Encoder(tokenizer)


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> doc_id and its ids with the end id, as little-endian bytes. A null text has the end id only.
    Rows keep their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            at = 0
            while at < len(texts):
                n = max(1, int(np.searchsorted(np.cumsum(pc.binary_length(texts.slice(at, STEP_ROWS)).to_numpy()), STEP_BYTES)))
                ids = encoder.encode_all(texts.slice(at, n).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([x + end for x in ids], pa.binary())], ["doc_id", "ids"])
                at += n

    return docs.select("doc_id", "text").mapInArrow(run, IDS)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", path))


class Shard:
    """Random access to the sequences of one shard: of a mapped file where it is local, else by reads of its parts."""

    def __init__(self, path: str, rows: int = ROWS):
        system, at = opened(path)
        self.file = ipc.open_file(pa.memory_map(at) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(at))
        self.rows, self.batch = rows, (-1, None)

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.batch[0] != k:
            self.batch = (k, self.file.get_batch(k))
        return self.batch[1]

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.rows + self._batch(n - 1).num_rows if n else 0

    def sequence(self, j: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids of sequence j and which of them are not padding, both views of the file."""
        batch, row = self._batch(j // self.rows), j % self.rows
        ids, mask = (batch.column(c) for c in ("ids", "mask"))
        length = ids.type.list_size
        return ids.values.to_numpy()[row * length : (row + 1) * length], mask.values.slice(row * length, length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from start on, over the ends of sequences and batches."""
        parts = []
        while n > 0:
            length = self._batch(0).column("ids").type.list_size
            k, at = divmod(start, self.rows * length)
            values = self._batch(k).column("ids").values.to_numpy()[at : at + n]
            parts.append(values)
            start, n = start + len(values), n - len(values)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


@dataclass
class Written(WriterCommitMessage):
    """A task's shard: its place among the tasks, file name without ending, ids, documents."""

    task: int
    name: str
    ids: int
    docs: int


class Sink(DataSourceArrowWriter):
    def __init__(self, path: str, length: int, rows: int, width: int):
        self.path, self.length, self.rows, self.width = path, length, rows, width

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get().partitionId()
        name = f"{task:06d}-{uuid.uuid4().hex}"
        system, at = opened(self.path)
        dtype, size = np.dtype(f"<u{self.width}"), self.rows * self.length
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), self.length)), ("mask", pa.list_(pa.bool_(), self.length))])
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        n_ids = n_docs = 0

        def sequences(ids: np.ndarray) -> pa.RecordBatch:
            whole = np.zeros(-(-len(ids) // self.length) * self.length, dtype=dtype)
            whole[: len(ids)] = ids
            columns = (pa.array(whole), pa.array(np.arange(len(whole)) < len(ids)))
            return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns], schema=schema)

        files = None
        for batch in batches:
            if not len(batch):
                continue
            if files is None:
                system.create_dir(at, recursive=True)
                sinks = [system.open_output_stream(f"{at}/{name}.{kind}.arrow") for kind in ("ids", "docs")]
                files, held = (ipc.new_file(sinks[0], schema), ipc.new_file(sinks[1], index)), np.zeros(0, dtype=dtype)
            ids = batch.column("ids").cast(pa.large_binary())
            ends = ids.buffers()[1]
            offsets = np.frombuffer(ends, dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
            flat = np.frombuffer(ids.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(dtype)
            counts = np.diff(offsets) // self.width
            starts = n_ids + np.cumsum(counts) - counts
            files[1].write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts), pa.array(counts)], schema=index))
            n_ids, n_docs = n_ids + len(flat), n_docs + len(ids)
            held = np.concatenate([held, flat])
            done = len(held) // size * size
            for lo in range(0, done, size):
                files[0].write_batch(sequences(held[lo : lo + size]))
            held = held[done:].copy()
        if files is not None:
            if len(held):
                files[0].write_batch(sequences(held))
            for f, sink in zip(files, sinks, strict=True):
                f.close()
                sink.close()
        return Written(task, name, n_ids, n_docs)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        shards = [{"name": m.name, "ids": m.ids, "docs": m.docs} for m in sorted((m for m in messages if m and m.docs), key=lambda m: m.task)]
        with system.open_output_stream(f"{at}/{MANIFEST}.new") as out:
            out.write(json.dumps({"length": self.length, "rows": self.rows, "width": self.width, "shards": shards}).encode())
        system.move(f"{at}/{MANIFEST}.new", f"{at}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        for m in messages:
            if m and m.docs:
                for kind in ("ids", "docs"):
                    system.delete_file(f"{at}/{m.name}.{kind}.arrow")


@dataclass
class Part(InputPartition):
    """A shard, and the ids of all shards before it."""

    name: str
    before: int


class Source(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        before, out = 0, []
        for shard in manifest(self.path)["shards"]:
            out.append(Part(shard["name"], before))
            before += shard["ids"]
        return out or [Part("", 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        shard = Shard(f"{self.path}/{part.name}.ids.arrow", manifest(self.path)["rows"])
        system, at = opened(f"{self.path}/{part.name}.docs.arrow")
        names = [x.split()[0] for x in DOCS.split(", ")]
        with system.open_input_file(at) as raw:
            index = ipc.open_file(raw)
            for k in range(index.num_record_batches):
                batch = index.get_batch(k)
                starts, counts = batch.column("start").to_numpy(), batch.column("n_tokens").to_numpy()
                lo = 0
                while lo < len(batch):  # as many documents as make some MB
                    n = min(len(batch) - lo, max(1, int(np.searchsorted(np.cumsum(counts[lo:]), STEP_BYTES // 4))))
                    ids = shard.ids(int(starts[lo]), int(counts[lo : lo + n].sum())).astype("<u4")
                    ends = np.concatenate([[0], np.cumsum(counts[lo : lo + n])]) * 4
                    data = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(starts[lo : lo + n] + part.before), pa.array(counts[lo : lo + n]), data], names)
                    lo += n


class TokenFiles(DataSource):
    """spark.read / df.write.format("token_files"): options path, and for writing length, rows, width."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return DOCS

    def reader(self, schema) -> Source:
        return Source(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Sink:
        path = self.options["path"]
        system, at = opened(path)
        if system.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{path} has token files already")
        return Sink(path, int(self.options.get("length", LENGTH)), int(self.options.get("rows", ROWS)), int(self.options.get("width", 4)))


def manifest(path: str) -> dict:
    """length, rows, width and the shards in order."""
    system, at = opened(f"{path}/{MANIFEST}")
    with system.open_input_stream(at) as raw:
        return json.loads(raw.read())


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS) -> None:
    """Writes docs (doc_id, text) as token files at path, a new one, in ascending order of doc_id.

    Documents are dealt out by ranges of doc_id. Rows of one doc_id are put in the order of a hash of their texts, and a
    doc_id that many rows have is spread by it and by where the rows come from. Rows without a doc_id come last."""
    docs.sparkSession.dataSource.register(TokenFiles)
    order = [doc_order(F.col("doc_id")), row_key(F.col("text")), F.spark_partition_id()]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c.alias(f"_{k}") for k, c in enumerate(order)))
    sorted_ = keyed.repartitionByRange("_0", "_1", "_2").sortWithinPartitions("_0", "_1")
    width = encoder_of(tokenizer).dtype.itemsize
    encoded(sorted_, tokenizer, end_id).write.format("token_files").options(path=path, length=length, rows=rows, width=width).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian
    unsigned 32-bit integers)."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").options(path=path).load()


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes docs as token files and reads them: doc_id, start, n_tokens, ids_crc32, for every row, repeated rows too.

    A null or empty text has the end id alone. Texts of any length are encoded whole. An empty table gives an empty one.
    Other columns are not looked at, whatever their names."""
    path = path or shared_path(docs.sparkSession, "tokens")
    write(docs, path)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
