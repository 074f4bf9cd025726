"""WARC archives: written as segmented records with chunked bodies, read back by segment reassembly.

Archives are written by Spark's text writer, whose line separator is the end of a record, into the shared folder; they
are read by Spark's binary reader, so any store that Spark reaches will do. A body is an HTTP response in chunked
transfer framing. A body over segment_bytes goes on in continuation records. On reading, whole records are decoded
where they are; only segments are shuffled, grouped by the identifier of their origin record, put in the order of their
numbers, held against the stated total length and then decoded. Each group is one record's payload.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import cut, shared_path

#: Payloads from this size on are written once; bytes of a record's block (a larger one goes on in continuations) and of
#: a chunk; records in a file; bytes of records that are handed on at a time.
REVISIT_BYTES, SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS, STEP_BYTES = 1000, 1 << 13, 1 << 13, 2000, 4 << 20
END, DATE = "\r\n\r\n", "2000-01-01T00:00:00Z"
SPLIT = END.encode()
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
PARTS = "origin string, segment int, total long, block binary, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def with_types(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages with payload_digest, payload_bytes, record_type and refers_to, and with at and refers_at: which row it is
    and which one it refers to. Rows of the largest page_id are responses, all of them where rows repeat. A null page_id
    is smaller than any; where a group has none else, all are responses."""
    html = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select("page_id", "url", "html", F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("at"))
    largest = sized.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("largest"), F.max_by("at", "page_id").alias("largest_at"), F.count("*").alias("copies"))
    # Checkpointed, so that the join has two shuffles of its own and Spark splits a hot payload.
    largest = cut(largest.where("copies > 1 and largest is not null").drop("copies"))
    found = sized.join(largest, ["payload_digest", "payload_bytes"], "left")
    again = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return found.select(
        "page_id", "url", "html", "payload_digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("largest")).alias("refers_to"), "at", F.when(again, F.col("largest_at")).alias("refers_at"),
    )


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """UTF-8 in pieces of whole characters that take at most size bytes, but one character at least."""
    at, n = 0, len(data)
    while at < n:
        stop = min(at + size, n)
        while at < stop < n and data[stop] & 0xC0 == 0x80:
            stop -= 1
        if stop == at:
            stop += 1
            while stop < n and data[stop] & 0xC0 == 0x80:
                stop += 1
        yield data[at:stop]
        at = stop


def chunked(text: str | bytes, size: int = CHUNK_BYTES) -> bytes:
    """text in chunked transfer framing; chunks are pieces() of size bytes."""
    data = text.encode() if isinstance(text, str) else text
    return b"".join(x for p in pieces(data, size) for x in (b"%x\r\n" % len(p), p, b"\r\n")) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it should")
        out.append(body[line + 2 : at])
        at += 2


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the end that the writer puts after it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + SPLIT + block


def record_id(own: str, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}/{segment}')}>"


def records_of(row: dict, own: str, segment_bytes: int, chunk_bytes: int, refers_own: str | None = None) -> Iterator[bytes]:
    """The record of a page, or its segments. own: what tells this row apart; refers_own: the row that it refers to."""
    uri = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = {"WARC-Record-ID": record_id(own), "WARC-Date": DATE, "WARC-Target-URI": uri if row["url"] is not None else None, "WARC-Payload-Digest": f"sha1:{row['payload_digest']}", "X-Payload-Length": row["payload_bytes"], "X-Page-Id": row["page_id"]}
    if row["record_type"] == "revisit":
        refers = {"WARC-Refers-To": record_id(refers_own) if refers_own else None, "X-Refers-To-Page-Id": row["refers_to"]}
        fields |= refers | {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Type": "application/http;msgtype=response"}
        yield record(fields, HEAD)
        return
    block = HEAD + chunked(row["html"] or "", chunk_bytes)
    fields |= {"WARC-Type": "response", "Content-Type": "application/http;msgtype=response"}
    first, *others = pieces(block, segment_bytes)
    if not others:
        yield record(fields, block)
        return
    yield record(fields | {"WARC-Segment-Number": 1}, first)
    for k, part in enumerate(others, 2):
        last = {"WARC-Segment-Total-Length": len(block)} if k == len(others) + 1 else {}
        yield record({"WARC-Record-ID": record_id(own, k), "WARC-Date": DATE, "WARC-Type": "continuation", "WARC-Segment-Origin-ID": record_id(own), "WARC-Segment-Number": k} | last, part)


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Writes with_types() rows as archives, a file for each task and every file_records records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ready, size = [], 0
            for row in batch.to_dict("records"):
                row |= {k: None if pd.isna(row[k]) else int(row[k]) for k in ("page_id", "refers_to", "refers_at")}
                refers_own = None if row["refers_at"] is None else f"{row['refers_to']}/{row['refers_at']}"
                for text in records_of(row, f"{row['page_id']}/{row['at']}", segment_bytes, chunk_bytes, refers_own):
                    ready.append(text)
                    size += len(text)
                if size > STEP_BYTES:
                    yield pd.DataFrame({"value": ready})
                    ready, size = [], 0
            yield pd.DataFrame({"value": ready})

    rows = pages.select("url", "html", "payload_digest", "payload_bytes", "record_type", "at", *(F.col(c).cast("string") for c in ("page_id", "refers_to", "refers_at")))
    texts = rows.mapInPandas(run, "value binary").select(F.col("value").cast("string"))
    texts.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive, plain or gzipped in one or more members."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError("a record does not start where it should")
        stop = data.index(b"\r\n\r\n", at)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:stop].decode().split("\r\n")[1:])}
        at = stop + 4 + int(fields["content-length"])
        yield fields, data[stop + 4 : at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        at += 4


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, decoded where it is chunked."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n"))
    return unchunked(body) if framed else body


def _checked(block: bytes, digest: str) -> bytes:
    payload = payload_of(block)
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"a payload does not have its digest {digest}")
    return payload


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: page_id, url, record_type, refers_to, payload_bytes, payload_digest,
    payload (null for revisits). Raises where segments are missing, doubled or too short, or a digest differs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch.content:
                rows: list[tuple] = []
                size = 0
                for f, block in parse(bytes(data)):
                    segment = int(f.get("warc-segment-number", 0))
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    to = f.get("x-refers-to-page-id")
                    origin = f.get("warc-segment-origin-id") or f["warc-record-id"]
                    body = None if f["warc-type"] == "revisit" else block if segment else _checked(block, digest)
                    length = f.get("x-payload-length")
                    rows.append((origin, segment, int(f.get("warc-segment-total-length", 0)), body, f.get("x-page-id"), f.get("warc-target-uri"), f["warc-type"], to, length, digest))
                    size += len(block)
                    if size > 1 << 22:
                        yield frame(rows)
                        rows, size = [], 0
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in PARTS.split(", ")])
        return out.astype({k: "Int64" for k in ("page_id", "refers_to", "payload_bytes")}) if len(out) else out

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payloads = []
            for origin, digest, parts in zip(batch.origin, batch.payload_digest, batch.parts, strict=True):
                parts = sorted(parts, key=lambda p: p["segment"])
                block = b"".join(bytes(p["block"]) for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != max(p["total"] for p in parts):
                    raise ValueError(f"the segments of {origin} are not whole")
                payloads.append(_checked(block, digest))
            out = batch.assign(payload=payloads)[columns]
            yield out.astype({k: "Int64" for k in ("page_id", "refers_to", "payload_bytes")})

    columns = [x.split()[0] for x in RECORDS.split(", ")]
    parts = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, PARTS)
    whole = parts.where("segment = 0").withColumnRenamed("block", "payload").select(columns)
    # A group is one record: its segments, and what the first of them says of it.
    fields = [F.max_by(c, -F.col("segment")).alias(c) for c in columns if c != "payload"]
    groups = parts.where("segment > 0").groupBy("origin").agg(*fields, F.collect_list(F.struct("segment", "total", "block")).alias("parts"))
    return whole.unionByName(groups.mapInPandas(join, RECORDS))


def round_trip(pages: DataFrame, path: str | None = None, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html; null html: empty) as archives and reads them: page_id, payload_bytes,
    payload_digest, record_type, refers_to for every row, repeated rows too. An empty table gives an empty one. Other
    columns are not looked at, whatever their names. Payloads of any length go through, in segments. Sizes and digests of
    responses are those of the payloads read."""
    path = path or shared_path(pages.sparkSession, "warc")
    write(with_types(pages), path, segment_bytes, chunk_bytes)
    found = read(pages.sparkSession, path)

    def known(of: Column, stated: str) -> Column:
        return F.when(F.col("payload").isNull(), F.col(stated)).otherwise(of)

    return found.select("page_id", known(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"), known(F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type", "refers_to")
