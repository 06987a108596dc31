"""WARC archives with one Zstandard frame per record and a dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import attach, stored, table
from cladespark.session import shared_folder

DICTIONARY_FRAME = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_type string, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store that a URI names, and the path in it; a bare path is a local one."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def http_head(payload_bytes: int) -> bytes:
    return (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n"
    ).encode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.rpartition(":")[2].rstrip(">")
    return None if name == "none" else int(name)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, keep_id: int | None, revisit: bool) -> bytes:
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", page_urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else page_urn(page_id)[1:-1]),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", page_urn(keep_id))]
    return record(fields, http_head(len(payload)) + (b"" if revisit else payload))


def train(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A dictionary from records; too few of them to train on become its content as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8, accel=4)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveFile:
    """One archive: ``records`` is what it will hold; ``close`` trains, compresses and writes it."""

    def __init__(self, folder: str, dictionary_bytes: int, sample_bytes: int):
        self.folder, self.dictionary_bytes, self.sample_bytes = folder, dictionary_bytes, sample_bytes
        self.records: list[tuple[int | None, str, bytes]] = []
        self.size = 0

    def add(self, page_id: int | None, kind: str, data: bytes) -> None:
        self.records.append((page_id, kind, data))
        self.size += len(data)

    def close(self) -> pa.RecordBatch:
        # The sample is spread over the file: every n-th record, of about sample_bytes in all.
        step = -(-self.size // self.sample_bytes)
        dictionary = train([data for _, _, data in self.records[::step]], self.dictionary_bytes)
        compress = zstandard.ZstdCompressor(level=3, dict_data=dictionary).compress
        body = dictionary.as_bytes()
        out = io.BytesIO()
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info:0>"), ("WARC-Date", DATE),
                ("Content-Type", "application/warc-fields")]
        out.write(compress(record(info, b"format: WARC File Format 1.1\r\n")))
        path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        rows = []
        for page_id, kind, data in self.records:
            frame = compress(data)
            rows.append((page_id, kind, path, out.tell(), len(frame)))
            out.write(frame)
        store, place = filesystem(path)
        with store.open_output_stream(place, compression=None) as sink:
            sink.write(out.getbuffer())
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def write_warc(
    pages: DataFrame,
    folder: str,
    min_revisit_bytes: int = 1000,
    file_bytes: int = 32 << 20,
    dictionary_bytes: int = 64 << 10,
    sample_bytes: int = 4 << 20,
) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``folder``; the index of the records written.

    Every file starts with a skippable frame that holds a dictionary trained on its own
    records (a spread sample of about ``sample_bytes``), then one frame per record compressed with
    it. Files are closed at ``file_bytes`` of records, so a task holds one file at most.
    Of records with equal payloads of at least ``min_revisit_bytes`` the largest page_id is
    the response and the others revisit it, also rows that differ in url alone. Rows that repeat
    a page_id are all written; those of the largest id are all responses. A null html is an
    empty payload, a null url becomes the page's URN, a null page_id the URN ``none``; it stands for a
    payload only where no row with an id has it. An empty table writes no file. A
    task that is run again writes new files; only files in the returned index count.
    """
    store, place = filesystem(folder)
    store.create_dir(place, recursive=True)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"),
        F.sha1(html).alias("digest"), F.sha2(html, 256).alias("same"),
    )
    large = F.octet_length("payload") >= min_revisit_bytes
    groups = rows.where(large).groupBy("same").agg(F.max("page_id").alias("keep_id"), F.count("*").alias("n"))
    rows = attach(rows, stored(groups.where("n > 1"), "payload-groups"), ["same"], "n", ["keep_id", "n"])
    revisit = F.col("n").isNotNull() & F.coalesce(F.col("page_id") != F.col("keep_id"), F.col("keep_id").isNotNull())
    rows = rows.select("page_id", "url", "payload", "digest", "keep_id", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = ArchiveFile(folder, dictionary_bytes, sample_bytes)
        for batch in batches:
            for page_id, url, payload, digest, keep_id, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = "revisit" if again else "response"
                file.add(page_id, kind, page_record(page_id, url, payload, digest, keep_id, again))
                if file.size >= file_bytes:
                    yield file.close()
                    file = ArchiveFile(folder, dictionary_bytes, sample_bytes)
        if file.records:
            yield file.close()

    return stored(rows.mapInArrow(write, INDEX), "warc-index")


def dictionary_of(head: bytes) -> zstandard.ZstdCompressionDict:
    magic, size = struct.unpack("<II", head[:8])
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with a dictionary frame")
    return zstandard.ZstdCompressionDict(head[8 : 8 + size])


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed archive."""
    while line := stream.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"a record starts with {line[:40]!r}")
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            fields[name.decode()] = value.strip().decode()
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, block


def read_file(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of one archive, decompressed with the dictionary at its start."""
    store, place = filesystem(path)
    with store.open_input_stream(place, compression=None) as source:
        head = source.read(8)
        head += source.read(struct.unpack("<II", head)[1])
        reader = zstandard.ZstdDecompressor(dict_data=dictionary_of(head)).stream_reader(source, read_across_frames=True)
        yield from parse(io.BufferedReader(reader, 1 << 20))


def read_record(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index."""
    store, place = filesystem(path)
    with store.open_input_file(place) as source:
        head = source.read(8)
        head += source.read(struct.unpack("<II", head)[1])
        source.seek(offset)
        data = zstandard.ZstdDecompressor(dict_data=dictionary_of(head)).decompressobj().decompress(source.read(length))
    return next(parse(io.BytesIO(data)))


def read_warc(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The page records of every file of an index, one task's worth of files at a time.

    Digest and length come from the archive: computed on a response's payload and checked against its header, and
    from the headers of a revisit. ``payload`` is null for revisits, or throughout without ``payloads``.
    """
    files = index.select("file").distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for fields, block in read_file(path):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: {fields['WARC-Record-ID']} is damaged")
                    to = page_of(fields["WARC-Refers-To"]) if revisit else None
                    rows.append((page_of(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], to,
                                 payload if payloads and not revisit else None))
                    held += len(payload)
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    # A file is one small row here: the number of tasks is said, or adaptive execution would read all files in one.
    return files.repartition(max(1, files.count()), "file").mapInArrow(read, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(table(spark, sf_dir, "pages"), shared_folder(spark, "archives"))
    return read_warc(index, payloads=False).drop("payload")


SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER w
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER w
            THEN max(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""
