"""Web archives (WARC 1.1) whose records are compressed one by one with a common dictionary.

A file starts with one skippable frame (magic number 0x184D2A5D) that holds a
Zstandard dictionary; every record after it, the leading ``warcinfo`` too, is a
frame of its own, compressed with that dictionary. A record can so be read alone,
and what all pages of a site share is stored once.

The dictionary is trained by one task from a sample of the records to be
archived: the ``SAMPLE`` pages of least hash, at most ``SAMPLE_BYTES`` bytes of each. Only
that fit is bounded; every page is archived whole. Where the sample is too small to train from,
files have no dictionary frame and records are plain Zstandard frames.

Of pages with equal payloads of at least ``least`` bytes the one with the smallest id is
a ``response``, every other a ``revisit`` that repeats the HTTP header (with the length
of the payload), not the payload, and names the response. Smaller payloads are all responses.

Pages are not shuffled as long as the payloads seen twice are few (a counted bound);
beyond it they are dealt by digest, a frequent one in parts. Each task writes its
own files, closed at ``FILE_BYTES``, under names of its own, and returns manifest
rows; only files the manifest names count, so a task that is lost and run again
leaves at worst unused files.

Defined results: a null payload is an empty one; a page without an id loses to any
page with one, and if no page with a payload has an id all are responses; rows that
share the smallest id of a payload are all responses; a null URL leaves its header out,
blanks, control characters and characters beyond ASCII in one are percent-encoded and
read back so; an empty table gives no file and no row. Other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import partitions, shared_folder
from corpusflow.llm.hot import join_counted
from corpusflow.llm.token_files import open_folder
from corpusflow.session import BROADCAST_ROWS, settled

SKIPPABLE = 0x184D2A5D
DICTIONARY = (0xEC30A437).to_bytes(4, "little")
DICTIONARY_BYTES = 112_640
SAMPLE = 400
SAMPLE_BYTES = 32_768
FILE_BYTES = 1 << 30
LEVEL = 3
READ_BYTES = 1 << 18
OUT_ROWS = 2_000
OUT_BYTES = 8 << 20
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, record_id string, refers_to long, payload_digest string, payload_bytes long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _name(*parts: object) -> str:
    """A record id that any task derives alike from what it names."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(map(str, parts)))}>"


def _block(headers: list[tuple[str, object]], body: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}".encode("ascii") for k, v in headers if v is not None]]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(body), b"", body, b"", b""])


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: bytes, refers_to: int | None, date: str, place: str) -> bytes:
    """One response, or without ``payload`` one revisit of the response ``refers_to``."""
    said = base32(digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    seen = payload is None
    return _block(
        [
            ("WARC-Type", "revisit" if seen else "response"),
            ("WARC-Record-ID", _name("revisit", said, page_id, place) if seen else _name("response", said, page_id)),
            ("WARC-Date", date),
            ("WARC-Target-URI", None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~%")),
            ("WARC-Payload-Digest", f"sha1:{said}"),
            ("WARC-Profile", PROFILE if seen else None),
            ("WARC-Refers-To", _name("response", said, refers_to) if seen else None),
            ("X-Page-ID", page_id),
            ("X-Refers-To-Page-ID", refers_to if seen else None),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        http + (payload or b""),
    )


class Archive:
    """Writes one file: the dictionary frame, a ``warcinfo`` record, then records, each a frame."""

    def __init__(self, path: str, dictionary: bytes | None, date: str) -> None:
        system, local = open_folder(path)
        system.create_dir(local.rsplit("/", 1)[0], recursive=True)
        self.path, self.out = path, system.open_output_stream(local, compression=None)
        self.bytes = self.records = 0
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if held:
            held.precompute_compress(level=LEVEL)
            packed = zstandard.ZstdCompressor().compress(dictionary)
            self._put(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True)
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _name("warcinfo", path)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
        self._put(self.pack.compress(_block(info, b"format: WARC File Format 1.1\r\n")))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.pack.compress(data))
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        return pa.RecordBatch.from_pydict({"path": [self.path], "records": [self.records], "bytes": [self.bytes]})


def _frames(path: str) -> Iterator[bytes]:
    """The records of a file in order; at most one record and one read are in memory."""
    system, local = open_folder(path)
    with system.open_input_stream(local, compression=None) as source:
        head = source.read(8)
        held = None
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
            kept = source.read(struct.unpack("<I", head[4:])[0])
            held = zstandard.ZstdCompressionDict(kept if kept[:4] == DICTIONARY else zstandard.ZstdDecompressor().decompress(kept))
            head = b""
        unpack = zstandard.ZstdDecompressor(dict_data=held)
        data, parts, frame = head or source.read(READ_BYTES), [], unpack.decompressobj()
        while data:
            parts.append(frame.decompress(data))
            if frame.eof:
                yield b"".join(parts)
                data, parts, frame = frame.unused_data, [], unpack.decompressobj()
            else:
                data = b""
            data = data or source.read(READ_BYTES)
        if any(parts):
            raise ValueError(f"{path} ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, block = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version[:20]!r}")
    headers = dict(line.decode("ascii").split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if block[size:] != b"\r\n\r\n":
        raise ValueError("a record is longer or shorter than it says")
    return headers, block[:size]


def _row(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        if len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError(f"{headers['WARC-Record-ID']} does not hold the payload it names")
    else:
        payload = None
    page, first, url = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID"), headers.get("WARC-Target-URI")
    return (
        None if page is None else int(page), url, headers["WARC-Type"], headers["WARC-Record-ID"],
        None if first is None else int(first), digest, size, payload,
    )


def decide(pages: DataFrame, least: int = 0, limit: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, payload (null for a revisit), payload_bytes, digest, refers_to of every page."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.unhex(F.sha1("payload")), "payload_bytes": F.octet_length("payload").cast("bigint")})
    again = settled(
        rows.filter(F.col("payload_bytes") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    known = join_counted(rows, again, "digest", "n", limit=limit)
    seen = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.select(
        "page_id", "url", F.when(~seen, F.col("payload")).alias("payload"), "payload_bytes", "digest",
        F.when(seen, F.col("first")).alias("refers_to"),
    )


def train(pages: DataFrame, sample: int = SAMPLE) -> bytes | None:
    """A dictionary from the ``sample`` pages of least hash, None if they are too few to train from."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for batch in batches for t in batch.column("part").to_pylist()]
        try:
            # Half of the sample at most, or a dictionary would be the sample itself.
            size = min(DICTIONARY_BYTES, sum(map(len, texts)) // 2)
            found = zstandard.train_dictionary(size, texts).as_bytes()
        except zstandard.ZstdError:
            return
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([found], pa.binary())})

    part = F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES)
    few = (
        pages.filter(F.length("html") > 0).select(part.alias("part"), F.xxhash64("html", "page_id").alias("place"))
        .orderBy("place").limit(sample).select("part")
    )
    # One row of at most DICTIONARY_BYTES bytes.
    found = few.mapInArrow(fit, "dictionary binary").head()
    return bytes(found[0]) if found else None


def write(
    pages: DataFrame, folder: str | None = None, *, least: int = 0, date: str = "2020-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES, sample: int = SAMPLE, limit: int = BROADCAST_ROWS,
) -> str:
    """Archives all pages; returns the folder of the manifest."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    dictionary = train(pages, sample)

    def write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, open_file = TaskContext.get().partitionId(), None
        row_no = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "digest", "refers_to")]
            for row in zip(*columns, strict=True):
                if open_file is None:
                    open_file = Archive(f"{folder}/files/{task:06d}-{uuid.uuid4().hex}.warc.zst", dictionary, date)
                # One payload at a time leaves Arrow's memory.
                open_file.add(record(*[v.as_py() for v in row], date, f"{task}-{row_no}"))
                row_no += 1
                if open_file.bytes >= file_bytes:
                    yield open_file.close()
                    open_file = None
        if open_file is not None:
            yield open_file.close()

    decide(pages, least, limit).mapInArrow(write_files, MANIFEST).write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


def read(spark: SparkSession, manifest: str, *, payloads: bool = False) -> DataFrame:
    """One row per record of the files a manifest names, checked against its digest; ``payloads`` adds those of responses."""

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in RECORD.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            held = [pa.array(v, k) for v, k in zip(columns, kinds, strict=False)]
            if payloads:
                return pa.RecordBatch.from_arrays([*held, pa.array(columns[-1], pa.binary())], [*names, "payload"])
            return pa.RecordBatch.from_arrays(held, names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for data in _frames(path):
                    headers, block = parse(data)
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    row = _row(headers, block)
                    rows.append(row if payloads else row[:-1])
                    size += len(row[-1] or b"") if payloads else 0
                    if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    # Rows of the manifest are files: no path is long, and a file is one task's work at most.
    files = spark.read.schema(MANIFEST).parquet(manifest).select("path")
    return files.repartition(max(partitions(spark), 1), "path").mapInArrow(read_files, RECORD + (", payload binary" if payloads else ""))
