"""Token ids of documents as binary files with Elias-Fano coded boundaries.

One file holds a range of documents in ascending id order::

    ids        all ids of the file one after the other, 2 or 4 bytes each, little-endian
    keys       document ids, 8 bytes each, little-endian; null ids come first
    low, high, sample   Elias-Fano code of the ends of the documents (see elias_fano.py)
    footer     10 unsigned 64-bit numbers: documents, ids, bytes per id, null keys, low width,
               bytes of low, high, sample; format version; magic number

The footer comes last, so a file is written in one pass with only the boundaries
in memory. Boundaries cost about 2 + log2(ids per document) bits; ``select`` gives
the end of any document without reading a table of offsets.

Rows are range-partitioned by document id (and a hash of the text, so one id held
by a third of all rows still spreads) and sorted inside; each task writes a file
under a name of its own and returns one manifest row. Only files named in the
written manifest count, so a task that is lost and run again leaves at worst an
unused file. All files lie in the shared folder and are opened with
``pyarrow.fs`` by the address of that folder.

Defined results: null and empty texts are a document of the end id alone;
repeated rows are documents of their own; equal ids are ordered by a hash of the
text; an empty table gives no file and no row. Other columns are not written.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm.common import partitions, shared_folder
from corpusflow.llm.elias_fano import EliasFano
from corpusflow.llm.tokenise import encoder, forget

MAGIC = int.from_bytes(b"EFTOKENS", "little")
VERSION = 1
FOOTER = 10
READ_DOCS = 2_000
READ_IDS = 4_000_000
GROUP_DOCS = 200
MANIFEST = "shard int, path string, documents long, ids long"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


class TokenFile:
    """Reads one file: boundaries by Elias-Fano, ids by range."""

    def __init__(self, path: str) -> None:
        system, local = open_folder(path)
        self.file = system.open_input_file(local)
        size = self.file.size()
        footer = np.frombuffer(self.file.read_at(8 * FOOTER, size - 8 * FOOTER), "<u8").astype(object)
        self.documents, self.ids, self.width, self.nulls, low_width, low, high, sample, version, magic = map(int, footer)
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path} is not a token file")
        self.keys_at = self.ids * self.width
        at = self.keys_at + 8 * self.documents
        parts = []
        for length in (low, high, sample):
            parts.append(self.file.read_at(length, at))
            at += length
        self.ends = EliasFano.decode(self.documents, low_width, *parts)

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Start of document ``first`` and the ends of first..last-1."""
        return np.append(self.ends.slice(first - 1, first) if first else [0], self.ends.slice(first, last)).astype(np.int64)

    def keys(self, first: int, last: int) -> list[int | None]:
        keys = np.frombuffer(self.file.read_at(8 * (last - first), self.keys_at + 8 * first), "<i8").tolist()
        return [None if first + k < self.nulls else key for k, key in enumerate(keys)]

    def tokens(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((stop - start) * self.width, start * self.width), f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


def write(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    folder: str | None = None,
    end_id: int = 1,
    files: int | None = None,
    remembered: int | None = None,
) -> tuple[str, str]:
    """Writes the ids of all documents; returns the folders of files and manifest.

    With ``remembered``, bytes of pieces a generation, a task also drops its pieces when it ends: for workers that
    carry the memory of other stages.
    """
    spark = docs.sparkSession
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    digest = hashlib.sha256(definition.encode()).hexdigest()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    folder = folder or shared_folder(spark, "tokens")
    shipped = spark.sparkContext.broadcast(definition)

    def write_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path = f"{folder}/files/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        known, out, system = encoder(shipped.value, digest, remembered), None, None
        counts, keys, nulls = [], [], 0
        for batch in batches:
            if out is None:
                system, local = open_folder(path)
                system.create_dir(open_folder(f"{folder}/files")[1], recursive=True)
                out = system.open_output_stream(local)
            nulls += batch.column("key").null_count
            keys.append(batch.column("key").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            texts = batch.column("text")
            for first in range(0, batch.num_rows, GROUP_DOCS):
                for ids in known.encode(texts.slice(first, GROUP_DOCS).to_pylist()):
                    numbers = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                    counts.append(len(numbers))
                    out.write(numbers.astype(f"<u{width}").tobytes())
        if out is None:
            return
        ends = np.cumsum(np.array(counts, np.int64))
        code = EliasFano.encode(ends)
        low, high, sample = code.sections()
        for part in (np.concatenate(keys).tobytes(), low, high, sample):
            out.write(part)
        footer = [len(counts), int(ends[-1]), width, nulls, code.width, len(low), len(high), len(sample), VERSION, MAGIC]
        out.write(np.array(footer, "<u8").tobytes())
        out.close()
        if remembered is not None:
            forget()
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "path": [path],
                "documents": [len(counts)],
                "ids": [int(ends[-1])],
            }
        )

    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    (
        docs.select(F.col("doc_id").cast("bigint").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(files or partitions(spark), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(write_file, MANIFEST)
        .write.parquet(f"{folder}/manifest")
    )
    return f"{folder}/files", f"{folder}/manifest"


def read(spark: SparkSession, manifest: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    named = spark.read.schema(MANIFEST).parquet(manifest)
    # One row per file meets here, never documents.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    files = named.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("shard", "path", "base")

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_file(row["path"], row["base"])

    return files.repartition(max(partitions(spark), 1), "shard").mapInArrow(
        read_files, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_file(path: str, base: int) -> Iterator[pa.RecordBatch]:
    held = TokenFile(path)
    for first in range(0, held.documents, READ_DOCS):
        last = min(first + READ_DOCS, held.documents)
        bounds = held.bounds(first, last)
        sums, a = [], 0
        while a < last - first:
            # As many documents as fit one read; a longer one is read alone.
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + READ_IDS, "right")) - 1)
            ids = held.tokens(int(bounds[a]), int(bounds[b])).astype("<u4")
            sums += [
                zlib.crc32(ids[bounds[k] - bounds[a] : bounds[k + 1] - bounds[a]].tobytes()) for k in range(a, b)
            ]
            a = b
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(held.keys(first, last), pa.int64()),
                "start": bounds[:-1] + base,
                "n_tokens": np.diff(bounds),
                "ids_crc32": pa.array(sums, pa.int64()),
            }
        )
    held.close()


def write_and_read(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the files and returns what they hold, one row per document."""
    _, manifest = write(docs, tokenizer_path, **options)
    return read(docs.sparkSession, manifest)
