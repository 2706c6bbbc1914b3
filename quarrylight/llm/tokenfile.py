"""Token-id files: one independent zstandard frame a document, a trailing seek table, and a checksum for each frame.

Layout of a file: data frames in document order, a skippable frame that holds our index (document ids, token counts),
and last the seek table of the public zstandard seekable format (frame sizes and the low 32 bits of each frame's XXH64),
so that a reader finds a document from the end of the file and decompresses its frame alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import fresh_path, map_texts, materialise
from quarrylight.llm.tokens import END_ID, TOKENIZER, encoder

# Magic numbers of the zstandard formats.
SEEK_FRAME, INDEX_FRAME, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
CHECKSUMS = 0x80
INDEX_HEAD = struct.Struct("<4sIQ")
MANIFEST = "part int, path string, n_docs long, n_tokens long, first_start long"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it; plain paths and file:, hdfs:, s3: and gs: addresses."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes documents one by one; ``close`` adds the index and the seek table."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, level: int = 3) -> None:
        self.sink, self.dtype = sink, dtype
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.table: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = np.ascontiguousarray(ids, self.dtype).tobytes()
        frame = self.pack.compress(raw)
        self.sink.write(frame)
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        known = np.array([i is not None for i in self.ids], "u1")
        ids = np.array([i or 0 for i in self.ids], "<i8")
        head = INDEX_HEAD.pack(self.dtype.str.encode().ljust(4), self.dtype.itemsize, len(self.ids))
        body = head + ids.tobytes() + known.tobytes() + np.array(self.counts, "<u4").tobytes()
        self.sink.write(struct.pack("<II", INDEX_FRAME, len(body)) + body)
        # The index is a frame as any other to readers of the seekable format.
        rows = [*self.table, (len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        entries = np.array(rows, "<u4").tobytes() + struct.pack("<IBI", len(rows), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SEEK_FRAME, len(entries)) + entries)
        self.sink.close()


class Entry(NamedTuple):
    doc_id: int | None
    n_tokens: int
    at: int
    packed: int
    checksum: int


class FrameReader:
    """Reads the tables from the end of the file, then any document by its number."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        end = source.size()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a token file: the seek table is missing")
        source.seek(end - 9 - 12 * n)
        rows = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        starts = np.concatenate([[0], np.cumsum(rows[:, 0].astype(np.int64))])
        source.seek(int(starts[n - 1]) + 8)
        body = source.read(int(rows[-1, 0]) - 8)
        kind, _, docs = INDEX_HEAD.unpack_from(body)
        self.dtype = np.dtype(kind.decode().strip())
        at = INDEX_HEAD.size
        ids = np.frombuffer(body, "<i8", docs, at)
        known = np.frombuffer(body, "u1", docs, at + 8 * docs)
        counts = np.frombuffer(body, "<u4", docs, at + 9 * docs)
        self.entries = [Entry(int(i) if k else None, int(c), int(a), int(p), int(x)) for i, k, c, a, (p, _, x) in zip(ids, known, counts, starts, rows[:docs], strict=False)]
        self.unpack = zstandard.ZstdDecompressor()

    def read(self, number: int) -> np.ndarray:
        entry = self.entries[number]
        self.source.seek(entry.at)
        raw = self.unpack.decompress(self.source.read(entry.packed))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != entry.checksum:
            raise ValueError(f"document {entry.doc_id}: the frame's checksum differs")
        return np.frombuffer(raw, self.dtype)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encoder(tokenizer: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            for first, ids, starts in words.encode_column(batch.column("text"), END_ID):
                n = len(starts) - 1
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((starts * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("print").slice(first, n), packed], names=["doc_id", "print", "ids"])

    return encode


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, print, ids): every text's ids with the end id, as little-endian bytes, and a hash of the text; null counts as empty."""
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), "text")
    return map_texts(own, _encoder(tokenizer), "doc_id long, print long, ids binary")


def _writer(folder: str, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(kind)
        part = TaskContext.get().partitionId()
        store, base = filesystem(folder)
        # A name of the attempt's own: only files named in the manifest of finished tasks count.
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.tokens.zst"
        out, n_docs, n_tokens = None, 0, 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                out = out or FrameWriter(store.open_output_stream(f"{base}/{name}", compression=None), dtype)
                ids = np.frombuffer(raw.as_buffer(), dtype)
                out.add(doc_id, ids)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64()), "first_start": pa.array([0], pa.int64())})

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write every document's ids (plus the end id) in ascending doc_id order and return the manifest, one row a file.

    Texts are encoded where they are read; the ids are range-partitioned by doc_id and a hash of the text (the sampler
    sees those alone) and sorted inside each partition, so a file is one range and no task sees more than its range. A
    null text counts as empty; null ids come first; rows of one id are ordered by the hash. An empty table writes no
    file and gives an empty manifest. Extra columns are ignored.
    """
    spark = docs.sparkSession
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    order = [F.col("doc_id").asc_nulls_first(), F.col("print").asc()]
    encoded = materialise(encode_documents(docs, tokenizer), "encoded").repartitionByRange(*order).sortWithinPartitions(*order)
    done = sorted(map_texts(encoded.select("doc_id", "ids"), _writer(folder, encoder(tokenizer).dtype.str), MANIFEST).collect(), key=lambda r: r["part"])  # one small row a file
    rows, start = [], 0
    for r in done:
        rows.append((r["part"], r["path"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return spark.createDataFrame(rows, MANIFEST)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("first_start").to_pylist(), strict=True):
            store, name = filesystem(path)
            with store.open_input_file(name) as source:
                reader = FrameReader(source)
                rows = []
                for k, entry in enumerate(reader.entries):
                    rows.append((entry.doc_id, start, entry.n_tokens, ids_crc32(reader.read(k)), path))
                    start += entry.n_tokens
            names, types = ("doc_id", "start", "n_tokens", "ids_crc32", "path"), [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row a document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, path.

    Each frame is decompressed alone and held against its checksum; a task reads one file at a time.
    """
    parts = max(1, manifest.count())
    return manifest.select("path", "first_start").repartition(parts).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def documents_in(path: str, numbers: list[int]) -> list[np.ndarray]:
    """The ids of some documents of one file, by their place in it; no other frame is read."""
    store, name = filesystem(path)
    with store.open_input_file(name) as source:
        reader = FrameReader(source)
        return [reader.read(n) for n in numbers]


def token_file_digest(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write the token files into the shared folder, read them back, and return what they hold of each document."""
    return read_token_files(write_token_files(docs, fresh_path(docs.sparkSession, "tokens"), tokenizer))
