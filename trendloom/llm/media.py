"""Media columns: content-addressed payloads in tar shards.

Each task packs the payloads of its rows into tar files of the store's folder, one entry per distinct
payload of a shard, named by its SHA-256. Rows carry digest, shard (its whole address), offset and length, so
`read_payload` needs nothing but a row. Metadata columns are filled by range reads of an entry's header alone, and
features by reading the entry back, in tasks balanced by the bytes that they read.

A payload is a text's UTF-8 bytes, filled up with bytes 0 to a positive multiple of 64, kept without loss as
an 8-bit greyscale PNG image 64 samples wide. A shard's name is new for each attempt of a task, and rows only
name shards of attempts that ended: lost executors leave at most files that nothing refers to. Copies of
a text in other shards are stored once in each, so nothing has to be shuffled by content.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.common import materialize, only_columns
from trendloom.storage import shared_dir

WIDTH = 64
SHARD_BYTES = 256 << 20
#: Bytes of a shard that are read back in one go, and that a task reads back at most, about.
RUN_BYTES = 16 << 20
TASK_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # signature and IHDR chunk


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """Rows of 64 samples, each with filter type 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 2)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits a sample and colour type from the first HEADER_BYTES of a PNG."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(media: bytes) -> bytes:
    """The samples of an image that `to_png` made."""
    width, height, *_ = read_header(media)
    at, body = 8, []
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        if kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow knows (local, HDFS, S3, GCS)."""
    return pafs.FileSystem.from_uri("file://" + url[5:] if url.startswith("file:/") and not url.startswith("file://") else url)


class Shard:
    """A tar file being written; keeps where each digest's entry lies."""

    def __init__(self, folder: str):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.tar"
        self.url = f"{folder}/{name}"
        self.stream, self.size, self.places = fs.open_output_stream(f"{path}/{name}"), 0, {}

    def put(self, digest: str, media: bytes) -> tuple[int, int]:
        entry = tarfile.TarInfo(f"{digest}.png")
        entry.size = len(media)
        self.stream.write(entry.tobuf(tarfile.USTAR_FORMAT))
        self.stream.write(media + bytes(-len(media) % 512))
        self.places[digest] = self.size + 512, len(media)
        self.size += 512 + len(media) + -len(media) % 512
        return self.places[digest]

    def close(self) -> None:
        self.stream.write(bytes(1024))
        self.stream.close()


def store(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the payloads of `docs(doc_id, text)` into tar shards under `folder`.

    Returns, read from a table that is written first, `doc_id, n_bytes, payload_bytes, digest, shard, offset, length`
    of every row. A null text is the empty one; repeated rows each give a row.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            rows = []
            for text in batch.column(1):
                payload, n = payload_of(text.as_py())
                digest = hashlib.sha256(payload).hexdigest()
                if shard is None or shard.size >= shard_bytes:
                    if shard:
                        shard.close()
                    shard = Shard(folder)
                place = shard.places.get(digest) or shard.put(digest, to_png(payload))
                rows.append((n, len(payload), digest, shard.url, *place))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows, strict=True))], names)
        if shard:
            shard.close()

    index = only_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long")
    return materialize(index, "media-index")


class Reader:
    """Range reads of shards; keeps the last file open."""

    def __init__(self) -> None:
        self.url, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.url:
            if self.file:
                self.file.close()
            fs, path = filesystem(shard)
            self.file, self.url = fs.open_input_file(path), shard
        return self.file.read_at(length, offset)


def read_payload(shard: str, offset: int, length: int, n_bytes: int) -> bytes:
    """A row's text in UTF-8, from what the row carries alone."""
    return from_png(Reader().read(shard, offset, length))[:n_bytes]


def by_bytes(index: DataFrame) -> DataFrame:
    """The index dealt so that tasks read about equal bytes, each in order of shards and offsets."""
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // TASK_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, -(-total // RUN_BYTES)), 1)
    return index.repartition(tasks, "shard", F.floor(F.col("offset") / RUN_BYTES)).sortWithinPartitions("shard", "offset")


def _per_entry(index: DataFrame, compute, schema: str) -> DataFrame:
    """Adds `compute(reader, row)`'s columns to each row; rows of one entry in turn share its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known, at = Reader(), {}, None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True)
            out = []
            for shard, offset, length in rows:
                if shard != at:
                    known, at = {}, shard
                if offset not in known:
                    known[offset] = compute(reader, shard, offset, length)
                out.append(known[offset])
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    added = index.sparkSession.createDataFrame([], schema).schema
    names = [*index.columns, *added.names]
    return index.mapInArrow(run, type(index.schema)([*index.schema.fields, *added.fields]))


def fill_metadata(index: DataFrame) -> DataFrame:
    """Adds `width, height, bits, colour`, from a range read of each entry's header alone."""

    def compute(reader: Reader, shard: str, offset: int, length: int) -> tuple:
        return read_header(reader.read(shard, offset, HEADER_BYTES))

    return _per_entry(index, compute, "width long, height long, bits long, colour long")


def read_back(index: DataFrame) -> DataFrame:
    """Adds `payload_sha256, tail_crc32, media_sha256, mean_level` of the stored bytes, read back whole."""

    def compute(reader: Reader, shard: str, offset: int, length: int) -> tuple:
        media = reader.read(shard, offset, length)
        payload = from_png(media)
        return (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), hashlib.sha256(media).hexdigest(),
                float(np.frombuffer(payload, np.uint8).mean()))

    return _per_entry(index, compute, "payload_sha256 string, tail_crc32 long, media_sha256 string, mean_level double")


def store_folder(spark: SparkSession) -> str:
    """Where shards lie if no folder is given: beside the intermediates, not among them, so they last as long as the shared folder."""
    return f"{shared_dir(spark)}/trendloom-media"


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores, fills and reads back every row of `docs(doc_id, text)`; see `store`, `fill_metadata`, `read_back`.

    `folder` is the store (see `store_folder`); shards of earlier calls stay in it as they are. `feature` says what the image is
    and its mean level. `shard`, `offset`, `media_bytes` and `n_bytes` are what `read_payload` takes.
    """
    found = read_back(fill_metadata(by_bytes(store(docs, folder or store_folder(docs.sparkSession)))))
    feature = F.format_string("png:%dx%d:%dbit:colour%d:mean=%.4f", "width", "height", "bits", "colour", "mean_level")
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256",
        feature.alias("feature"), "digest", "shard", "offset")
