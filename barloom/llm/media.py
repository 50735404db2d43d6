"""Media columns: content-addressed payloads in tar shards, read back by ranges.

Each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become an 8-bit grey PNG 64 samples wide.
A task streams its images into tar shards in the shared folder, one member a distinct digest; a row carries digest,
shard, offset and length. Copies in several shards are settled by taking the smallest place of each digest. Metadata
come from the image header alone (a range read of 33 bytes); the features need the samples and read the member's range.

A lost task writes its shards anew under new names, and the index row names the shard that its own attempt wrote. The
index is stored before it is used. Shards are written through pyarrow's file systems, so the shared folder may be local,
HDFS or an object store. Defined cases: null and empty texts have 64 zero bytes and n_bytes 0; equal texts have equal
values in all columns but the id; repeated rows each keep their row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common

WIDTH = 64
SHARD_BYTES = 64 << 20
HEADER_BYTES = 33
BATCH = 64


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """8-bit grey image, WIDTH samples a row, no row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from an image's first bytes."""
    if first[:8] != b"\x89PNG\r\n\x1a\n" or first[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", first[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = header(data)
    at, parts = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Share of samples by sixteenth of the range, in thousandths, and the mean step between neighbours in hundredths."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) * 100 // max(1, len(x) - 1)
    return ".".join(map(str, [*shares.tolist(), step]))


class _Shard:
    """A tar file written front to back; add() tells where a member's bytes begin."""

    def __init__(self, fs, folder: str) -> None:
        self.name = f"{uuid.uuid4().hex}.tar"
        self.out, self.size = fs.open_output_stream(f"{folder}/{self.name}"), 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.PAX_FORMAT)
        begin = self.size + len(head)
        pad = -len(data) % tarfile.BLOCKSIZE
        for part in (head, data, bytes(pad)):
            self.out.write(part)
            self.size += len(part)
        return begin

    def close(self) -> None:
        self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        self.out.close()


def _writer(uri: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, folder = pafs.FileSystem.from_uri(uri)
        shard, places = None, {}
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                part = batch.slice(begin, BATCH)
                rows = []
                for text in part.column(1):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    payload = raw + bytes(-len(raw) % WIDTH if raw else WIDTH)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in places:
                        if shard is None:
                            shard = _Shard(fs, folder)
                        media = to_png(payload)
                        places[digest] = (shard.name, shard.add(digest.hex() + ".png", media), len(media))
                        if shard.size >= SHARD_BYTES:
                            shard.close()
                            shard, places_done = None, places[digest]
                            places = {digest: places_done}
                    rows.append((len(raw), digest, *places[digest]))
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard is not None:
            shard.close()

    return write


def stored_payloads(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs (doc_id, text, ...) -> rows doc_id, n_bytes, digest, shard, offset, length, and the folder of the shards."""
    spark = docs.sparkSession
    folder = common.shared_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file:///") else folder
    uri = f"file://{uri}" if uri.startswith("/") else uri
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_writer(uri), f"doc_id {kind}, n_bytes long, digest binary, shard string, offset long, length long")
    return common.stored(rows), uri


def _reader(uri: str, samples: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, folder = pafs.FileSystem.from_uri(uri)
        opened, name = None, None
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                rows = []
                for digest, shard, offset, length in zip(*[c.to_pylist() for c in batch.slice(begin, BATCH).columns], strict=True):
                    if shard != name:
                        if opened:
                            opened.close()
                        opened, name = fs.open_input_file(f"{folder}/{shard}"), shard
                    width, height, depth = header(opened.read_at(HEADER_BYTES, offset))
                    row = [digest, width, height, depth]
                    if samples:
                        media = opened.read_at(length, offset)
                        payload = from_png(media)
                        row += [len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).digest(), features(payload)]
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=(HEAD + SAMPLES)[: len(rows[0])])
        if opened:
            opened.close()

    return read


HEAD = ["digest", "width", "height", "depth"]
SAMPLES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
HEAD_TYPES = "digest binary, width long, height long, depth long"
SAMPLE_TYPES = HEAD_TYPES + ", payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def read_back(rows: DataFrame, uri: str, samples: bool = True) -> DataFrame:
    """Rows with metadata, and with samples also the features, each distinct digest read once, in shard order."""
    places = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.shard", "p.offset", "p.length")
    places = places.repartition("shard", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("shard", "offset")
    facts = common.stored(places.mapInArrow(_reader(uri, samples), SAMPLE_TYPES if samples else HEAD_TYPES))
    return common.fetch(rows.select("doc_id", "n_bytes", "digest"), "digest", facts, ["doc_id"], salts=common.SALTS)


def media_columns(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, digest, width, height, depth, payload and media columns, feature."""
    rows = read_back(*stored_payloads(docs))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})
