"""Media columns: texts as content-addressed greyscale images in tar shards.

A payload (the text's UTF-8 bytes and zero bytes up to a positive multiple of 64) becomes the 8-bit samples of a PNG, 64
samples a row. Each task collects images into tar shards of about ``SHARD_BYTES``; inside a shard an image is stored once
under the SHA-256 of its bytes, and the shard's first member lists its rows: key, offset, length, digest, unpadded bytes.
Spark's own writer commits the shards (one row is one file, and the last zero byte of a tar is the row's line end), so
they may lie in any store. Readers use the list and ranges: the header range of each image fills width, height and
bits; payload features read the rest.

Defined cases: null text counts as empty (64 zero bytes); a very long text, longer than a shard, gets a shard of its own;
repeated rows and equal texts under differing or null keys point at one image of their shard; an empty table writes no shard and
reads as no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import tarfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SHARD_BYTES = 16 << 20
UNIT = 64
#: PNG's signature, and the length of signature and header chunk.
PNG, HEADER = b"\x89PNG\r\n\x1a\n", 33
INDEX = "rows.jsonl"


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """The payload as an 8-bit greyscale image without filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from an image's first 33 bytes."""
    if head[:8] != PNG or head[12:16] != b"IHDR":
        raise ValueError("not an image header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(image: bytes) -> bytes:
    """The payload of an image that :func:`to_png` wrote; checks every chunk."""
    width, height, _ = png_header(image[:HEADER])
    at, data = 8, b""
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged image")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def _member(name: str, body: bytes) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = len(body)
    return info.tobuf(tarfile.USTAR_FORMAT) + body + bytes(-len(body) % 512)


class ShardWriter:
    """One tar shard in memory."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.at: dict[bytes, tuple[int, int, str]] = {}
        self.body = io.BytesIO()

    def add(self, key: str | None, text: bytes) -> None:
        payload = payload_of(text)
        seen = self.at.get(hashed := hashlib.sha256(payload).digest())
        if seen is None:
            image = to_png(payload)
            digest = hashlib.sha256(image).hexdigest()
            seen = self.at[hashed] = (self.body.tell() + 512, len(image), digest)
            self.body.write(_member(f"{digest}.png", image))
        self.rows.append([key, *seen, len(text)])

    @property
    def size(self) -> int:
        return self.body.tell() + 128 * len(self.rows)

    def tar(self) -> bytes:
        """Offsets in the list count from the end of the list's own member."""
        index = "".join(json.dumps(r) + "\n" for r in self.rows).encode()
        return _member(INDEX, index) + self.body.getvalue() + bytes(1024)


def write_shards(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Write the texts of ``docs`` as tar shards under ``path``; one pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = ShardWriter()
        for b in batches:
            for k, t in zip(b["k"], b["t"]):
                if shard.rows and shard.size + len(t) // 2 > shard_bytes:
                    yield pd.DataFrame({"tar": [shard.tar()[:-1]]})
                    shard = ShardWriter()
                shard.add(None if k is None else str(k), bytes(t))
        if shard.rows:
            yield pd.DataFrame({"tar": [shard.tar()[:-1]]})

    rows = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    tars = rows.mapInPandas(run, "tar binary").select(F.col("tar").cast("string").alias("value"))
    tars.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


#: Schemes whose files executors open by themselves; ``read_rows`` takes further ones that pyarrow has access to.
MOUNTED = ("", "file")


class Ranges:
    """Byte ranges of one shard: of a file by offset, or of the content that Spark has read."""

    def __init__(self, path: str, content: bytes | None):
        self.content, self.file = content, None
        if content is None and urlparse(path).scheme in MOUNTED:
            self.file = open(unquote(urlparse(path).path), "rb", buffering=0)
        elif content is None:
            from pyarrow import fs

            system, at = fs.FileSystem.from_uri(path)
            self.file = system.open_input_file(at)

    def read(self, offset: int, n: int) -> bytes:
        if self.file is None:
            return self.content[offset : offset + n]
        self.file.seek(offset)
        out = b""
        while len(out) < n and (more := self.file.read(n - len(out))):
            out += more
        return out

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def feature(payload: bytes) -> str:
    """Moments and entropy of the samples and the share of blank ones."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / counts.sum()
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(p @ (np.arange(256) - mean) ** 2))
    used = p[p > 0]
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={float(-(used * np.log2(used)).sum()):.4f};blank={float(p[32] + p[0]):.4f};levels={len(used)}"


ROWS = "key string, shard string, digest string, offset long, length long, n_bytes long, width int, height int, bits int"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def read_rows(spark: SparkSession, path: str, *, payload: bool = False, ranged: tuple[str, ...] = MOUNTED) -> DataFrame:
    """One row per stored row: where its image lies and, from the image's header range alone, width, height and bits. With
    ``payload``, the stored bytes are read back too: lengths, digests and features of payload and image.

    Ranges are read under the schemes ``ranged``: mounted folders, and stores that pyarrow on the executors has access to
    ("s3", "gs", "hdfs"), if the caller says so. Shards under any other scheme come whole through Spark's reader."""
    mounted = urlparse(path).scheme in ranged
    columns = ["path"] if mounted else ["path", "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(len(b)):
                shard = Ranges(b["path"].iloc[i], None if mounted else bytes(b["content"].iloc[i]))
                head = tarfile.TarInfo.frombuf(shard.read(0, 512), "utf-8", "strict")
                listed = shard.read(512, head.size)
                base = 512 + head.size + -head.size % 512
                done: dict[int, tuple] = {}
                out = []
                for key, offset, length, digest, n_bytes in map(json.loads, listed.splitlines()):
                    at = base + offset
                    if at not in done:
                        found = png_header(shard.read(at, HEADER))
                        if payload:
                            image = shard.read(at, length)
                            data = from_png(image)
                            found += (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), hashlib.sha256(image).hexdigest(), feature(data))
                        done[at] = found
                    out.append((key, b["path"].iloc[i], digest, at, length, n_bytes, *done[at]))
                shard.close()
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    schema = f"{ROWS}, {FEATURES}" if payload else ROWS
    shards = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(*columns)
    return shards.mapInPandas(run, schema)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "shards")
    write_shards(shared.table(spark, sf_dir, "documents"), path)
    return read_rows(spark, path, payload=True).select(
        F.col("key").cast("long").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height",
    )


QUERIES = {"op3_media_columns": op3_media_columns}
SQL: dict[str, str] = {}
