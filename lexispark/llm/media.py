"""Media columns: texts as PNG images in a binary column, with a perceptual hash of what is read back.

A text's UTF-8 bytes, padded with spaces to whole rows of 192 bytes, are the samples of an RGB image 64 pixels wide.
The writer filters rows with Up and splits the zlib stream over IDAT chunks; the reader tests each chunk's checksum and
undoes any of the five PNG filters with numpy.

Null and empty texts give one row of spaces. Every row gives one row: repeated rows repeat, a null key stays null, an
empty table stays empty. Other columns of the input are left out. Nothing is shuffled and a task holds the images of a
slice of up to 512 texts and four million characters, or of one longer text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH, BPP = 64, 3
ROW = WIDTH * BPP
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 16
SIDE, LOW = 32, 8
_COS = np.cos(np.pi / SIDE * (np.arange(SIDE) + 0.5) * np.arange(LOW)[:, None])


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 1) -> bytes:
    """A PNG of whole rows, each filtered with Up."""
    px = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.empty((len(px), ROW + 1), np.uint8)
    lines[:, 0] = 2
    lines[0, 1:] = px[0]
    np.subtract(px[1:], px[:-1], out=lines[1:, 1:])
    body = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(px), 8, 2, 0, 0, 0)
    parts = [_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Samples of filtered scan lines (one filter byte, then the row); runs of one filter are undone together."""
    kinds, rows = lines[:, 0], lines[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1), len(kinds)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        kind, run = kinds[a], rows[a:b]
        if kind == 0:
            out[a:b] = run
        elif kind == 1:
            out[a:b] = run.reshape(b - a, -1, bpp).cumsum(axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            out[a:b] = run.cumsum(axis=0, dtype=np.uint8) + above
        else:
            for y in range(a, b):
                up = (out[y - 1] if y else above).astype(int).reshape(-1, bpp)
                left, corner = np.zeros(bpp, int), np.zeros(bpp, int)
                for x, step in enumerate(rows[y].astype(int).reshape(-1, bpp)):
                    if kind == 3:
                        guess = (left + up[x]) // 2
                    else:
                        p = left + up[x] - corner
                        da, db, dc = abs(p - left), abs(p - up[x]), abs(p - corner)
                        guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up[x], corner))
                    left, corner = (step + guess) & 255, up[x]
                    out[y, x * bpp : (x + 1) * bpp] = left
        above = out[b - 1]
    return out


def decode(media: bytes) -> np.ndarray:
    """Samples by row; ValueError where a checksum, the header or the length is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, head = 8, [], None
    while True:
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            break
    if head is None or head[2:] not in ((8, 2, 0, 0, 0), (8, 0, 0, 0, 0)):
        raise ValueError("only 8-bit grey or RGB without interlacing")
    bpp = 3 if head[3] == 2 else 1
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    return unfilter(raw.reshape(head[1], head[0] * bpp + 1), bpp)


def dct_hash(samples: np.ndarray, bpp: int = BPP) -> str:
    """64 bits: which low frequencies of the 32 x 32 grey image exceed their median, as 16 hex digits."""
    grey = samples.reshape(len(samples), -1, bpp).mean(axis=2)
    for axis in (0, 1):
        n = grey.shape[axis]
        at = np.arange(SIDE) * n // SIDE
        if n >= SIDE:
            grey = np.add.reduceat(grey, at, axis=axis) / np.diff([*at, n]).reshape((-1, 1) if axis == 0 else (1, -1))
        else:
            grey = grey.take(at, axis=axis)
    low = (_COS @ grey @ _COS.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


SCHEMA = "key {0}, media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def media(docs: DataFrame, key: str = "doc_id", text: str = "text", level: int = 1) -> DataFrame:
    """The image of each text and what it gives when read back: one row for each row of ``docs``."""
    schema = SCHEMA.format(docs.schema[key].dataType.simpleString())

    def run(batches):
        for keys, texts in common.rows(batches, 512, 4_000_000):
            out = []
            for k, t in zip(keys, texts, strict=True):
                data = t.encode()
                stored = encode(pad(data), level)
                back = decode(stored)
                raw = back.tobytes()
                out.append((k, stored, len(data), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), dct_hash(back)))
            cols = list(zip(*out, strict=True))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, kind) for i, c in enumerate(cols)], names=names)

    kind = common.arrow_type(docs, key)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns of ``media`` over all of documents."""
    return media(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
