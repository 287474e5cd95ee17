"""Media columns: Netpbm and BMP images decoded to arrays, area-resized by integral images, kept as NPY tiles with difference hashes.

``decode`` reads P1 to P6 Netpbm and uncompressed 1, 4, 8, 24 and 32-bit BMP into arrays (height, width, channels) of unsigned
8 or 16-bit samples. ``area_resize`` takes exact area means: the integral image is read at fractional corners. ``describe``
adds to a binary column of images their size, a tile (NPY bytes of the resized grey image) and a 64-bit difference hash;
bytes that are no such image, and nulls, give nulls there.

Documents as media: a text's UTF-8 bytes, padded with 255 to a positive multiple of 576 (24 x 24), are the samples of a
binary greymap 24 wide. The stored greymap is decoded again, and everything that is reported comes from the decoded array.

Work is row by row within a task: no shuffle, memory bounded by one Arrow batch. Null texts count as empty. Repeated rows
each get their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE = 24
UNIT = SIDE * SIDE
HASH = 8
TILE = 32
#: Rows of one Arrow batch that are turned into Python objects at a time.
ROWS = 256


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    numbers, at = [], 2
    for _ in range(2 if kind in (1, 4) else 3):
        found = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([0-9]+)").match(data, at)
        if not found:
            raise ValueError("header")
        numbers.append(int(found[1]))
        at = found.end()
    (width, height), most = numbers[:2], (numbers[2] if len(numbers) > 2 else 1)
    channels = 3 if kind in (3, 6) else 1
    if width < 1 or height < 1 or not 1 <= most <= 65535:
        raise ValueError("size")
    n, kept = width * height * channels, np.uint8 if most < 256 else np.uint16
    if kind <= 3:
        body = re.sub(rb"#[^\r\n]*", b" ", data[at:])
        words = list(body.translate(None, b" \t\r\n\v\f")[:n]) if kind == 1 else body.split()[:n]
        flat = np.array([w - 48 for w in words] if kind == 1 else [int(w) for w in words], np.int64)
    elif kind == 4:
        row = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)
        flat = bits[:, :width].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(flat) != n or (n and int(flat.max()) > most):
        raise ValueError("samples")
    if kind in (1, 4):
        flat = 255 * (1 - flat.astype(np.int64))
    return flat.astype(kept).reshape(height, width, channels)


def _bmp(data: bytes) -> np.ndarray:
    u32 = lambda at: int.from_bytes(data[at : at + 4], "little")
    i32 = lambda at: int.from_bytes(data[at : at + 4], "little", signed=True)
    start, head, width, height, bits, packing = u32(10), u32(14), i32(18), i32(22), u32(28) & 0xFFFF, u32(30)
    if head < 40 or width < 1 or height == 0 or packing != 0 or bits not in (1, 4, 8, 24, 32):
        raise ValueError("header")
    row = (width * bits + 31) // 32 * 4
    lines = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    if bits >= 24:
        out = lines[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    else:
        index = np.unpackbits(lines, axis=1).reshape(abs(height), -1, bits) @ (1 << np.arange(bits)[::-1])
        colours = u32(46) or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
        index = index[:, :width]
        if index.max() >= colours:
            raise ValueError("palette")
        out = palette[index]
        if (palette == palette[:, :1]).all():
            out = out[:, :, :1]
    return np.ascontiguousarray(out[::-1] if height > 0 else out)


def decode(data: bytes) -> np.ndarray:
    """Samples (height, width, channels) of a Netpbm or BMP image; ValueError for anything else."""
    try:
        if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (IndexError, OverflowError, MemoryError) as e:
        raise ValueError(str(e)) from e
    raise ValueError("neither Netpbm nor BMP")


def encode_greymap(samples: np.ndarray) -> bytes:
    """A binary greymap (P5) of 8-bit samples (height, width)."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of colour images (0.299, 0.587, 0.114), the samples themselves of others."""
    if image.shape[2] < 3:
        return image[:, :, 0].astype(np.float64)
    return image[:, :, :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of a (h, w) array on a height x width grid; cells may be fractions of samples."""
    table = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    table[1:, 1:] = image.cumsum(0).cumsum(1)
    rows, cols = np.linspace(0, image.shape[0], height + 1), np.linspace(0, image.shape[1], width + 1)
    at = np.minimum(rows.astype(int), image.shape[0] - 1)
    part = (rows - at)[:, None]
    table = table[at] * (1 - part) + table[at + 1] * part
    at = np.minimum(cols.astype(int), image.shape[1] - 1)
    part = cols - at
    table = table[:, at] * (1 - part) + table[:, at + 1] * part
    return np.diff(np.diff(table, axis=0), axis=1) / (np.diff(rows)[:, None] * np.diff(cols))


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 area means is above its right neighbour (by more than rounding)."""
    small = area_resize(image, HASH, HASH + 1)
    return int.from_bytes(np.packbits(small[:, :-1] > small[:, 1:] + 1e-9).tobytes(), "big")


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """NPY bytes of the grey image's area means, rounded to unsigned 8-bit."""
    tile = np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8)
    np.save(out := io.BytesIO(), tile, allow_pickle=False)
    return out.getvalue()


def features(data: bytes, side: int = TILE) -> tuple:
    """(height, width, channels, NPY tile, hash as 16 hex digits) of an image's bytes."""
    image = decode(data)
    light = grey(image) / (257 if image.dtype == np.uint16 else 1)
    return (*image.shape, npy_tile(light, side), f"{difference_hash(light):016x}")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def describe(media: DataFrame, id_col: str, data_col: str, side: int = TILE) -> DataFrame:
    """id, height, width, channels, tile (binary NPY), hash of every row's image; nulls where it can't be decoded."""

    def run(batches):
        for batch in _slices(batches):
            found = []
            for data in batch.column(1).to_pylist():
                try:
                    found.append(features(data or b"", side))
                except ValueError:
                    found.append((None,) * 5)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True))], ["id", "height", "width", "channels", "tile", "hash"])

    slim = media.select(id_col, data_col)
    return slim.mapInArrow(run, f"id {slim.schema[0].dataType.simpleString()}, height int, width int, channels int, tile binary, hash string").withColumnRenamed("id", id_col)


def store_text(text: str | None) -> bytes:
    """The greymap that holds a text."""
    data = (text or "").encode()
    data += b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))
    return encode_greymap(np.frombuffer(data, np.uint8).reshape(-1, SIDE))


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (binary): every text as a greymap."""

    def run(batches):
        for batch in _slices(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([store_text(t) for t in texts], pa.binary())], ["id", "n_bytes", "media"])

    slim = docs.select(id_col, text_col)
    return slim.mapInArrow(run, f"id {slim.schema[0].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def digest_media(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, sizes and digests of stored documents, all from the media column as decoded; feature: hash and the NPY tile's crc32."""

    def row(data: bytes) -> tuple:
        image = decode(data)
        payload = image.tobytes()
        _, _, _, tile, code = features(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{code}-{zlib.crc32(tile):08x}"

    def run(batches):
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in _slices(batches):
            found = zip(*map(row, batch.column(2).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], ["id", "n_bytes", *names])

    slim = stored.select(id_col, "n_bytes", "media")
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
