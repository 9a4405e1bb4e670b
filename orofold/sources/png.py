"""PNG images with a physical density, from cell tables to one file a sheet."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray, per_metre: int = 11811) -> bytes:
    """An image of uint8 pixels: (rows, columns) grey, or with 2 (grey, alpha), 3 (rgb) or 4 (rgba) parts."""
    data = pixels[:, :, None] if pixels.ndim == 2 else pixels
    h, w, n = data.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    lines = np.zeros((h, 1 + w * n), np.uint8)
    lines[:, 1:] = data.reshape(h, w * n)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + _chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)) + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def chunks(raw: bytes):
    if raw[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(raw):
        n = struct.unpack_from(">I", raw, at)[0]
        yield raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        at += 12 + n


def density(raw: bytes) -> tuple[int, int, int] | None:
    """Pixels a unit along x and y, and the unit (1: metre); None where the image has no such chunk."""
    return next((struct.unpack(">IIB", body) for kind, body in chunks(raw) if kind == b"pHYs"), None)


def decode(raw: bytes) -> np.ndarray:
    """Pixels of an 8-bit image without interlace."""
    parts = list(chunks(raw))
    w, h, bits, kind, _, _, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if bits != 8 or interlace or kind == 3:
        raise ValueError("8 bits a part, no palette and no interlace are expected")
    n = {0: 1, 4: 2, 2: 3, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT")), np.uint8).reshape(h, 1 + w * n)
    out, above = np.zeros((h, w * n), np.int64), np.zeros(w * n, np.int64)
    for y, line in enumerate(lines):
        row, mode = line[1:].astype(np.int64), line[0]
        if mode == 1:
            row = np.cumsum(row.reshape(w, n), 0).ravel() & 255
        elif mode == 2:
            row = row + above & 255
        elif mode:
            for x in range(w * n):
                left, up, corner = (row[x - n] if x >= n else 0), above[x], (above[x - n] if x >= n else 0)
                if mode == 3:
                    add = (left + up) // 2
                else:
                    guess = left + up - corner
                    add = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
                row[x] = row[x] + add & 255
        out[y] = above = row
    return out.reshape(h, w, n).astype(np.uint8)


def sheet_images(cells: DataFrame, shape: tuple[int, int], per_metre: int = 11811) -> DataFrame:
    """sheet, png of cells (sheet, i, j, rgba): a task a sheet, as a sheet is of bounded size; absent cells are transparent."""

    def run(key, rows):
        pixels = np.zeros((*shape, 4), np.uint8)
        i, j = rows.column("i").to_numpy() - 1, rows.column("j").to_numpy() - 1
        for k, name in enumerate("rgba"):
            pixels[i, j, k] = rows.column(name).to_numpy()
        return pa.table({"sheet": pa.array([key[0].as_py()], pa.int32()), "png": pa.array([encode(pixels, per_metre)], pa.binary())})

    flat = cells.select("sheet", "i", "j", *[F.col(f"rgba.{k}").alias(k) for k in "rgba"])
    return flat.groupBy("sheet").applyInArrow(run, "sheet int, png binary")


def pixels(images: DataFrame) -> DataFrame:
    """sheet, i, j, rgba, density (pixels a metre; null where an image doesn't say) of images (sheet, png) with red, green, blue and opacity."""

    def run(batches):
        for batch in batches:
            for sheet, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, told = decode(raw), density(raw)
                i, j = np.indices(data.shape[:2])
                rgba = pa.StructArray.from_arrays([pa.array(data[:, :, k].ravel().astype(np.int32)) for k in range(4)], list("rgba"))
                n = i.size
                yield pa.record_batch([pa.array(np.full(n, sheet), pa.int32()), pa.array(i.ravel() + 1), pa.array(j.ravel() + 1), rgba, pa.array([told[0] if told and told[2] == 1 else None] * n, pa.int32())], names=["sheet", "i", "j", "rgba", "density"])

    return images.select("sheet", "png").mapInArrow(run, "sheet int, i long, j long, rgba struct<r:int,g:int,b:int,a:int>, density int")
