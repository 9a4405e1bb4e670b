"""Elevation rasters in GeoTIFF files: a small reader for single-band strips or tiles (plain, deflated or LZW, with either predictor), and a writer."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, COUNTS, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, FORMAT, SCALE, TIEPOINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
_KIND = {1: "B", 2: "s", 3: "H", 4: "I", 5: "2I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


class Raster:
    """A matrix (rows southwards) with the easting and northing of its north-west corner and its cell size."""

    def __init__(self, data: np.ndarray, west: float, north: float, cell: float, nodata: float | None = None):
        self.data, self.west, self.north, self.cell, self.nodata = data, west, north, cell, nodata

    @property
    def missing(self) -> np.ndarray:
        gone = np.isnan(self.data)
        return gone if self.nodata is None else gone | (self.data == self.nodata)


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack_from(order + "I", raw, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0]):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", raw, entry)
        if kind not in _KIND:
            continue
        form = f"{order}{count}{_KIND[kind]}" if kind != 5 else f"{order}{2 * count}I"
        size = struct.calcsize(form)
        place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", raw, entry + 8)[0]
        tags[tag] = struct.unpack_from(form, raw, place)
    return order, tags


def lzw(data: bytes) -> bytes:
    """What a strip of variable-width codes stands for: 9 to 12 bits, high ones first, a bit more one code early; 256 clears, 257 ends."""
    out, table, width, last = bytearray(), [], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("a code before its entry")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def unpredicted(data: bytes, kind: np.dtype, shape: tuple[int, int], predictor: int) -> np.ndarray:
    """Samples of rows of differences: 1 none, 2 of whole samples, 3 of the bytes of floats, highest first and apart."""
    h, w = shape
    if predictor == 3:
        rows = np.cumsum(np.frombuffer(data, np.uint8, h * w * kind.itemsize).reshape(h, -1), 1, dtype=np.uint8)
        return np.ascontiguousarray(rows.reshape(h, kind.itemsize, w).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(h, w)
    rows = np.frombuffer(data, kind, h * w).reshape(h, w)
    return rows if predictor == 1 else np.cumsum(rows, 1, dtype=kind.newbyteorder("="))


def parse(raw: bytes) -> Raster:
    order, t = _tags(raw)
    w, h = t[WIDTH][0], t[HEIGHT][0]
    packed, predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
    if t.get(SAMPLES, (1,))[0] != 1 or packed not in (1, 5, 8, 32946) or predictor not in (1, 2, 3):
        raise ValueError("a single band is expected, plain, deflated or in LZW")
    kind = np.dtype({1: "u", 2: "i", 3: "f"}[t.get(FORMAT, (1,))[0]] + str(t[BITS][0] // 8)).newbyteorder(order)
    unpack = {1: bytes, 5: lzw}.get(packed, zlib.decompress)
    out = np.zeros((h, w), np.float32)
    if TILES in t:
        tw, th = t[TILE_WIDTH][0], t[TILE_HEIGHT][0]
        across = -(-w // tw)
        blocks = [(k // across * th, k % across * tw, th, tw, o, c) for k, (o, c) in enumerate(zip(t[TILES], t[TILE_COUNTS], strict=True))]
    else:
        rows = t.get(ROWS, (h,))[0]
        blocks = [(k * rows, 0, min(rows, h - k * rows), w, o, c) for k, (o, c) in enumerate(zip(t[STRIPS], t[COUNTS], strict=True))]
    for i, j, bh, bw, offset, count in blocks:
        part = unpredicted(unpack(raw[offset : offset + count]), kind, (bh, bw), predictor)
        out[i : i + bh, j : j + bw] = part[: h - i, : w - j]
    tie, cell = t.get(TIEPOINT, (0, 0, 0, 0, 0, 0)), t.get(SCALE, (1, 1, 0))[0]
    nodata = t.get(NODATA)
    return Raster(out, tie[3] - tie[0] * cell, tie[4] + tie[1] * cell, cell, float(nodata[0].strip(b"\0 ")) if nodata else None)


def dump(r: Raster) -> bytes:
    """One deflated strip of 32-bit floats."""
    data = zlib.compress(r.data.astype("<f4").tobytes())
    h, w = r.data.shape
    entries = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (32,)), (COMPRESSION, 3, (8,)), (262, 3, (1,)), (STRIPS, 4, (0,)), (SAMPLES, 3, (1,)), (ROWS, 4, (h,)), (COUNTS, 4, (len(data),)), (FORMAT, 3, (3,)), (SCALE, 12, (r.cell, r.cell, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, r.west, r.north, 0.0))]
    extra_at = 8 + 2 + 12 * len(entries) + 4
    extra, rows = b"", []
    for tag, kind, values in entries:
        body = struct.pack(f"<{len(values)}{_KIND[kind]}", *values)
        if len(body) > 4:
            rows.append((tag, kind, len(values), struct.pack("<I", extra_at + len(extra))))
            extra += body
        else:
            rows.append((tag, kind, len(values), body.ljust(4, b"\0")))
    strip = extra_at + len(extra)
    rows = [(t, k, n, struct.pack("<I", strip) if t == STRIPS else v) for t, k, n, v in rows]
    head = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(rows))
    return head + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in rows) + b"\0\0\0\0" + extra + data


def encoded(cells: DataFrame, west: Column, north: Column, cell: float = 1.0) -> DataFrame:
    """path, content: a file a sheet ("3.tif") of cells (sheet, i, j, z), a task a sheet, as a sheet is of bounded size; west and north are the
    corner of each cell's sheet. Absent cells are missing values."""

    def run(key, rows):
        i, j = rows.column("i").to_numpy() - 1, rows.column("j").to_numpy() - 1
        data = np.full((i.max() + 1, j.max() + 1), np.nan, np.float32)
        data[i, j] = rows.column("z").to_numpy()
        raster = Raster(data, rows.column("west")[0].as_py(), rows.column("north")[0].as_py(), cell)
        return pa.table({"path": [f"{key[0].as_py()}.tif"], "content": pa.array([dump(raster)], pa.binary())})

    at = cells.select("sheet", "i", "j", F.col("z").cast("double").alias("z"), west.cast("double").alias("west"), north.cast("double").alias("north"))
    return at.groupBy("sheet").applyInArrow(run, "path string, content binary")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of all .tif and .tiff files below a folder, but for those in folders named *metadata."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(F.lower("path").rlike(r"\.tiff?$") & ~F.col("path").rlike(r"metadata/[^/]*$"))


CELLS = "path string, i long, j long, e double, n double, z float"


def cells(found: DataFrame) -> DataFrame:
    """path, i, j, e, n, z of each cell of files (path, content); missing values are null."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                r = parse(content.as_py())
                h, w = r.data.shape
                for lo in range(0, h, max(1, 500_000 // max(w, 1))):
                    part = r.data[lo : lo + max(1, 500_000 // max(w, 1))]
                    i, j = np.indices(part.shape)
                    i = i.ravel() + lo
                    yield pa.record_batch(
                        [pa.array([path] * part.size), pa.array(i + 1), pa.array(j.ravel() + 1), pa.array(r.west + j.ravel() * r.cell), pa.array(r.north - i * r.cell), pa.array(part.ravel(), pa.float32(), mask=r.missing[lo : lo + len(part)].ravel())],
                        names=["path", "i", "j", "e", "n", "z"],
                    )

    return found.select("path", "content").mapInArrow(run, CELLS)


def catalog(found: DataFrame) -> DataFrame:
    """path, modificationTime, external boxes: of the file, and of its cells that are neither zero nor missing (zeros if none)."""

    def run(batches):
        for batch in batches:
            rows = []
            for content in batch.column(2):
                r = parse(content.as_py())
                h, w = r.data.shape
                box = (r.west, r.north - h * r.cell, r.west + w * r.cell, r.north)
                i, j = np.nonzero(~r.missing & (r.data != 0))
                inner = (r.west + j.min() * r.cell, r.north - (i.max() + 1) * r.cell, r.west + (j.max() + 1) * r.cell, r.north - i.min() * r.cell) if len(i) else (0, 0, 0, 0)
                rows.append([int(v) for v in (*box, *inner)])
            names = ["full_min_x", "full_min_y", "full_max_x", "full_max_y", "min_x", "min_y", "max_x", "max_y"]
            yield pa.record_batch([batch.column(0), batch.column(1)] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(8)], names=["path", "modificationTime", *names])

    schema = "path string, modificationTime timestamp, full_min_x long, full_min_y long, full_max_x long, full_max_y long, min_x long, min_y long, max_x long, max_y long"
    return found.select("path", "modificationTime", "content").mapInArrow(run, schema)


def refreshed(known: DataFrame, found: DataFrame) -> DataFrame:
    """The catalog with rows of new and changed files read anew, and those of files that are gone dropped."""
    now = found.select("path", "modificationTime")
    same = known.join(now, ["path", "modificationTime"], "left_semi")
    return same.unionByName(catalog(found.join(same.select("path"), "path", "left_anti")))


def unzipped(archives: DataFrame) -> DataFrame:
    """name, sha, content of the rasters within zip files (path, content): equal files once; of one name with different contents the later
    ones are called "name (n)"."""
    import io
    import zipfile

    def run(batches):
        for batch in batches:
            for content in batch.column(1):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for info in z.infolist():
                        if info.filename.lower().endswith((".tif", ".tiff")):
                            yield pa.record_batch([pa.array([info.filename.rsplit("/", 1)[-1]]), pa.array([z.read(info)])], names=["name", "content"])

    from pyspark.sql import Window

    members = archives.select("path", "content").mapInArrow(run, "name string, content binary").withColumn("sha", F.sha2("content", 256)).dropDuplicates(["name", "sha"])
    k = F.row_number().over(Window.partitionBy("name").orderBy("sha"))
    stem, end = F.regexp_extract("name", r"^(.*)(\.[^.]*)$", 1), F.regexp_extract("name", r"^(.*)(\.[^.]*)$", 2)
    return members.withColumn("k", k).select(F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), (F.col("k") - 1).cast("string"), F.lit(")"), end)).alias("name"), "sha", "content")


def zipped(members: DataFrame) -> DataFrame:
    """path, content: a zip file for each path of members (path, name, content); an archive is as bounded as its sheet."""
    import io
    import zipfile

    def run(key, rows):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(rows.column("name").to_pylist(), rows.column("content").to_pylist(), strict=True)):
                z.writestr(name, content)
        return pa.table({"path": [key[0].as_py()], "content": pa.array([out.getvalue()], pa.binary())})

    return members.select("path", "name", "content").groupBy("path").applyInArrow(run, "path string, content binary")


#: The name that a sheet's own raster has.
RESERVED = "Consolidated.tif"


def candidates(found: DataFrame, there: DataFrame) -> DataFrame:
    """path, name of files (path) whose name the destination (name) lacks and that aren't a sheet's own raster."""
    named = found.select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("name")).where(F.col("name") != RESERVED)
    return named.join(there.select("name"), "name", "left_anti").select("path", "name")


def onto_grid(sources: DataFrame, sw: tuple[int, int], shape: tuple[int, int], cell: int) -> DataFrame:
    """i, j, z, file_order for operators.raster.consolidate: source cells (path, e, n, z) on the nearest cell of a sheet's grid."""
    i, j = F.rint((F.lit(sw[1] + shape[0] * cell) - F.col("n")) / cell) + 1, F.rint((F.col("e") - sw[0]) / cell) + 1
    return sources.select(i.cast("long").alias("i"), j.cast("long").alias("j"), "z", F.struct("path").alias("file_order"))
