import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orofold.operators import raster
from orofold.sources import geotiff, png, svg, text
from orofold.streaming import ingest


def test_geotiff_cells_catalog_and_zip(spark, tmp_path):
    z = np.zeros((6, 8), np.float32)
    z[2:4, 3] = 5
    z[5, 7] = np.nan
    (tmp_path / "in" / "my_metadata").mkdir(parents=True)
    raw = geotiff.dump(geotiff.Raster(z, 44000, 6909600, 1))
    (tmp_path / "in" / "a.tif").write_bytes(raw)
    (tmp_path / "in" / "my_metadata" / "b.tif").write_bytes(raw)
    found = geotiff.files(spark, str(tmp_path / "in"))
    assert found.count() == 1
    cells = geotiff.cells(found)
    assert cells.count() == 48 and cells.where("z is null").count() == 1
    assert cells.where("z = 5").agg(F.min("e"), F.max("n")).first()[:] == (44003.0, 6909598.0)
    cat = geotiff.catalog(found)
    row = cat.first()
    assert (row.min_x, row.min_y, row.max_x, row.max_y) == (44003, 6909596, 44004, 6909598)
    assert geotiff.refreshed(cat, found).count() == 1
    sheet = raster.consolidate(geotiff.onto_grid(cells, (44000, 6909594), (6, 8), 1), (6, 8))
    assert sheet.agg(F.sum("z")).first()[0] == 10 and sheet.where("z = 5 and i in (3, 4) and j = 4").count() == 2
    with pytest.raises(ValueError):
        raster.require_data(sheet.withColumn("z", F.lit(0)))
    other = geotiff.dump(geotiff.Raster(z + 1, 44000, 6909600, 1))
    for name, members in (("1.zip", {"x/a.tif": raw, "n.txt": b"-"}), ("2.zip", {"a.tif": other, "c.tif": raw}), ("3.zip", {"a.tif": raw})):
        with zipfile.ZipFile(tmp_path / name, "w") as f:
            for k, v in members.items():
                f.writestr(k, v)
    got = geotiff.unzipped(spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))).collect()
    assert sorted(r.name for r in got) == ["a (1).tif", "a.tif", "c.tif"]


def packed_like(raw, compression, predictor, data, bits=32, form=3):
    """A file written by dump with its strip, and the tags that tell of it, replaced."""
    import struct

    n = struct.unpack_from("<H", raw, 8)[0]
    head, strip = bytearray(raw), None
    for k in range(n):
        tag, _, _ = struct.unpack_from("<HHI", raw, 10 + 12 * k)
        new = {geotiff.COMPRESSION: compression, geotiff.COUNTS: len(data), geotiff.BITS: bits, geotiff.FORMAT: form}.get(tag)
        if tag == geotiff.STRIPS:
            strip = struct.unpack_from("<I", raw, 10 + 12 * k + 8)[0]
        if tag == geotiff.SAMPLES:  # of one band anyway: the entry says the predictor instead
            struct.pack_into("<HHII", head, 10 + 12 * k, geotiff.PREDICTOR, 3, 1, predictor)
        elif new is not None:
            struct.pack_into("<I", head, 10 + 12 * k + 8, new)
    return bytes(head[:strip]) + data


def literal_codes(data):
    """data in LZW codes of 9 bits, the table cleared before it grows."""
    bits = ""
    for k, byte in enumerate(data):
        bits += (f"{256:09b}" if k % 200 == 0 else "") + f"{byte:09b}"
    bits += f"{257:09b}"
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_geotiff_compressions_and_predictors():
    rng = np.random.default_rng(3)
    z = rng.integers(0, 900, (7, 11)).astype(np.float32) + np.float32(0.25)
    raw = geotiff.dump(geotiff.Raster(z, 0, 7, 1))
    plain = z.tobytes()
    whole = z.astype("<i4")
    steps = np.diff(whole, axis=1, prepend=np.int32(0)).astype("<i4").tobytes()
    apart = np.ascontiguousarray(z.astype(">f4").view(np.uint8).reshape(7, 11, 4).transpose(0, 2, 1)).reshape(7, -1)
    floats = np.diff(apart, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    assert (geotiff.parse(packed_like(raw, 5, 1, literal_codes(plain))).data == z).all()
    assert (geotiff.parse(packed_like(raw, 8, 2, zlib.compress(steps), form=2)).data == whole).all()
    assert (geotiff.parse(packed_like(raw, 5, 3, literal_codes(floats))).data == z).all()
    # Codes of the format's own making: 1 2, then "1 2 1" by entries made on the way.
    codes = [256, 7, 8, 258, 260, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert geotiff.lzw(int(bits.ljust(56, "0"), 2).to_bytes(7, "big")) == bytes([7, 8, 7, 8, 7, 8, 7])
    with pytest.raises(ValueError):
        geotiff.parse(packed_like(raw, 7, 1, plain))


def test_png_round_trip(spark):
    pixels = np.random.default_rng(1).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    raw = png.encode(pixels)
    assert png.density(raw) == (11811, 11811, 1) and (png.decode(raw) == pixels).all()
    left = np.zeros((5, 1 + 28), np.uint8)
    left[:, 0], left[:, 1:] = 1, np.diff(pixels.astype(np.int64), axis=1, prepend=0).astype(np.uint8).reshape(5, 28)
    head, tail = raw.split(b"IDAT")[0][:-4], png._chunk(b"IEND", b"")
    assert (png.decode(head + png._chunk(b"IDAT", zlib.compress(left.tobytes())) + tail) == pixels).all()
    cells = spark.createDataFrame([(2, 1, 1, (9, 8, 7, 255))], "sheet int, i long, j long, rgba struct<r:int,g:int,b:int,a:int>")
    row = png.sheet_images(cells, (2, 3)).first()
    assert row.sheet == 2 and png.decode(bytes(row.png))[0, 0].tolist() == [9, 8, 7, 255]


def test_text_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "(3, -4)"), (None, "")], "a int, b string").coalesce(1)
    text.write(df, str(tmp_path / "t"))
    line = next((tmp_path / "t").glob("part-*")).read_text().split("\n")[1]
    assert line == "1".ljust(20) + "\t" + "(3, -4)".ljust(20)
    back = text.read(spark, str(tmp_path / "t"), ["a", "b"])
    assert back.where("a = '1'").select(text.pair(F.col("b")).alias("p")).select("p.*").first()[:] == (3, -4)
    with pytest.raises(ValueError):
        text.read(spark, str(tmp_path / "t"), ["a", "c"])


def test_svg():
    out = svg.mosaic([{"sheet": 1, "tile": 9, "x": 0, "y": 0}], 10, lambda k: (f"{k}.svg", f"{k}.png"))
    assert 'href="1.svg"' in out and svg.font_px(10, 11811) == 42


def test_stream_merges_sheets_that_come_in_parts(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    first = spark.createDataFrame([(1, 1, 0, 0, 5.0), (1, 1, 0, 0, 5.0), (1, 2, 3, 0, 6.0)], ingest.VERTICES)
    first.write.mode("append").parquet(src)
    ingest.start(spark, src, dst, str(tmp_path / "cp")).awaitTermination(120)
    assert ingest.vertices(spark, dst).count() == 2
    spark.createDataFrame([(1, 9, 0, 0, 9.0), (2, 7, 0, 0, 1.0)], ingest.VERTICES).write.mode("append").parquet(src)
    ingest.start(spark, src, dst, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.sheet, r.id) for r in ingest.vertices(spark, dst).collect()) == [(1, 1), (1, 2), (1, 9), (2, 7)]
    assert {r.sheet: r[1:] for r in ingest.boxes(spark, dst).collect()} == {1: (3, 0, 0, 3, 0), 2: (1, 0, 0, 0, 0)}
    assert ingest.merged_box(spark, dst).first()[:] == (0, 0, 3, 0)


def test_stream_splits_a_sheet_over_triggers(spark, tmp_path):
    """A file a trigger: five files of one sheet, rows repeated among them, and a batch that is delivered twice."""
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    for k in range(5):
        spark.createDataFrame([(1, i, 3 * i, i, 1.0 * i) for i in range(k * 3, k * 3 + 5)], ingest.VERTICES).coalesce(1).write.mode("append").parquet(f"{src}/v")
        spark.createDataFrame([(1, i, i + 1) for i in range(k * 3, k * 3 + 5)], ingest.EDGES).coalesce(1).write.mode("append").parquet(f"{src}/e")
    ingest.start(spark, f"{src}/v", dst, str(tmp_path / "cp-v"), files=1).awaitTermination(120)
    ingest.start(spark, f"{src}/e", dst, str(tmp_path / "cp-e"), "edges", files=1).awaitTermination(120)
    assert sorted(r.id for r in ingest.vertices(spark, dst).collect()) == list(range(17))
    assert sorted((r.a, r.b) for r in ingest.edges(spark, dst).collect()) == [(i, i + 1) for i in range(17)]
    last = spark.createDataFrame([(1, 16, 48, 16, 16.0), (1, 20, 60, 20, 20.0)], ingest.VERTICES)
    for _ in range(2):
        ingest.merge_batch(last, 9, dst)
    assert sorted(r.id for r in ingest.vertices(spark, dst).collect()) == [*range(17), 20]
    assert ingest.boxes(spark, dst).first()[:] == (1, 18, 0, 0, 60, 20)


def test_members_by_io():
    assert io.BytesIO(geotiff.dump(geotiff.Raster(np.ones((2, 2)), 0, 2, 1))).read(2) == b"II"
