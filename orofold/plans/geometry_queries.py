"""Queries of sheets, coordinates, files and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import raster
from ..sources import rasters
from ..spec import MapSpec
from . import sql
from .registry import query

SMALL = MapSpec(44000, 6909047, 2, 3, 2, 3, 4, 1000, "maps")
#: Sheets of 30 rows by 25 columns over 120 by 125 cells of ten metres.
LARGE = MapSpec(44000, 6909047, 4, 5, 10, 25, 30, 1000, "maps")
SH, SHL = sql.sheets(SMALL), sql.sheets(LARGE)


def points(spark, sf_dir):
    k = F.col("c_custkey")
    return rasters.table(spark, sf_dir, "customer").select(k.alias("id"), (F.lit(43940) + (k * 37) % 1400).alias("e"), (F.lit(6908987) + (k * 91) % 1400).alias("n"))


@query("sheet_enumeration", f"WITH {SHL} SELECT sheet, row, col, opx, opy, min_x, min_y, max_x, max_y FROM sh")
def sheet_enumeration(spark, sf_dir):
    return LARGE.sheets(spark).drop("folder")


@query("cell_to_utm", f"WITH {sql.ORD} SELECT i, j, {LARGE.sw_e} + (j - 1) * 10 AS e, {LARGE.sw_n} + (120 - i + 1) * 10 AS n FROM ord")
def cell_to_utm(spark, sf_dir):
    e, n = g.cell_utm(F.col("i"), F.col("j"), F.lit(LARGE.sw_e), F.lit(LARGE.sw_n), 120, 10)
    return rasters.orders_raster(spark, sf_dir).select("i", "j", e.alias("e"), n.alias("n"))


_ROW, _COL = f"ceil((n - {LARGE.sw_n}) / {LARGE.sheet_height})", f"floor((e - {LARGE.sw_e}) / {LARGE.sheet_width}) + 1"


@query(
    "utm_to_sheet",
    f"WITH {sql.POINTS}, x AS (SELECT id, CAST({_ROW} AS BIGINT) AS r, CAST({_COL} AS BIGINT) AS c FROM points) "
    f"SELECT id, CASE WHEN r BETWEEN 1 AND 4 AND c BETWEEN 1 AND 5 THEN r END AS row, CASE WHEN r BETWEEN 1 AND 4 AND c BETWEEN 1 AND 5 THEN c END AS col FROM x",
)
def utm_to_sheet(spark, sf_dir):
    row, col = g.sheet_index(F.col("e"), F.col("n"), LARGE)
    return points(spark, sf_dir).select("id", row.alias("row"), col.alias("col"))


@query(
    "utm_to_cell",
    f"WITH {sql.POINTS}, x AS (SELECT id, {LARGE.bbox[3]} - n AS d, e - {LARGE.sw_e} AS r FROM points) "
    f"SELECT id, CAST(((d % 300) + 300) % 300 // 10 + 1 AS BIGINT) AS i, CAST(((r % 250) + 250) % 250 // 10 + 1 AS BIGINT) AS j FROM x",
)
def utm_to_cell(spark, sf_dir):
    i, j = g.cell_index(F.col("e"), F.col("n"), LARGE)
    return points(spark, sf_dir).select("id", i.alias("i"), j.alias("j"))


@query(
    "sheet_corners",
    f"WITH {SH} SELECT sheet, min_x AS sw_e, min_y AS sw_n, max_x AS ne_e, max_y AS ne_n, min_x AS nw_e, max_y AS nw_n, max_x AS se_e, min_y AS se_n, "
    "min_y + 2 AS sw_internal_n, max_x - 2 AS ne_internal_e, max_x - 2 AS se_internal_e, min_y + 2 AS se_internal_n FROM sh",
)
def sheet_corners(spark, sf_dir):
    c = g.corners(SMALL.cell2utm)
    one = [c[k][x].alias(f"{k}_{x}") for k in ("sw", "ne", "nw", "se") for x in ("e", "n")]
    inner = [c["sw_internal"]["n"].alias("sw_internal_n"), c["ne_internal"]["e"].alias("ne_internal_e"), c["se_internal"]["e"].alias("se_internal_e"), c["se_internal"]["n"].alias("se_internal_n")]
    return SMALL.sheets(spark).select("sheet", *one, *inner)


@query("sheet_bbox_union", f"WITH {SHL} SELECT col, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM sh GROUP BY col")
def sheet_bbox_union(spark, sf_dir):
    return LARGE.sheets(spark).groupBy("col").agg(*g.bbox_union())


@query("sheet_area", f"WITH {SHL} SELECT sheet, (max_x - min_x) * (max_y - min_y) AS area, (min_x + max_x) / 2 AS centre_x, (min_y + max_y) / 2 AS centre_y FROM sh")
def sheet_area(spark, sf_dir):
    c = g.centre(LARGE.cell2utm)
    return LARGE.sheets(spark).select("sheet", g.area().alias("area"), c["centre_x"].alias("centre_x"), c["centre_y"].alias("centre_y"))


@query(
    "sheet_wkt",
    f"WITH {SH}, w AS (SELECT sheet, '((' || min_x || ' ' || min_y || ', ' || max_x || ' ' || min_y || ', ' || max_x || ' ' || max_y || ', ' || min_x || ' ' || max_y || ', ' || min_x || ' ' || min_y || '))' AS ring, "
    "'(' || min_x || ' ' || (min_y + 2) || ')-(' || (max_x - 2) || ' ' || max_y || ')' AS box FROM sh) SELECT sheet, ring, box FROM w",
)
def sheet_wkt(spark, sf_dir):
    return SMALL.sheets(spark).select("sheet", g.box_wkt().alias("ring"), g.bbox_text(SMALL.cell2utm).alias("box"))


@query("sheet_multipolygon", f"WITH {SH}, w AS (SELECT sheet, '((' || min_x || ' ' || min_y || ', ' || max_x || ' ' || min_y || ', ' || max_x || ' ' || max_y || ', ' || min_x || ' ' || max_y || ', ' || min_x || ' ' || min_y || '))' AS ring FROM sh) SELECT 'MULTIPOLYGON (' || string_agg(ring, ',' || chr(10) ORDER BY sheet) || ')' AS wkt FROM w")
def sheet_multipolygon(spark, sf_dir):
    return SMALL.sheets(spark).agg(g.multipolygon("sheet").alias("wkt"))


def boxes(spark, sf_dir):
    """A source box a supplier: 20 to 119 metres wide, 30 to 129 high."""
    k = F.col("s_suppkey")
    x, y = F.lit(43900) + (k * 131) % 1450, F.lit(6909000) + (k * 197) % 1350
    return rasters.table(spark, sf_dir, "supplier").select(k.alias("source"), x.alias("min_x"), y.alias("min_y"), (x + 20 + k % 100).alias("max_x"), (y + 30 + (k * 7) % 100).alias("max_y"))


_BOXES = "boxes AS (SELECT s_suppkey AS source, 43900 + (s_suppkey * 131) % 1450 AS min_x, 6909000 + (s_suppkey * 197) % 1350 AS min_y, 43900 + (s_suppkey * 131) % 1450 + 20 + s_suppkey % 100 AS max_x, 6909000 + (s_suppkey * 197) % 1350 + 30 + (s_suppkey * 7) % 100 AS max_y FROM supplier)"


@query("bbox_overlap_join", f"WITH {SHL}, {_BOXES} SELECT sheet, source FROM sh JOIN boxes b ON b.min_x < sh.max_x AND b.max_x > sh.min_x AND b.min_y < sh.max_y AND b.max_y > sh.min_y")
def bbox_overlap_join(spark, sf_dir):
    return g.overlap_join(LARGE.sheets(spark).drop("folder"), boxes(spark, sf_dir), 250).select("a.sheet", "b.source")


@query("border_sides", f"WITH {SHL} SELECT sheet, concat_ws('', CASE WHEN col > 1 THEN 'w' END, CASE WHEN row < 4 THEN 'n' END, CASE WHEN row > 1 THEN 's' END, CASE WHEN col < 5 THEN 'e' END) AS sides FROM sh")
def border_sides(spark, sf_dir):
    return LARGE.sheets(spark).select("sheet", F.array_join(g.border_sides(F.col("row"), F.col("col"), LARGE), "").alias("sides"))


@query("neighbor_sheets", f"WITH {SHL}, st(side, dr, dc) AS (VALUES ('w', 0, -1), ('n', 1, 0), ('s', -1, 0), ('e', 0, 1)) SELECT a.sheet, side, b.sheet AS neighbour FROM sh a CROSS JOIN st JOIN sh b ON b.row = a.row + dr AND b.col = a.col + dc")
def neighbor_sheets(spark, sf_dir):
    return g.neighbours(LARGE.sheets(spark))


@query("folder_codec", f"WITH {SHL} SELECT sheet, 'maps/' || row || '-' || col || '__' || min_x || '-' || min_y || '__' || max_x || '-' || max_y AS folder, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, min_x, min_y, max_x, max_y FROM sh")
def folder_codec(spark, sf_dir):
    return LARGE.sheets(spark).select("sheet", "folder", g.folder_parts(F.col("folder")).alias("p")).select("sheet", "folder", "p.*")


@query("nonzero_bbox", f"WITH {sql.EMB}, k AS (SELECT i, j, CASE WHEN abs(z) < 250 THEN 0 ELSE z END AS z, i % 25 AS path FROM emb) SELECT path, CAST(coalesce(min(CASE WHEN z <> 0 THEN i END), 0) AS BIGINT) AS i0, CAST(coalesce(min(CASE WHEN z <> 0 THEN j END), 0) AS BIGINT) AS j0, CAST(coalesce(max(CASE WHEN z <> 0 THEN i END), 0) AS BIGINT) AS i1, CAST(coalesce(max(CASE WHEN z <> 0 THEN j END), 0) AS BIGINT) AS j1 FROM k GROUP BY path")
def nonzero_bbox(spark, sf_dir):
    cells = rasters.embedding_raster(spark, sf_dir).withColumn("z", F.when(F.abs("z") < 250, 0).otherwise(F.col("z"))).withColumn("path", F.col("i") % 25)
    return raster.nonzero_box(cells, ["path"])


@query(
    "consolidate_last_wins",
    """WITH s AS (SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, CAST(round_even(l_extendedprice * 100 / 50, 0) AS BIGINT) AS z, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_shipdate DESC, l_quantity DESC) AS r FROM lineitem),
    g AS (SELECT CAST(k // 100 + 1 AS BIGINT) AS i, CAST(k % 100 + 1 AS BIGINT) AS j FROM range(0, 200000) AS x(k))
    SELECT g.i, g.j, coalesce(z, 0) AS z FROM g LEFT JOIN (SELECT * FROM s WHERE r = 1) s ON g.i = s.i AND g.j = s.j""",
)
def consolidate_last_wins(spark, sf_dir):
    cells = rasters.sparse_cells(spark, sf_dir)
    return raster.consolidate(cells, raster.extent(cells, (2000, 100))).select("i", "j", "z")


@query("paper_and_scale", f"SELECT 'LARGE' AS spec, {LARGE.scale_denominator} AS scale, CAST({LARGE.area} AS BIGINT) AS area, {LARGE.paper_mm[0]} AS width_mm, {LARGE.paper_mm[1]} AS height_mm")
def paper_and_scale(spark, sf_dir):
    rows = LARGE.sheets(spark).agg(*g.bbox_union())
    return rows.select(F.lit("LARGE").alias("spec"), F.lit(LARGE.scale_denominator).alias("scale"), g.area().alias("area"), *[F.ceil((F.col(f"max_{k}") - F.col(f"min_{k}")) * 1000 / F.lit(LARGE.scale_denominator)).cast("int").alias(n) for k, n in (("x", "width_mm"), ("y", "height_mm"))])


@query("summit_text_rows", f"WITH {sql.ORD} SELECT rpad(CAST(z // 100 AS VARCHAR), 20, ' ') AS \"Elevation_m\", rpad('(' || i || ', ' || j || ')', 20, ' ') AS \"Cell_index\" FROM ord WHERE z > 180000")
def summit_text_rows(spark, sf_dir):
    from ..sources.text import padded

    c = rasters.orders_raster(spark, sf_dir).where("z > 180000")
    return padded(c.select(F.floor(F.col("z") / 100).alias("Elevation_m"), F.format_string("(%d, %d)", "i", "j").alias("Cell_index")))


@query("pair_text_roundtrip", f"WITH {sql.ORD} SELECT i AS a, -j AS b FROM ord")
def pair_text_roundtrip(spark, sf_dir):
    from ..sources.text import pair

    c = rasters.orders_raster(spark, sf_dir).select(F.format_string("(%d, %d)   ", F.col("i"), -F.col("j")).alias("t"))
    return c.select(pair(F.col("t")).alias("p")).select("p.a", "p.b")


@query("mosaic_tiles", f"WITH {SHL} SELECT sheet, CAST(floor((300 - 1) / 5) AS INTEGER) AS tile, CAST(round_even((col - 1) * 299 / 5, 0) AS INTEGER) AS x, CAST(round_even((4 - row) * 299 / 5, 0) AS INTEGER) AS y FROM sh")
def mosaic_tiles(spark, sf_dir):
    from ..sources.svg import tiles

    return tiles(LARGE.sheets(spark), LARGE, 300)
