"""Queries of stencils, filters, contours, relief, layers and marks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import palette as colours
from ..functions import taps
from ..operators import marks, raster, terrain, water
from ..sources import rasters
from . import sql
from .registry import query

#: Rows and columns of the sheets in the SQL; those of larger tables have more.
SHAPE = (120, 125)


def ord_cells(spark, sf_dir):
    return rasters.orders_raster(spark, sf_dir)


def emb_cells(spark, sf_dir):
    return rasters.embedding_raster(spark, sf_dir)


def metres(cells):
    return cells.withColumn("z", F.col("z") / 100.0)


@query("gradient_bickley", f"WITH {sql.ORD}, {sql.gradient('ord', 'gr')} SELECT i, j, g1, g2 FROM gr")
def gradient_bickley(spark, sf_dir):
    return raster.gradient(ord_cells(spark, sf_dir)).select("i", "j", "g1", "g2")


@query("hessian", f"WITH {sql.ORD}, {sql.hessian('ord')} SELECT i, j, h11, h12, h21, h22 FROM hs")
def hessian(spark, sf_dir):
    return raster.hessian(ord_cells(spark, sf_dir)).select("i", "j", "h11", "h12", "h21", "h22")


@query("laplacian", f"WITH {sql.EMB}, {sql.hessian('emb')} SELECT i, j, h11 + h22 AS laplacian FROM hs")
def laplacian(spark, sf_dir):
    return raster.laplacian(emb_cells(spark, sf_dir)).select("i", "j", "laplacian")


@query("mean_stress", f"WITH {sql.ORD}, {sql.hessian('ord')} SELECT i, j, round((h11 + h22) / 288, 6) AS sigma FROM hs")
def mean_stress(spark, sf_dir):
    return raster.mean_stress(ord_cells(spark, sf_dir)).select("i", "j", F.round("sigma", 6).alias("sigma"))


@query("summit_candidates_by_sheet", f"""WITH {sql.ORD}, {sql.hessian('ord')}, c AS (SELECT (i - 1) // 30 AS r, (j - 1) // 25 AS c, z, (i - 1) % 30 + 1 AS ci, (j - 1) % 25 + 1 AS cj FROM hs WHERE z > 20000 AND h11 + h22 < 0 AND h11 + h22 > -288 * 100000)
SELECT CAST(4 - r + c * 4 AS BIGINT) AS sheet, count(*) AS n, max(z) AS z, min(ci + (cj - 1) * 30) FILTER (z = top) AS cell FROM (SELECT *, max(z) OVER (PARTITION BY r, c) AS top FROM c) GROUP BY r, c""")
def summit_candidates_by_sheet(spark, sf_dir):
    """Cells above 200 m on convex ground, by sheet: how many, and the highest."""
    s = raster.mean_stress(ord_cells(spark, sf_dir)).where("z > 20000 and sigma < 0 and sigma > -100000")
    r, c = F.floor((F.col("i") - 1) / 30), F.floor((F.col("j") - 1) / 25)
    cell = (F.col("i") - 1) % 30 + 1 + (F.col("j") - 1) % 25 * 30
    best = F.max(F.struct("z", (-cell).alias("minus")))
    # By place, not by number: on tables of more than four sheets' rows, several sheets have one number.
    tops = s.groupBy(r.alias("r"), c.alias("c")).agg(F.count("*").alias("n"), best.alias("b"))
    return tops.select((4 - F.col("r") + F.col("c") * 4).cast("long").alias("sheet"), "n", F.col("b.z").alias("z"), (-F.col("b.minus")).alias("cell"))


def _sinc(n, v, w, high=False):
    h = n // 2
    centre = f"1 - {1 / v!r}" if high else f"{1 / v!r}"
    sign = "-" if high else ""
    k = f"(k - {h})"
    return f"(CASE WHEN k = {h} THEN {centre} ELSE {sign}sin({np.pi / v!r} * {k}) / ({np.pi!r} * {k}) END) * (0.42 - 0.5 * cos(2 * {np.pi!r} * k / {n - 1}) + 0.08 * cos(4 * {np.pi!r} * k / {n - 1}))"


@query("fir_taps_lp", f"WITH t AS (SELECT k, {_sinc(101, 10, 0)} AS t FROM range(0, 101) AS r(k)) SELECT k, round(t / (SELECT sum(t) FROM t), 9) AS tap FROM t")
def fir_taps_lp(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(taps.fir_lowpass(101, 10))), "k long, tap double").withColumn("tap", F.round("tap", 9))


@query("fir_taps_hp", f"WITH t AS (SELECT k, {_sinc(49, 10, 0, True)} AS t FROM range(0, 49) AS r(k)) SELECT k, round(t, 9) AS tap FROM t")
def fir_taps_hp(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(taps.fir_highpass(49, 10))), "k long, tap double").withColumn("tap", F.round("tap", 9))


def _window_sql(source, weights, shape_i, shape_j, name, z="z"):
    """Two passes of integer taps; the index is clamped at the edges."""
    h, rows = len(weights) // 2, ", ".join(f"({k - len(weights) // 2}, {w})" for k, w in enumerate(weights))
    return f"""{name}_w(d, w) AS (VALUES {rows}),
{name}_h AS (SELECT a.i, a.j, CAST(sum(b.{z} * w) AS BIGINT) AS z FROM {source} a CROSS JOIN {name}_w JOIN {source} b ON b.i = a.i AND b.j = greatest(1, least({shape_j}, a.j + d)) GROUP BY a.i, a.j),
{name} AS (SELECT a.i, a.j, CAST(sum(b.z * w) AS BIGINT) AS z FROM {name}_h a CROSS JOIN {name}_w JOIN {name}_h b ON b.j = a.j AND b.i = greatest(1, least({shape_i}, a.i + d)) GROUP BY a.i, a.j)"""


_MAX_I = "(SELECT max(i) FROM {})"
_SMOOTH = [round(t * 10_000) for t in taps.fir_lowpass(9, 3)]
_ROUGH = [round(t * 1_000) for t in taps.fir_highpass(7, 3)]
_GAUSS = [round(t * 1_000) for t in taps.gaussian(1)]


@query("fir_smooth", f"WITH {sql.EMB}, {_window_sql('emb', _SMOOTH, _MAX_I.format('emb'), 64, 'f')} SELECT i, j, z FROM f")
def fir_smooth(spark, sf_dir):
    """On tiles, as the map job smooths."""
    cells = emb_cells(spark, sf_dir)
    return raster.smooth_tiles(cells, np.array(_SMOOTH), raster.extent(cells, (1, 64)), tile=100).select("i", "j", F.col("v").cast("long").alias("z"))


@query("roughness", f"WITH {sql.EMB}, {_window_sql('emb', _ROUGH, _MAX_I.format('emb'), 64, 'f')} SELECT i, j, z FROM f")
def roughness(spark, sf_dir):
    return raster.separable(emb_cells(spark, sf_dir), _ROUGH).select("i", "j", "z")


@query("gaussian_blur", f"WITH {sql.ORD}, {_window_sql('ord', _GAUSS, _MAX_I.format('ord'), 125, 'f')} SELECT i, j, z FROM f")
def gaussian_blur(spark, sf_dir):
    """The same blur on tiles with a halo, in whole numbers."""
    cells = ord_cells(spark, sf_dir)
    ny = cells.agg(F.max("i")).first()[0] or 1
    return raster.smooth_tiles(cells, np.array(_GAUSS), (int(ny), 125), tile=48).select("i", "j", F.col("v").cast("long").alias("z"))


@query("bumpiness", f"WITH {sql.EMB}, {_window_sql('emb', _ROUGH, _MAX_I.format('emb'), 64, 'f')} SELECT i, j, CASE WHEN emb.z >= 200 OR abs(f.z) / 1e6 < 50 OR abs(f.z) / 1e6 > 300 THEN 0 ELSE round(abs(f.z) / 1e6, 2) END AS bump FROM f JOIN emb USING (i, j)")
def bumpiness(spark, sf_dir):
    cells = emb_cells(spark, sf_dir)
    rough = raster.separable(cells, _ROUGH).select("sheet", "i", "j", (F.col("z") / 1e6).alias("rough"))
    both = cells.join(rough, ["sheet", "i", "j"])
    return both.select("i", "j", F.round(terrain.bumpiness(F.col("rough"), F.col("z"), 50.0, 300.0, 200.0), 2).alias("bump"))


@query("steepness", f"WITH {sql.ORD}, {sql.gradient('ord', 'gr')} SELECT i, j, round(CASE WHEN sqrt(CAST(g1 AS DOUBLE) * g1 + CAST(g2 AS DOUBLE) * g2) / 12 <= 20000 THEN sqrt(CAST(g1 AS DOUBLE) * g1 + CAST(g2 AS DOUBLE) * g2) / 12 ELSE 40000 END, 3) AS st FROM gr")
def steepness(spark, sf_dir):
    g = raster.gradient(ord_cells(spark, sf_dir))
    return g.select("i", "j", F.round(terrain.steepness_or(F.col("g1") / 12, F.col("g2") / 12, 20_000.0), 3).alias("st"))


def _tanh(x):
    return f"((1 - exp(-2 * ({x}))) / (1 + exp(-2 * ({x}))))"


@query("tanh_window", f"WITH {sql.EMB}, {sql.hessian('emb')}, x AS (SELECT i, j, abs(h11 + h22) / 1e6 AS x FROM hs) SELECT i, j, CASE WHEN x > 0 THEN round((1 + {_tanh('log10(x / 1e-2)')}) * (1 - {_tanh('log10(x / 1e-1)')}) / ((1 + {_tanh('0.5')}) * (1 - {_tanh('-0.5')})), 6) ELSE 0 END AS w FROM x")
def tanh_window(spark, sf_dir):
    lap = raster.laplacian(emb_cells(spark, sf_dir))
    return lap.select("i", "j", F.round(terrain.tanh_window(F.abs("laplacian") / 1e6, 1e-2, 1e-1), 6).alias("w"))


@query("downsample", f"WITH {sql.ORD} SELECT (i - 1) // 3 + 1 AS i, (j - 1) // 3 + 1 AS j, z FROM ord WHERE (i - 1) % 3 = 0 AND (j - 1) % 3 = 0")
def downsample(spark, sf_dir):
    return raster.sampled(ord_cells(spark, sf_dir), 3).select("i", "j", "z")


@query("downsize_mean", f"WITH {sql.ORD}, {_window_sql('ord', [1] * 5, _MAX_I.format('ord'), 125, 'f')} SELECT (i - 1) // 4 + 1 AS i, (j - 1) // 4 + 1 AS j, z AS total, round(z / 25, 4) AS mean FROM f WHERE (i - 1) % 4 = 0 AND (j - 1) % 4 = 0")
def downsize_mean(spark, sf_dir):
    return raster.box_sums(ord_cells(spark, sf_dir), 4).select("i", "j", "total", F.round(F.col("total") / F.col("n_cells"), 4).alias("mean"))


def _contour_sql(step):
    tooth = lambda x: f"((({x} - {step / 2}) % {step}) + {step}) % {step} - {step / 2}"
    cell = "c.{0}"
    mixed = ", ".join(f"share * (sm_{k} - 4) + (1 - share) * z_{k} AS h_{k}" for k in ("nw", "n", "ne", "w", "z", "e", "sw", "s", "se"))
    pick = ", ".join(f"a.{k} / 100.0 AS z_{k}, b.{k} / 100.0 AS sm_{k}" for k in ("nw", "n", "ne", "w", "z", "e", "sw", "s", "se"))
    share = " + ".join(f"c.{k}" for k in ("nw", "n", "ne", "w", "z", "e", "sw", "s", "se"))
    cross = " OR ".join(f"sign({tooth('h_' + a)}) * sign({tooth('h_' + b)}) = -1" for a, b in (("w", "e"), ("n", "s"), ("nw", "se"), ("sw", "ne")))
    steep = " OR ".join(f"abs(h_z - h_{k}) >= {step / 2}" for k in "ewns")
    return f"""src AS (SELECT i, j, h AS z, h - h % 700 AS smooth, CASE WHEN z % 3 = 0 THEN 1 ELSE 0 END AS forest FROM (SELECT *, i * 1370 + j * 590 + z % 300 AS h FROM ord)),
{sql.around('src', 'a', 'z')}, {sql.around('src', 'b', 'smooth')}, {sql.around('src', 'c', 'forest')},
m AS (SELECT a.i, a.j, ({share}) / 9.0 AS share, {pick} FROM a JOIN b USING (i, j) JOIN c USING (i, j)),
h AS (SELECT i, j, {mixed} FROM m),
line AS (SELECT i, j, CASE WHEN h_z < {step} THEN false WHEN abs({tooth('h_z')}) > 3 THEN false WHEN {steep} THEN false ELSE {cross} END AS contour FROM h)"""


def contour_source(spark, sf_dir):
    """A slope with small bumps, so that lines of all three distances pass."""
    c = ord_cells(spark, sf_dir).withColumn("h", F.col("i") * 1370 + F.col("j") * 590 + F.col("z") % 300)
    return c.select("sheet", "i", "j", (F.col("h") / 100.0).alias("z"), ((F.col("h") - F.col("h") % 700) / 100.0).alias("smooth"), F.when(F.col("z") % 3 == 0, 1).otherwise(0).alias("forest"))


def _contour(step):
    @query(f"contour_{step}", f"WITH {sql.ORD}, {_contour_sql(step)} SELECT i, j, contour FROM line")
    def run(spark, sf_dir):
        return terrain.contour(contour_source(spark, sf_dir), float(step)).select("i", "j", "contour")

    return run


for _step in (20, 100, 1000):
    _contour(_step)


@query("contour_union", "WITH " + sql.ORD + "".join(f", l{s} AS (WITH {_contour_sql(s)} SELECT i, j FROM line WHERE contour)" for s in (100, 1000)) + " SELECT i, j FROM l100 UNION SELECT i, j FROM l1000")
def contour_union(spark, sf_dir):
    src = contour_source(spark, sf_dir)
    parts = [terrain.contour(src, float(s)).where("contour").select("i", "j") for s in (100, 1000)]
    return parts[0].union(parts[1]).distinct()


@query("dilate", f"WITH {sql.ORD}, m AS (SELECT i, j FROM ord WHERE z % 211 = 0), d(d) AS (VALUES (-2), (-1), (0), (1), (2)) SELECT DISTINCT i + a.d AS i, j + b.d AS j FROM m CROSS JOIN d a CROSS JOIN d b WHERE i + a.d BETWEEN 1 AND 120 AND j + b.d BETWEEN 1 AND 125")
def dilate(spark, sf_dir):
    cells = ord_cells(spark, sf_dir)
    return terrain.dilate(cells.where("z % 211 = 0"), 2, raster.extent(cells, SHAPE)).select("i", "j")


@query("ridge_class", f"WITH {sql.EMB}, {sql.hessian('emb')} SELECT i, j, CASE WHEN i > 5 AND i < 500 - 5 AND j > 5 AND j < 64 - 5 THEN CASE WHEN j % 7 = 0 THEN 0 WHEN (h11 + h22) / 144000 > 0.2 THEN 2 WHEN (h11 + h22) / 144000 < -0.05 THEN 1 ELSE 0 END ELSE 0 END AS ridge FROM hs")
def ridge_class(spark, sf_dir):
    cells = emb_cells(spark, sf_dir)
    lap = raster.laplacian(cells)
    forest = F.when(F.col("j") % 7 == 0, 1).otherwise(0)
    inside = terrain.inside_border(F.col("i"), F.col("j"), 5, raster.extent(cells, (500, 64)))
    return lap.select("i", "j", F.when(inside, terrain.ridge_class(F.col("laplacian") / 144_000, forest)).otherwise(0).alias("ridge"))


_NORMAL = "SELECT i, j, z, -((e - w) / 200.0) / sqrt(1 + ((n - s) / 200.0) * ((n - s) / 200.0) + ((e - w) / 200.0) * ((e - w) / 200.0)) AS ne_, -((n - s) / 200.0) / sqrt(1 + ((n - s) / 200.0) * ((n - s) / 200.0) + ((e - w) / 200.0) * ((e - w) / 200.0)) AS nn_, 1 / sqrt(1 + ((n - s) / 200.0) * ((n - s) / 200.0) + ((e - w) / 200.0) * ((e - w) / 200.0)) AS nu_ FROM nb"


@query("surface_normals", f"WITH {sql.ORD}, {sql.around('ord')}, x AS ({_NORMAL}) SELECT i, j, round(ne_, 6) AS n_east, round(nn_, 6) AS n_north, round(nu_, 6) AS n_up FROM x")
def surface_normals(spark, sf_dir):
    n = terrain.normals(metres(ord_cells(spark, sf_dir)))
    return n.select("i", "j", *[F.round(k, 6).alias(k) for k in ("n_east", "n_north", "n_up")])


def _reflect_sql(k):
    e, n, u = terrain.lights()[k - 1]
    high = 1.2 if k == 3 else 0.4
    exponent = f"CASE WHEN z <= 40000 THEN 1.2 WHEN z < 50000 THEN 1.2 * (1 - (z / 100.0 - 400) / 100) + {high} * ((z / 100.0 - 400) / 100) ELSE {high} END"
    return f"least(1.0, pow(greatest(0.0, nn_ * {n!r} + ne_ * {e!r} + nu_ * {u!r}), {exponent}))"


@query("lambert_relief", f"WITH {sql.ORD}, {sql.around('ord')}, x AS ({_NORMAL}) SELECT i, j, " + ", ".join(f"round({_reflect_sql(k)}, 5) AS r{k}" for k in (1, 2, 3, 4)) + " FROM x")
def lambert_relief(spark, sf_dir):
    n = terrain.normals(metres(ord_cells(spark, sf_dir)))
    return n.select("i", "j", *[F.round(terrain.reflection(k), 5).alias(f"r{k}") for k in (1, 2, 3, 4)])


def _palette_sql():
    def interpolated(table, light, part):
        pieces = []
        for k in range(len(colours.STOPS) - 1):
            a, b, lo, hi = table[k][part], table[k + 1][part], colours.STOPS[k], colours.STOPS[k + 1]
            pieces.append(f"WHEN step < {hi} THEN {a!r} * (1 - (step - {lo}) / {hi - lo}.0) + {b!r} * ((step - {lo}) / {hi - lo}.0)")
        return f"CASE {' '.join(pieces)} ELSE {table[-1][part]!r} END"

    rows = []
    for light, table in enumerate(colours.LIGHTS, 1):
        rows.append(f"SELECT CAST(step AS INTEGER) AS step, {light} AS light, " + ", ".join(f"{interpolated(table, light, k)} AS {name}" for k, name in enumerate("xyz")) + " FROM range(1, 1501) AS r(step)")
    return "pal AS (" + " UNION ALL ".join(rows) + ")"


@query("palette_lookup", f"WITH {sql.ORD}, {_palette_sql()} SELECT i, j, light, round(x, 6) AS x, round(y, 6) AS y, round(pal.z, 6) AS z FROM ord JOIN pal ON step = greatest(1, least(1500, round_even(ord.z / 100.0, 0)))")
def palette_lookup(spark, sf_dir):
    step = F.least(F.greatest(F.rint(F.col("z") / 100.0), F.lit(1.0)), F.lit(1500.0)).cast("int")
    cells = ord_cells(spark, sf_dir).select("i", "j", step.alias("step"))
    return cells.join(F.broadcast(colours.palette(spark)), "step").select("i", "j", "light", *[F.round(k, 6).alias(k) for k in "xyz"])


@query("relief", f"WITH {sql.ORD}, {sql.around('ord')}, x AS ({_NORMAL}), {_palette_sql()}, c AS (SELECT i, j, light, p.x * r AS x, p.y * r AS y, p.z * r AS z FROM (SELECT i, j, greatest(1, least(1500, round_even(z / 100.0, 0))) AS step, unnest([" + ", ".join(f"struct_pack(light := {k}, r := {_reflect_sql(k)})" for k in (1, 2, 3, 4)) + "], recursive := true) FROM x) JOIN pal p USING (step, light)), b AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY y DESC, light) AS k FROM c) SELECT i, j, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM b WHERE k = 1")
def relief(spark, sf_dir):
    r = terrain.relief(metres(ord_cells(spark, sf_dir)), colours.palette(spark))
    return r.select("i", "j", *[F.round(k, 4).alias(k) for k in "xyz"])


def _lin(v):
    return f"(CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END)"


@query("luminance", f"WITH {sql.ORD}, c AS (SELECT i, j, (z % 256) / 255.0 AS r, (z // 3 % 256) / 255.0 AS g, (z // 7 % 256) / 255.0 AS b FROM ord), y AS (SELECT i, j, 0.2126 * {_lin('r')} + 0.7152 * {_lin('g')} + 0.0722 * {_lin('b')} AS y FROM c) SELECT i, j, round(y, 6) AS y, round(CASE WHEN y <= 216 / 24389 THEN y * 24389 / 27 ELSE pow(y, 1.0 / 3) * 116 - 16 END, 5) AS lightness FROM y")
def luminance(spark, sf_dir):
    c = ord_cells(spark, sf_dir)
    part = lambda k: (F.floor(F.col("z") / k) % 256) / 255.0
    y = c.select("i", "j", terrain.luminance(part(1), part(3), part(7)).alias("y"))
    return y.select("i", "j", F.round("y", 6).alias("y"), F.round(terrain.lightness(F.col("y")), 5).alias("lightness"))


@query("grid_lines", f"WITH {sql.POINTS} SELECT id, (e % 100 <= 1 OR e % 100 >= 98 OR n % 100 <= 1 OR n % 100 >= 98) AS line FROM points")
def grid_lines(spark, sf_dir):
    from .geometry_queries import points

    return points(spark, sf_dir).select("id", terrain.on_grid_line(F.col("e"), F.col("n"), 100, 5).alias("line"))


_RGBA = "c AS (SELECT i, j, z % 256 AS r, z // 3 % 256 AS g, z // 7 % 256 AS b, z // 11 % 256 AS a, z // 13 % 256 AS r2, z // 17 % 256 AS g2, z // 19 % 256 AS b2 FROM ord)"


def _rgba_cells(spark, sf_dir):
    part = lambda k: (F.floor(F.col("z") / k) % 256).cast("long")
    top = F.struct(*[part(k).alias(n) for k, n in ((1, "r"), (3, "g"), (7, "b"), (11, "a"))])
    below = F.struct(*[part(k).alias(n) for k, n in ((13, "r"), (17, "g"), (19, "b"))], F.lit(255).cast("long").alias("a"))
    return ord_cells(spark, sf_dir).select("i", "j", top.alias("top"), below.alias("below"))


@query("composite_over", f"WITH {sql.ORD}, {_RGBA} SELECT i, j, " + ", ".join(f"CAST(({k} * a * 255 + {k}2 * 255 * (255 - a) + 32512) // 65025 AS INTEGER) AS {k}" for k in "rgb") + " FROM c")
def composite_over(spark, sf_dir):
    return _rgba_cells(spark, sf_dir).select("i", "j", terrain.over(F.col("top"), F.col("below")).alias("c")).select("i", "j", "c.r", "c.g", "c.b")


@query("composite_multiply", f"WITH {sql.ORD}, {_RGBA} SELECT i, j, " + ", ".join(f"CAST(({k}2 * (65025 - a * (255 - {k})) + 32512) // 65025 AS INTEGER) AS {k}" for k in "rgb") + " FROM c")
def composite_multiply(spark, sf_dir):
    return _rgba_cells(spark, sf_dir).select("i", "j", terrain.multiply(F.col("top"), F.col("below")).alias("c")).select("i", "j", "c.r", "c.g", "c.b")


@query("thumbnail", f"WITH {sql.ORD}, c AS (SELECT i, j, z // 13 % 256 AS z FROM ord), {_window_sql('c', [1] * 5, _MAX_I.format('c'), 125, 'f')} SELECT (i - 1) // 5 + 1 AS i, (j - 1) // 5 + 1 AS j, CAST((2 * z + 25) // 50 AS BIGINT) AS r FROM f WHERE (i - 1) % 5 = 0 AND (j - 1) % 5 = 0")
def thumbnail(spark, sf_dir):
    cells = _rgba_cells(spark, sf_dir).select(F.lit(1).alias("sheet"), "i", "j", F.col("below.r").alias("z"))
    return raster.box_sums(cells, 5).select("i", "j", F.floor((2 * F.col("total") + F.col("n_cells")) / (2 * F.col("n_cells"))).cast("long").alias("r"))


@query("mark_shapes", "SELECT shape, side, CAST(n AS BIGINT) AS n FROM (VALUES ('on_square', 3, 8), ('on_square', 9, 32), ('on_square', 99, 392), ('on_circle', 3, 9), ('on_circle', 9, 32), ('on_circle', 99, 312), ('on_triangle', 3, 6), ('on_triangle', 9, 23), ('on_triangle', 99, 301), ('on_hline', 9, 9), ('on_vline', 9, 9), ('on_cross', 3, 5), ('on_cross', 9, 17), ('on_cross', 99, 197), ('on_xcross', 3, 5), ('on_xcross', 9, 17), ('on_xcross', 99, 197), ('in_triangle', 3, 4), ('in_triangle', 9, 25), ('in_triangle', 99, 3110), ('in_circle', 3, 9), ('in_circle', 9, 69), ('in_circle', 99, 7705), ('in_square', 3, 9), ('in_square', 9, 81), ('in_square', 99, 9801)) AS t(shape, side, n)")
def mark_shapes(spark, sf_dir):
    cases = [("on_square", (3, 9, 99)), ("on_circle", (3, 9, 99)), ("on_triangle", (3, 9, 99)), ("on_hline", (9,)), ("on_vline", (9,)), ("on_cross", (3, 9, 99)), ("on_xcross", (3, 9, 99)), ("in_triangle", (3, 9, 99)), ("in_circle", (3, 9, 99)), ("in_square", (3, 9, 99))]
    rows = [(shape, side, i, j) for shape, sides in cases for side in sides for i, j in marks.offsets(shape, side)]
    spots = spark.createDataFrame(rows, "shape string, side int, di int, dj int").where("50 + di between 1 and 100 and 50 + dj between 1 and 100")
    return spots.groupBy("shape", "side").agg(F.count("*").alias("n"))


@query("stamped_squares", f"WITH {sql.ORD}, m AS (SELECT i, j FROM ord WHERE z % 997 = 0), o AS (SELECT a.d AS di, b.d AS dj FROM range(-2, 3) a(d), range(-2, 3) b(d) WHERE greatest(abs(a.d), abs(b.d)) = 2) SELECT DISTINCT i + di AS i, j + dj AS j FROM m CROSS JOIN o WHERE i + di BETWEEN 1 AND 120 AND j + dj BETWEEN 1 AND 125")
def stamped_squares(spark, sf_dir):
    cells = ord_cells(spark, sf_dir)
    return marks.stamped(cells.where("z % 997 = 0"), "on_square", 5, raster.extent(cells, SHAPE)).select("i", "j")


@query("line_points", "WITH s AS (SELECT s_suppkey AS k, s_suppkey % 100 + 1 AS i0, s_suppkey * 7 % 100 + 1 AS j0, s_suppkey * 13 % 100 + 1 AS i1, s_suppkey * 29 % 100 + 1 AS j1 FROM supplier), n AS (SELECT *, greatest(abs(i1 - i0), abs(j1 - j0)) AS n FROM s), t AS (SELECT *, unnest(range(0, n + 1)) AS t FROM n) SELECT DISTINCT CAST(k AS INTEGER) AS sheet, CAST(i0 + floor((2 * (i1 - i0) * t + n) / greatest(2 * n, 1)) AS BIGINT) AS i, CAST(j0 + floor((2 * (j1 - j0) * t + n) / greatest(2 * n, 1)) AS BIGINT) AS j FROM t")
def line_points(spark, sf_dir):
    k = F.col("s_suppkey")
    ends = rasters.table(spark, sf_dir, "supplier").select(k.cast("int").alias("sheet"), *[(k * f % 100 + 1).alias(n) for f, n in ((1, "i0"), (7, "j0"), (13, "i1"), (29, "j1"))])
    return marks.lines(ends, 0, (100, 100))


@query("gray_codec", f"WITH {sql.ORD} SELECT i, j, CAST(CASE WHEN z <= 20000 OR z >= 120000 THEN 0 ELSE round_even((z - 20000) / 100000.0 * 255, 0) END AS INTEGER) AS grey FROM ord")
def gray_codec(spark, sf_dir):
    return ord_cells(spark, sf_dir).select("i", "j", raster.codec_encode(F.col("z").cast("double"), 20_000.0, 120_000.0).alias("grey"))


@query("gray_overlay", f"WITH {sql.ORD}, g AS (SELECT i, j, z, CASE WHEN z <= 20000 OR z >= 120000 THEN 0 ELSE round_even((z - 20000) / 100000.0 * 255, 0) END AS grey FROM ord) SELECT i, j, round(CASE WHEN grey > 0 THEN grey * (100000 / 255.0) + 20000 ELSE z END, 3) AS z FROM g")
def gray_overlay(spark, sf_dir):
    grey = raster.codec_encode(F.col("z").cast("double"), 20_000.0, 120_000.0)
    return ord_cells(spark, sf_dir).select("i", "j", F.round(raster.codec_decode(grey, F.col("z").cast("double"), 20_000.0, 120_000.0), 3).alias("z"))


@query("low_water", f"WITH {sql.ORD} SELECT i, j, z <= 3000 AS low FROM ord")
def low_water(spark, sf_dir):
    return ord_cells(spark, sf_dir).select("i", "j", water.low_water(F.col("z"), 3000).alias("low"))


@query("water_colors", f"WITH {sql.ORD} SELECT i, j, CAST(CASE WHEN z % 3 = 0 AND z > 100000 THEN 204 WHEN z % 3 = 0 THEN 133 ELSE 0 END AS INTEGER) AS r, CAST(CASE WHEN z % 3 = 0 THEN 255 ELSE 0 END AS INTEGER) AS a FROM ord")
def water_colors(spark, sf_dir):
    c = metres(ord_cells(spark, sf_dir).withColumn("wet", F.col("z") % 3 == 0))
    return c.select("i", "j", water.colour(F.col("wet"), F.col("z")).alias("c")).select("i", "j", "c.r", "c.a")
