"""Queries of the map job's steps: smoothed curvature, strokes, marks, merged graphs, files and images of sheets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry, taps, utm
from ..operators import graphs, marks, raster, segments, terrain, water
from ..sources import geotiff, png, rasters
from . import sql
from .geometry_queries import _BOXES, LARGE, SHL, boxes
from .graph_queries import _SHEETED, _SUMMITS, SHEET, sheeted, sheets, summit_rows, tree
from .registry import query
from .terrain_queries import _SMOOTH, _rgba_cells, _window_sql, emb_cells

NY, NX = SHEET
#: orders_raster cut into sheets, as rasters.orders_sheets does.
CELLS = f"cells AS MATERIALIZED (SELECT CAST((i - 1) // {NY} + 1 AS INTEGER) AS sheet, (i - 1) % {NY} + 1 AS i, j, z FROM ord)"


def _regions(source: str, value: str, name: str = "lab") -> str:
    """name(sheet, i, j, value, label) of cells of a source: the least column-major number of each 4-connected region, by recursion."""
    return f"""{name}_c AS MATERIALIZED (SELECT sheet, i, j, {value} AS v, i + (j - 1) * {NY} AS id FROM {source}),
{name}_e AS MATERIALIZED (SELECT x.sheet, x.id AS a, y.id AS b FROM {name}_c x JOIN {name}_c y ON x.sheet = y.sheet AND x.i = y.i AND x.j + 1 = y.j AND x.v = y.v
  UNION ALL SELECT x.sheet, x.id, y.id FROM {name}_c x JOIN {name}_c y ON x.sheet = y.sheet AND x.i + 1 = y.i AND x.j = y.j AND x.v = y.v),
{name}_b AS MATERIALIZED (SELECT sheet, a, b FROM {name}_e UNION ALL SELECT sheet, b, a FROM {name}_e),
{name}_w AS (SELECT sheet, id, id AS seen FROM {name}_c UNION SELECT w.sheet, w.id, e.b FROM {name}_w w JOIN {name}_b e ON w.sheet = e.sheet AND w.seen = e.a),
{name} AS MATERIALIZED (SELECT c.sheet, c.i, c.j, c.v, w.label FROM {name}_c c JOIN (SELECT sheet, id, min(seen) AS label FROM {name}_w GROUP BY ALL) w USING (sheet, id))"""


def _thinned(source: str, rounds: int) -> str:
    """thin(sheet, i, j, m): so many rounds of two passes over all cells (m: marked); what is outside counts as not marked."""
    out, last = [], source
    for k in range(2 * rounds):
        row = f"SELECT sheet, i, j, m, coalesce(lag(m) OVER r, false) AS w, coalesce(lead(m) OVER r, false) AS e FROM {last} WINDOW r AS (PARTITION BY sheet, i ORDER BY j)"
        around = ", ".join([f"coalesce(lag({c}) OVER c, false) AS {n}, coalesce(lead({c}) OVER c, false) AS {s}" for c, n, s in (("m", "p2", "p6"), ("e", "p3", "p5"), ("w", "p9", "p7"))])
        stays = "(p6 OR p7 OR NOT p9) AND p8" if k % 2 == 0 else "(p2 OR p3 OR NOT p5) AND p4"
        crossings = " + ".join(f"CAST(NOT p{a} AND (p{b} OR p{d}) AS INTEGER)" for a, b, d in ((2, 3, 4), (4, 5, 6), (6, 7, 8), (8, 9, 2)))
        pairs = [" + ".join(f"CAST(p{a} OR p{b} AS INTEGER)" for a, b in p) for p in (((9, 2), (3, 4), (5, 6), (7, 8)), ((2, 3), (4, 5), (6, 7), (8, 9)))]
        name = "thin" if k == 2 * rounds - 1 else f"thin{k}"
        out.append(f"""{name} AS MATERIALIZED (SELECT sheet, i, j, m AND NOT ({crossings} = 1 AND least({pairs[0]}, {pairs[1]}) BETWEEN 2 AND 3 AND NOT ({stays})) AS m
  FROM (SELECT sheet, i, j, m, w AS p8, e AS p4, {around} FROM ({row}) WINDOW c AS (PARTITION BY sheet, j ORDER BY i)))""")
        last = name
    return ",\n".join(out)


#: Rounds after which nothing more goes from scattered marks.
ROUNDS = 8
_MARKS = f"{sql.ORD}, {CELLS}, marked AS (SELECT sheet, i, j, z % 200 < 80 AS m FROM cells), {_thinned('marked', ROUNDS)}"


@query("thinning", f"WITH {_MARKS} SELECT sheet, i, j FROM thin WHERE m")
def thinning(spark, sf_dir):
    cells = sheets(spark, sf_dir).withColumn("marked", F.col("z") % 200 < 80)
    return segments.thinned(cells, SHEET).select("sheet", "i", "j")


@query("strokes", f"""WITH RECURSIVE {_MARKS}, left_ AS (SELECT * FROM thin WHERE m), {_regions("left_", "m")},
d(d) AS (VALUES (-1), (0), (1)), long AS (SELECT sheet, i, j FROM lab JOIN (SELECT sheet, label FROM lab GROUP BY ALL HAVING count(*) > 4) USING (sheet, label))
SELECT DISTINCT sheet, i + a.d AS i, j + b.d AS j FROM long CROSS JOIN d a CROSS JOIN d b WHERE i + a.d BETWEEN 1 AND {NY} AND j + b.d BETWEEN 1 AND {NX}""")
def strokes(spark, sf_dir):
    from .pipeline import stroked

    cells = sheets(spark, sf_dir).withColumn("marked", F.col("z") % 200 < 80)
    return stroked(cells, SHEET, 3, 4).select("sheet", "i", "j")


def _pruned(source: str, name: str, least: int) -> str:
    """name(sheet, i, j, v, label) of source: regions below least cells joined to their neighbour of highest mean."""
    n = name
    return f"""{n}_s AS MATERIALIZED (SELECT sheet, label, count(*) AS n, sum(v) / count(*) AS mean FROM {source} GROUP BY ALL),
{n}_h AS (SELECT x.sheet, x.label, y.label AS other FROM {source} x JOIN {source} y ON x.sheet = y.sheet AND x.i = y.i AND x.j + 1 = y.j UNION SELECT x.sheet, x.label, y.label FROM {source} x JOIN {source} y ON x.sheet = y.sheet AND x.i + 1 = y.i AND x.j = y.j),
{n}_a AS (SELECT * FROM {n}_h WHERE label <> other UNION SELECT sheet, other, label FROM {n}_h WHERE label <> other),
{n}_t AS MATERIALIZED (SELECT a.sheet, a.label, a.other FROM {n}_a a JOIN {n}_s s ON s.sheet = a.sheet AND s.label = a.label AND s.n < {least} JOIN {n}_s o ON o.sheet = a.sheet AND o.label = a.other
  QUALIFY row_number() OVER (PARTITION BY a.sheet, a.label ORDER BY o.mean DESC, a.other) = 1),
{n}_f AS (SELECT sheet, label, label AS prev, other AS cur FROM {n}_t UNION ALL SELECT f.sheet, f.label, f.cur, t.other FROM {n}_f f JOIN {n}_t t ON t.sheet = f.sheet AND t.label = f.cur WHERE t.other <> f.prev),
{n}_r AS MATERIALIZED (SELECT f.sheet, f.label, CASE WHEN t.label IS NULL THEN f.cur ELSE least(f.cur, f.prev) END AS root FROM {n}_f f LEFT JOIN {n}_t t ON t.sheet = f.sheet AND t.label = f.cur WHERE t.label IS NULL OR t.other = f.prev),
{n} AS MATERIALIZED (SELECT s.sheet, s.i, s.j, s.v, coalesce(r.root, s.label) AS label FROM {source} s LEFT JOIN {n}_r r ON r.sheet = s.sheet AND r.label = s.label)"""


@query("prune_small_segments", f"WITH RECURSIVE {sql.ORD}, {CELLS}, {_regions('cells', 'z % 200 // 50')}, {_pruned('lab', 'q1', 6)}, {_pruned('q1', 'q2', 6)}, {_pruned('q2', 'q3', 6)} SELECT sheet, label, count(*) AS n FROM q3 GROUP BY ALL")
def prune_small_segments(spark, sf_dir):
    cells = sheets(spark, sf_dir).withColumn("v", F.floor(F.col("z") % 200 / 50).cast("int"))
    cells = segments.labelled(cells, "v", NY)
    return segments.prune_small(cells, 6).groupBy("sheet", "label").agg(F.count("*").alias("n"))


@query("segment_flux", f"WITH RECURSIVE {sql.ORD}, {CELLS}, {_regions('cells', 'z % 200 // 50')} SELECT sheet, label, CAST(CASE WHEN min(i) = 1 OR min(j) = 1 OR max(i) = {NY} OR max(j) = {NX} THEN 0 ELSE sum(z) END AS BIGINT) AS flux FROM lab JOIN cells USING (sheet, i, j) GROUP BY ALL")
def segment_flux(spark, sf_dir):
    return segments.segment_stats(classed(spark, sf_dir).withColumn("v", F.col("z")), SHEET).select("sheet", "label", "flux")


_CLASSED = f"WITH RECURSIVE {sql.ORD}, {CELLS}, {_regions('cells', 'z % 200 // 50')}"


def classed(spark, sf_dir):
    """Cells in four classes, and the regions of each."""
    return segments.labelled(sheets(spark, sf_dir).withColumn("k", F.floor(F.col("z") % 200 / 50)), "k", NY)


@query("cc_labels", f"{_CLASSED} SELECT sheet, i, j, label FROM lab")
def cc_labels(spark, sf_dir):
    return classed(spark, sf_dir).select("sheet", "i", "j", "label")


_STATS = f"""SELECT sheet, label, count(*) AS n, CAST(sum(z) AS BIGINT) AS total, CAST(sum(i) AS BIGINT) // count(*) AS mean_i, CAST(sum(j) AS BIGINT) // count(*) AS mean_j, min(i) AS i_min, max(i) AS i_max, min(j) AS j_min, max(j) AS j_max, min(z) AS z_min, max(z) AS z_max,
CAST(CASE WHEN min(i) = 1 OR min(j) = 1 OR max(i) = {NY} OR max(j) = {NX} THEN 0 ELSE sum(z) END AS BIGINT) AS flux, (max(i) - min(i)) ** 2 + (max(j) - min(j)) ** 2 AS diagonal2 FROM lab JOIN cells USING (sheet, i, j) GROUP BY sheet, label"""


@query("segment_stats", f"{_CLASSED} {_STATS}")
def segment_stats(spark, sf_dir):
    return segments.segment_stats(classed(spark, sf_dir).withColumn("v", F.col("z")), SHEET)


@query("lake_slope_test", f"{_CLASSED} SELECT sheet, label, z_max - z_min <= least(sqrt(diagonal2) * 10, 100.0) / 100.0 * 300000 AS level FROM ({_STATS})")
def lake_slope_test(spark, sf_dir):
    stats = segments.segment_stats(classed(spark, sf_dir).withColumn("v", F.col("z")), SHEET)
    return water.slope_segments(stats, 10, 100.0, 300_000.0).select("sheet", "label", "level")


_WET = f"WITH RECURSIVE {sql.ORD}, {CELLS}, wet AS (SELECT *, true AS m FROM cells WHERE z % 200 < 60), {_regions('wet', 'm')}"


@query("small_stroke_filter", f"{_WET} SELECT sheet, i, j FROM lab JOIN (SELECT sheet, label FROM lab GROUP BY ALL HAVING count(*) > 3) USING (sheet, label)")
def small_stroke_filter(spark, sf_dir):
    return segments.long_strokes(sheets(spark, sf_dir).withColumn("marked", F.col("z") % 200 < 60), NY, 3).select("sheet", "i", "j")


@query("water_table", f"""{_WET}, s AS (SELECT sheet, label, count(*) AS n, CAST(sum(i) AS BIGINT) // count(*) AS i, CAST(sum(j) AS BIGINT) // count(*) AS j FROM lab GROUP BY ALL)
SELECT s.sheet, s.label, CAST(round_even(t.z / 100.0, 0) AS BIGINT) AS elevation_m, n * 9 AS area_m2, (s.j - 1) * 3 + 44000 AS e, ({NY} - s.i + 1) * 3 + 6909047 AS n_, s.i, s.j FROM s JOIN cells t ON t.sheet = s.sheet AND t.i = s.i AND t.j = s.j""")
def water_table(spark, sf_dir):
    cells = sheets(spark, sf_dir).withColumn("wet", F.col("z") % 200 < 60)
    lakes = segments.labelled(cells.where("wet"), "wet", NY).select("sheet", "i", "j", "label")
    cells = cells.join(lakes, ["sheet", "i", "j"], "left").withColumns({"z": F.col("z") / 100.0, "water": F.col("wet")})
    return water.water_table(cells, SHEET, 3, (44000, 6909047))


_HEAP = "(CASE WHEN water THEN 1 ELSE 0 END)"


@query("water_heaps", f"""WITH RECURSIVE {sql.ORD}, {CELLS}, {_regions('cells', 'z % 200 // 50')},
c AS MATERIALIZED (SELECT l.*, z, z % 3 > 0 AS water, z % 100 - 60 AS lap FROM lab l JOIN cells USING (sheet, i, j)),
s AS MATERIALIZED (SELECT sheet, label, count(*) AS n, avg({_HEAP}) AS share, sum({_HEAP}) / count(*) AS mean, CASE WHEN min(i) = 1 OR min(j) = 1 OR max(i) = {NY} OR max(j) = {NX} THEN 0 ELSE sum(lap) END AS flux FROM c GROUP BY ALL),
h AS (SELECT x.sheet, x.label, y.label AS other FROM c x JOIN c y ON x.sheet = y.sheet AND x.i = y.i AND x.j + 1 = y.j UNION SELECT x.sheet, x.label, y.label FROM c x JOIN c y ON x.sheet = y.sheet AND x.i + 1 = y.i AND x.j = y.j),
a AS (SELECT * FROM h WHERE label <> other UNION SELECT sheet, other, label FROM h WHERE label <> other),
t AS MATERIALIZED (SELECT a.sheet, a.label, a.other FROM a JOIN s ON s.sheet = a.sheet AND s.label = a.label AND s.share > 0.5 AND s.flux <= -8.0 JOIN s o ON o.sheet = a.sheet AND o.label = a.other QUALIFY row_number() OVER (PARTITION BY a.sheet, a.label ORDER BY o.mean, a.other) = 1),
f AS (SELECT sheet, label, label AS prev, other AS cur FROM t UNION ALL SELECT f.sheet, f.label, f.cur, t.other FROM f JOIN t ON t.sheet = f.sheet AND t.label = f.cur WHERE t.other <> f.prev),
r AS (SELECT f.sheet, f.label, CASE WHEN t.label IS NULL THEN f.cur ELSE least(f.cur, f.prev) END AS root FROM f LEFT JOIN t ON t.sheet = f.sheet AND t.label = f.cur WHERE t.label IS NULL OR t.other = f.prev),
m AS MATERIALIZED (SELECT c.sheet, c.i, c.j, c.water, coalesce(r.root, c.label) AS label FROM c LEFT JOIN r ON r.sheet = c.sheet AND r.label = c.label),
w AS (SELECT sheet, label, share > 0.5 AS water FROM (SELECT sheet, label, avg({_HEAP}) AS share FROM m GROUP BY sheet, label))
SELECT m.sheet, m.i, m.j, m.label, w.water FROM m JOIN w USING (sheet, label)""")
def water_heaps(spark, sf_dir):
    cells = classed(spark, sf_dir).withColumns({"water": F.col("z") % 3 > 0, "v": F.col("z") % 100 - 60})
    return water.without_heaps(cells, SHEET, 1, -8.0).select("sheet", "i", "j", "label", "water")


def _artifact_sql() -> str:
    lap = f"{sql.ORD}, {CELLS}, lap AS (SELECT sheet, i, j, z / 1e6 AS z FROM cells)"
    side = lambda f, c, over: f"coalesce({f}({c}) OVER {over}, {c})"
    row = f"SELECT sheet, i, j, z, {side('lag', 'z', 'r')} AS w, {side('lead', 'z', 'r')} AS e FROM lap WINDOW r AS (PARTITION BY sheet, i ORDER BY j)"
    around = ", ".join(f"{side('lag', c, 'c')} AS {n}, {side('lead', c, 'c')} AS {s}" for c, n, s in (("z", "n", "s"), ("w", "nw", "sw"), ("e", "ne", "se")))
    change = "abs(((sw - nw) + 4 * (s - n) + (se - ne) + (ne - nw) + 4 * (e - w) + (se - sw)) / 12.0)"
    tanh = lambda x: f"((1 - exp(-2 * ({x}))) / (1 + exp(-2 * ({x}))))"
    x0, x1 = 1e-6, 10**-3.5
    half = (np.log10(x1) - np.log10(x0)) / 2
    window = f"CASE WHEN x > 0 THEN (1 + {tanh(f'log10(x / {x0!r})')}) * (1 - {tanh(f'log10(x / {x1!r})')}) / ((1 + {tanh(half)}) * (1 - {tanh(-half)})) ELSE 0 END"
    t = taps.gaussian(1)
    rows = ", ".join(f"({k - len(t) // 2}, {float(v)!r}::DOUBLE)" for k, v in enumerate(t))
    return f"""WITH {lap}, x AS (SELECT sheet, i, j, {change} AS x FROM (SELECT sheet, i, j, w, e, {around} FROM ({row}) WINDOW c AS (PARTITION BY sheet, j ORDER BY i))),
v AS MATERIALIZED (SELECT sheet, i, j, max(i) OVER (PARTITION BY sheet) AS ny, {window} AS v FROM x), taps(d, t) AS (VALUES {rows}),
h AS MATERIALIZED (SELECT a.sheet, a.i, a.j, a.ny, sum(b.v * t) AS v FROM v a CROSS JOIN taps JOIN v b ON b.sheet = a.sheet AND b.i = a.i AND b.j = greatest(1, least({NX}, a.j + d)) GROUP BY ALL),
s AS (SELECT a.sheet, a.i, a.j, sum(b.v * t) AS v FROM h a CROSS JOIN taps JOIN h b ON b.sheet = a.sheet AND b.j = a.j AND b.i = greatest(1, least(a.ny, a.i + d)) GROUP BY ALL)
SELECT sheet, i, j, v > 0.17 AS artifact FROM s"""


@query("artifact_mask", _artifact_sql())
def artifact_mask(spark, sf_dir):
    lap = sheets(spark, sf_dir).withColumn("laplacian", F.col("z") / 1e6)
    return water.artifacts(lap, SHEET, 1.0).select("sheet", "i", "j", "artifact")


@query("smooth_laplacian", f"WITH {sql.EMB}, {_window_sql('emb', _SMOOTH, '(SELECT max(i) FROM emb)', 64, 'f')}, {sql.hessian('f')} SELECT (i - 1) // 3 + 1 AS i, (j - 1) // 3 + 1 AS j, h11 + h22 AS laplacian FROM hs WHERE (i - 1) % 3 = 0 AND (j - 1) % 3 = 0")
def smooth_laplacian(spark, sf_dir):
    cells = emb_cells(spark, sf_dir)
    out = raster.smooth_laplacian(cells, np.array(_SMOOTH), raster.extent(cells, (1, 64)), 3)
    return out.select("i", "j", F.col("laplacian").cast("long").alias("laplacian"))


@query("summit_marks", f"""WITH {_SUMMITS}, s AS (SELECT CAST(sheet AS INTEGER) AS sheet, id * 7 % {NY} + 1 AS i, id * 11 % {NX} + 1 AS j, prominence FROM su WHERE id % 4 = 0),
b AS (SELECT x.d AS di, y.d AS dj FROM range(-2, 3) x(d), range(-2, 3) y(d)), o(oi, oj) AS (VALUES (0, 0), (1, 1), (-1, 1)),
p AS (SELECT sheet, i + di AS i, j + dj AS j FROM s CROSS JOIN b WHERE prominence >= 200 UNION SELECT sheet, i + oi + di, j + oj + dj FROM s CROSS JOIN o CROSS JOIN b WHERE prominence >= 190 AND prominence < 200 AND greatest(abs(di), abs(dj)) = 1)
SELECT sheet, i, j FROM p WHERE i BETWEEN 1 AND {NY} AND j BETWEEN 1 AND {NX}""")
def summit_marks(spark, sf_dir):
    k = F.col("id")
    s = summit_rows(spark, sf_dir).where(k % 4 == 0).select(F.col("sheet").cast("int").alias("sheet"), (k * 7 % NY + 1).alias("i"), (k * 11 % NX + 1).alias("j"), "prominence")
    return marks.summit_marks(s, SHEET, (200.0, 190.0), ("in_square", "on_square"), (5, 3))


def _krueger_sql() -> str:
    """Customers' places of zone 33 in the zone in use there: the series back to degrees, then forward."""
    r, e0 = utm.SCALE * utm.RADIUS, utm.FALSE_EASTING
    series = lambda terms, f, g, x, y: " + ".join(f"{t!r} * {f}({2 * k} * {x}) * {g.format(f'({2 * k} * {y})')}" for k, t in enumerate(terms, 1))
    cosh, sinh = "((exp({0}) + exp(-{0})) / 2)", "((exp({0}) - exp(-{0})) / 2)"
    atanh = lambda x: f"(0.5 * ln((1 + ({x})) / (1 - ({x}))))"
    c = 2 * utm._N**0.5 / (1 + utm._N)
    far = "CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END"
    zone = f"CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 42 THEN {far} ELSE CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 END"
    on = lambda x: f"(({x} % 1000 + 1000) % 1000 <= 1 OR ({x} % 1000 + 1000) % 1000 >= 998)"
    return f"""WITH p AS (SELECT c_custkey AS id, (35000 + c_custkey * 37 % 9000 - {e0!r}) / {r!r} AS eta, (6900000 + c_custkey * 91 % 9000) / {r!r} AS xi FROM customer),
q AS (SELECT id, xi - ({series(utm._BACK, 'sin', cosh, 'xi', 'eta')}) AS x, eta - ({series(utm._BACK, 'cos', sinh, 'xi', 'eta')}) AS y FROM p),
s AS (SELECT id, asin(sin(x) / {cosh.format('y')}) AS chi, atan2({sinh.format('y')}, cos(x)) AS lam FROM q),
t AS (SELECT id, (chi + {" + ".join(f"{d!r} * sin({2 * k} * chi)" for k, d in enumerate(utm._LATITUDE, 1))}) * (180 / pi()) AS lat, lam * (180 / pi()) + 15 AS lon FROM s),
z AS (SELECT id, sin(lat * (pi() / 180)) AS s, (lon - ({zone} * 6 - 183)) * (pi() / 180) AS lam FROM t),
u AS (SELECT id, lam, {atanh('s')} - {c!r} * {atanh(f'{c!r} * s')} AS a FROM z),
v AS (SELECT id, lam, {sinh.format('a')} AS t FROM u),
w AS (SELECT id, atan2(t, cos(lam)) AS xi, {atanh('sin(lam) / sqrt(1 + t * t)')} AS eta FROM v),
g AS (SELECT id, CAST(round_even({e0!r} + {r!r} * (eta + {series(utm._FORWARD, 'cos', sinh, 'xi', 'eta')}), 0) AS BIGINT) AS e, CAST(round_even({r!r} * (xi + {series(utm._FORWARD, 'sin', cosh, 'xi', 'eta')}), 0) AS BIGINT) AS n FROM w)
SELECT id, {on('e')} OR {on('n')} AS line FROM g"""


@query("utm_grid_mask", _krueger_sql())
def utm_grid_mask(spark, sf_dir):
    k = F.col("c_custkey")
    cells = rasters.table(spark, sf_dir, "customer").select(k.alias("id"), (F.lit(35_000) + (k * 37) % 9000).alias("e"), (F.lit(6_900_000) + (k * 91) % 9000).alias("n"))
    return terrain.utm_grid(cells, 33).select("id", "line")


_LAID = "(({0} * a * 255 + {0}2 * 255 * (255 - a) + 32512) // 65025)"
_MULTIPLIED = "(({0}2 * (65025 - a * (255 - {0})) + 32512) // 65025)"


@query("composite_layers", f"WITH {sql.ORD}, c AS (SELECT i, j, z % 256 AS r, z // 3 % 256 AS g, z // 7 % 256 AS b, z // 11 % 256 AS a, z // 13 % 256 AS r2, z // 17 % 256 AS g2, z // 19 % 256 AS b2 FROM ord) SELECT i, j, " + ", ".join(f"CAST(CASE WHEN (i + j) % 5 = 1 THEN {_MULTIPLIED.format(k)} ELSE {_LAID.format(k)} END AS INTEGER) AS {k}" for k in "rgb") + " FROM c")
def composite_layers(spark, sf_dir):
    """Each cell has one of the five layers over the relief; the second one multiplies."""
    cells = _rgba_cells(spark, sf_dir).select(F.lit(1).alias("sheet"), "i", "j", "top", "below")
    layer = lambda k: cells.where((F.col("i") + F.col("j")) % 5 == k).select("sheet", "i", "j", F.col("top").alias("rgba"))
    out = terrain.composite(cells.select("sheet", "i", "j", F.col("below").alias("rgba")), {name: layer(k) for k, (name, _) in enumerate(terrain.LAYERS)})
    return out.select("i", "j", *[F.col(f"rgba.{k}").cast("int").alias(k) for k in "rgb"])


# -- graphs

_PROXY = "v AS (SELECT o_orderkey + 1 AS id, CAST(o_custkey % 3 AS DOUBLE) AS z FROM orders), ed AS (SELECT parent AS a, id AS b FROM tree WHERE id <> parent), op AS (SELECT id AS src, (id * 7) % (SELECT count(*) FROM tree) + 1 AS dst FROM tree)"


@query("destination_proxy", f"""WITH {sql.TREE}, {_PROXY}, same AS (SELECT d.id AS dst, p.id AS parent FROM v d JOIN ed ON ed.b = d.id JOIN v p ON p.id = ed.a AND p.z = d.z WHERE d.id NOT IN (SELECT a FROM ed))
SELECT DISTINCT src AS a, coalesce(parent, op.dst) AS b FROM op LEFT JOIN same USING (dst) WHERE src <> coalesce(parent, op.dst)""")
def destination_proxy(spark, sf_dir):
    t = tree(spark, sf_dir)
    v = rasters.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("id"), (F.col("o_custkey") % 3).cast("double").alias("z"))
    edges = t.where("id <> parent").select(F.col("parent").alias("a"), F.col("id").alias("b"))
    most = t.agg(F.count("*").alias("most"))
    pairs = t.crossJoin(F.broadcast(most)).select(F.col("id").alias("src"), ((F.col("id") * 7) % F.col("most") + 1).alias("dst"))
    return graphs.proxies(pairs, v, edges)


@query("acyclic", "SELECT 'tree' AS graph, true AS acyclic UNION ALL SELECT 'loop', max(o_orderkey) < 3 FROM orders")
def acyclic(spark, sf_dir):
    """The tree of orders, and that tree with an edge from a vertex to its grandparent."""
    edges = tree(spark, sf_dir).where("id <> parent").select(F.col("parent").alias("a"), F.col("id").alias("b"))
    back = edges.alias("x").join(edges.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("y.b").alias("a"), F.col("x.a").alias("b")).orderBy("a").limit(1)
    told = [("tree", graphs.is_acyclic(edges)), ("loop", graphs.is_acyclic(edges.union(back)))]
    return spark.createDataFrame(told, "graph string, acyclic boolean")


_DOWN = "CASE WHEN x.z < y.z THEN x.id ELSE y.id END AS a, CASE WHEN x.z < y.z THEN y.id ELSE x.id END AS b"
#: Vertices on sheet borders, joined in twos along each border; then what merging makes of them.
_MERGED = f"""{_SHEETED}, ed AS (SELECT {_DOWN} FROM v x JOIN v y ON x.e = y.e AND x.n = y.n + 3 AND (200 - x.n // 3) % 2 = 0 WHERE x.z <> y.z AND x.sheet = y.sheet),
tp AS (SELECT v.id, max(greatest(v.z, coalesce(u.z, v.z))) AS high, min(least(v.z, coalesce(u.z, v.z))) AS low FROM v LEFT JOIN ed ON ed.a = v.id LEFT JOIN v u ON u.id = ed.b GROUP BY v.id),
pr AS (SELECT x.id AS a, y.id AS b, x.z AS ra, y.z AS rb FROM v x JOIN v y ON ((y.e = x.e + 3 AND y.n = x.n) OR (y.e = x.e AND y.n = x.n + 3)) AND x.sheet <> y.sheet),
up AS (SELECT pr.*, CASE WHEN ra < rb THEN 1 WHEN ra > rb THEN -1 WHEN p.high < q.high THEN 1 WHEN p.high > q.high THEN -1 WHEN p.low < q.low THEN 1 WHEN p.low > q.low THEN -1 END AS up FROM pr JOIN tp p ON p.id = a JOIN tp q ON q.id = b),
al AS MATERIALIZED (SELECT a, b FROM ed UNION SELECT CASE WHEN up = 1 THEN a ELSE b END, CASE WHEN up = 1 THEN b ELSE a END FROM up WHERE up IS NOT NULL),
ends AS (SELECT a AS id FROM pr UNION SELECT b FROM pr),
keep AS (SELECT id FROM v WHERE (id NOT IN (SELECT b FROM al)) OR (id NOT IN (SELECT a FROM al) AND NOT (id IN (SELECT id FROM ends) AND (SELECT count(*) FROM al WHERE al.b = v.id) = 1)) UNION SELECT al.a FROM keep JOIN al ON al.b = keep.id)"""


@query("merge_sheets", f"WITH RECURSIVE {_MERGED} SELECT a, b FROM al WHERE a IN (SELECT id FROM keep) AND b IN (SELECT id FROM keep)")
def merge_sheets(spark, sf_dir):
    v = sheeted(spark, sf_dir)
    x, y = v.alias("x"), v.alias("y")
    twos = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.n") == F.col("y.n") + 3) & (F.col("x.sheet") == F.col("y.sheet"))).where((F.lit(200) - F.col("x.n") / 3) % 2 == 0).where("x.z <> y.z")
    rises = F.col("x.z") < F.col("y.z")
    edges = twos.select(F.when(rises, F.col("x.id")).otherwise(F.col("y.id")).alias("a"), F.when(rises, F.col("y.id")).otherwise(F.col("x.id")).alias("b"))
    return graphs.merge_sheets(v, edges, 3)[1].select("a", "b")


_LOW = f"""anc AS (SELECT id AS leaf, id AS pos FROM tree WHERE id NOT IN (SELECT a FROM ed) UNION ALL SELECT anc.leaf, ed.a FROM anc JOIN ed ON ed.b = anc.pos),
sub AS (SELECT pos, max(z) AS top FROM anc JOIN tree ON tree.id = anc.leaf GROUP BY pos),
pm AS (SELECT l.id, l.z - coalesce(max(v.z) FILTER (sub.top > l.z), 0) AS prominence FROM anc JOIN tree l ON l.id = anc.leaf JOIN tree v ON v.id = anc.pos JOIN sub ON sub.pos = anc.pos GROUP BY l.id, l.z),
keep AS (SELECT id FROM tree WHERE id % 97 = 0 OR id NOT IN (SELECT b FROM ed) OR id IN (SELECT id FROM pm WHERE prominence >= 60000) UNION SELECT ed.a FROM keep JOIN ed ON ed.b = keep.id)"""


@query("prune_low_prominence", f"WITH RECURSIVE {sql.TREE}, ed AS (SELECT parent AS a, id AS b FROM tree WHERE id <> parent), {_LOW} SELECT id FROM keep")
def prune_low_prominence(spark, sf_dir):
    return graphs.prune_low(*bordered(spark, sf_dir), 60_000.0)[0].select("id")


def bordered(spark, sf_dir):
    """The tree of orders with every 97th vertex on a border."""
    t = tree(spark, sf_dir)
    v = t.select("id", F.col("z").cast("double").alias("z"), (F.col("id") % 97 == 0).alias("border"))
    return v, t.where("id <> parent").select(F.col("parent").alias("a"), F.col("id").alias("b"))


@query("reduce_and_prune", f"""WITH RECURSIVE {sql.TREE}, ed AS (SELECT parent AS a, id AS b FROM tree WHERE id <> parent), {_LOW},
ke AS (SELECT a, b FROM ed WHERE a IN (SELECT id FROM keep) AND b IN (SELECT id FROM keep)),
inn AS (SELECT b AS id FROM ke WHERE b IN (SELECT a FROM ke GROUP BY a HAVING count(*) = 1) AND b % 97 > 0 AND a % 97 > 0 AND b NOT IN (SELECT a FROM ke WHERE b % 97 = 0))
SELECT id FROM keep WHERE id NOT IN (SELECT id FROM inn)""")
def reduce_and_prune(spark, sf_dir):
    return graphs.reduce_and_prune(*bordered(spark, sf_dir), 60_000.0)[0].select("id")


# -- boxes


@query("grown_box", f"WITH {SHL} SELECT sheet, min_x - CASE WHEN col > 1 THEN 0 ELSE 1 END AS min_x, min_y - CASE WHEN row > 1 THEN 0 ELSE 1 END AS min_y, max_x + CASE WHEN col < 5 THEN 0 ELSE 1 END AS max_x, max_y + CASE WHEN row < 4 THEN 0 ELSE 1 END AS max_y FROM sh")
def grown_box(spark, sf_dir):
    return LARGE.sheets(spark).select("sheet", *geometry.grown_box(geometry.border_sides(F.col("row"), F.col("col"), LARGE)))


@query("on_border", f"WITH {_BOXES}, p AS (SELECT *, min_x + source % 3 * 10 AS e, max_y - source % 2 AS n FROM boxes) SELECT source, e = min_x OR e = max_x OR n = min_y OR n = max_y AS border FROM p")
def on_border(spark, sf_dir):
    k = F.col("source")
    p = boxes(spark, sf_dir).withColumns({"e": F.col("min_x") + k % 3 * 10, "n": F.col("max_y") - k % 2})
    return p.select("source", geometry.on_border(F.col("e"), F.col("n")).alias("border"))


@query("sources_of_sheet", f"WITH {SHL}, {_BOXES} SELECT sheet, list(source ORDER BY source) AS sources FROM sh JOIN boxes b ON b.min_x < sh.max_x AND b.max_x > sh.min_x AND b.min_y < sh.max_y AND b.max_y > sh.min_y GROUP BY sheet")
def sources_of_sheet(spark, sf_dir):
    """The source files that a sheet is made from, as listed for people."""
    pairs = geometry.overlap_join(LARGE.sheets(spark).drop("folder"), boxes(spark, sf_dir), 250)
    return pairs.groupBy("a.sheet").agg(F.array_sort(F.collect_list("b.source")).alias("sources"))


@query("spec_report", f"""WITH {SHL}, a AS (SELECT max(row) AS r, max(col) AS c, min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM sh)
SELECT 'sheets' AS name, r || ' x ' || c AS value FROM a UNION ALL SELECT 'cells a sheet', '{LARGE.nx} x {LARGE.ny}' UNION ALL SELECT 'extent', '(' || x0 || ' ' || y0 || ')-(' || x1 || ' ' || y1 || ')' FROM a
UNION ALL SELECT 'area', CASE WHEN (x1 - x0) * (y1 - y0) > 3000000 THEN printf('%.1f km2', (x1 - x0) * (y1 - y0) / 1e6) ELSE (x1 - x0) * (y1 - y0) || ' m2' END FROM a
UNION ALL SELECT 'scale', '1 : ' || {LARGE.cell2utm} * {LARGE.density} UNION ALL SELECT 'paper mm', CAST(round((x1 - x0) * 1000.0 / {LARGE.cell2utm * LARGE.density}, 0) AS INTEGER) || ' x ' || CAST(round((y1 - y0) * 1000.0 / {LARGE.cell2utm * LARGE.density}, 0) AS INTEGER) FROM a
UNION ALL SELECT 'centre', printf('%.1f', (x0 + x1) / 2) || ' ' || printf('%.1f', (y0 + y1) / 2) FROM a""")
def spec_report(spark, sf_dir):
    return LARGE.describe(spark)


# -- files and images


def sheet_files(spark, sf_dir):
    """orders as GeoTIFF files of sheets, a metre a cell; every seventh elevation is none."""
    cells = sheets(spark, sf_dir).withColumn("z", F.when(F.col("z") % 7 == 0, 0).otherwise(F.col("z")))
    return geotiff.encoded(cells, F.lit(44000) + F.col("sheet") * NX, F.lit(6910000) - F.col("sheet") * NY)


_FILES = f"{sql.ORD}, {CELLS}, fc AS (SELECT sheet, i, j, CASE WHEN z % 7 = 0 THEN 0 ELSE z END AS z, 44000 + sheet * {NX} AS west, 6910000 - sheet * {NY} AS north FROM cells)"


@query("geotiff_cells", f"WITH {_FILES} SELECT sheet || '.tif' AS path, i, j, CAST(west + j - 1 AS DOUBLE) AS e, CAST(north - i + 1 AS DOUBLE) AS n, CAST(z AS DOUBLE) AS z FROM fc")
def geotiff_cells(spark, sf_dir):
    return geotiff.cells(sheet_files(spark, sf_dir)).withColumn("z", F.col("z").cast("double"))


@query("raster_catalog", f"WITH {_FILES} SELECT sheet || '.tif' AS path, min(west) AS full_min_x, min(north) - max(i) AS full_min_y, min(west) + max(j) AS full_max_x, min(north) AS full_max_y, min(west + j - 1) FILTER (z <> 0) AS min_x, min(north - i) FILTER (z <> 0) AS min_y, max(west + j) FILTER (z <> 0) AS max_x, max(north - i + 1) FILTER (z <> 0) AS max_y FROM fc GROUP BY sheet")
def raster_catalog(spark, sf_dir):
    found = sheet_files(spark, sf_dir).withColumn("modificationTime", F.lit("2020-01-01").cast("timestamp"))
    return geotiff.refreshed(geotiff.catalog(found.where("path = '1.tif'")), found).drop("modificationTime")


_PART = ", ".join(f"CAST(z // {k} % 256 AS INTEGER) AS {n}" for k, n in ((1, "r"), (3, "g"), (7, "b"), (11, "a")))


@query("png_pixels", f"WITH {sql.ORD}, {CELLS}, g AS (SELECT * FROM range(1, (SELECT max(sheet) FROM cells) + 1) s(sheet), range(1, {NY + 1}) x(i), range(1, {NX + 1}) y(j)) SELECT CAST(g.sheet AS INTEGER) AS sheet, g.i, g.j, coalesce(r, 0) AS r, coalesce(g_, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a, 11811 AS density FROM g LEFT JOIN (SELECT sheet, i, j, r, g AS g_, b, a FROM (SELECT sheet, i, j, {_PART} FROM cells)) c ON c.sheet = g.sheet AND c.i = g.i AND c.j = g.j")
def png_pixels(spark, sf_dir):
    part = [(F.floor(F.col("z") / k) % 256).cast("int").alias(n) for k, n in ((1, "r"), (3, "g"), (7, "b"), (11, "a"))]
    cells = sheets(spark, sf_dir).select("sheet", "i", "j", F.struct(*part).alias("rgba"))
    return png.pixels(png.sheet_images(cells, SHEET)).select("sheet", "i", "j", "rgba.*", "density")


# -- archives, lists of files, consolidated sheets


@query("unzip_names", """WITH m AS (SELECT DISTINCT 'r' || s_suppkey % 7 AS stem, sha256('content ' || s_suppkey % 3) AS sha FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY sha) AS k FROM m)
SELECT CASE WHEN k = 1 THEN stem || '.tif' ELSE stem || ' (' || (k - 1) || ').tif' END AS name, sha FROM k""")
def unzip_names(spark, sf_dir):
    """Suppliers as rasters in ten archives, many of one name, some of equal content."""
    k = F.col("s_suppkey")
    one = F.concat(F.lit("content "), (k % 3).cast("string")).cast("binary")
    members = rasters.table(spark, sf_dir, "supplier").select(F.concat((k % 10).cast("string"), F.lit(".zip")).alias("path"), F.concat(k.cast("string"), F.lit("/r"), (k % 7).cast("string"), F.lit(".tif")).alias("name"), one.alias("content"))
    return geotiff.unzipped(geotiff.zipped(members)).select("name", "sha")


@query("raster_candidates", "SELECT 'in/' || c_custkey % 9 || '/' || c_name || '.tif' AS path, c_name || '.tif' AS name FROM customer WHERE c_custkey % 11 > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def raster_candidates(spark, sf_dir):
    """Customers as files, those with urgent orders there already; every eleventh is a sheet's own."""
    k = F.col("c_custkey")
    c = rasters.table(spark, sf_dir, "customer")
    file = F.concat("c_name", F.lit(".tif"))
    found = c.select(F.concat(F.lit("in/"), (k % 9).cast("string"), F.lit("/"), F.when(k % 11 == 0, geotiff.RESERVED).otherwise(file)).alias("path"))
    urgent = rasters.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return geotiff.candidates(found, c.join(urgent, "c_custkey", "left_semi").select(file.alias("name")))


@query("consolidate_sheets", """WITH s AS (SELECT l_partkey // 250 + 1 AS sheet, l_partkey % 250 + 1 AS i, l_suppkey + 1 AS j, CAST(round_even(l_extendedprice * 100 / 50, 0) AS BIGINT) AS z, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_shipdate DESC, l_quantity DESC) AS r FROM lineitem WHERE l_suppkey < 20),
g AS (SELECT CAST(sheet AS INTEGER) AS sheet, i, j FROM (SELECT DISTINCT l_partkey // 250 + 1 AS sheet FROM lineitem), range(1, 251) x(i), range(1, 21) y(j))
SELECT g.sheet, g.i, g.j, coalesce(z, 0) AS z FROM g LEFT JOIN (SELECT * FROM s WHERE r = 1) s ON g.sheet = s.sheet AND g.i = s.i AND g.j = s.j""")
def consolidate_sheets(spark, sf_dir):
    part = F.col("i") - 1
    cells = rasters.sparse_cells(spark, sf_dir).withColumns({"sheet": (F.floor(part / 250) + 1).cast("int"), "i": part % 250 + 1})
    return raster.consolidate(cells, (250, 20), cells.select("sheet").distinct())
