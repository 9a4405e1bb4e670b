"""Queries of segments, water, component trees, elevation graphs, summits and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, raster, segments, summits, water
from ..sources import rasters, svg
from . import sql
from .registry import query

#: Rows and columns of the sheets that queries cut a table's raster into.
SHEET = (60, 125)


def sheets(spark, sf_dir):
    return rasters.orders_sheets(spark, sf_dir, SHEET[0])


@query("felzenszwalb")
def felzenszwalb(spark, sf_dir):
    return segments.merged_regions(sheets(spark, sf_dir), SHEET, 300.0, 5).groupBy("sheet", "label").agg(F.count("*").alias("n"))


@query("forest_mask")
def forest_mask(spark, sf_dir):
    from ..operators.forest import forest_mask as mask

    cells = sheets(spark, sf_dir).withColumn("z", F.col("z") / 100.0)
    return mask(cells, SHEET, 2, 60, 15).select("sheet", "i", "j", "forest")


@query("water_segments")
def water_segments(spark, sf_dir):
    from ..config import Settings

    cells = sheets(spark, sf_dir).withColumn("z", F.greatest(F.col("z") / 100.0 - 4, F.lit(0.0)))
    return water.water_segments(cells, SHEET, Settings(water_least_area_m2=90)).select("sheet", "i", "j", "water")


@query("component_tree")
def component_tree(spark, sf_dir):
    return segments.component_tree(sheets(spark, sf_dir), SHEET).select("sheet", "id", "parent")


# -- trees and graphs


def tree(spark, sf_dir):
    k = F.col("o_orderkey")
    return rasters.table(spark, sf_dir, "orders").select(F.lit(1).alias("sheet"), (k + 1).alias("id"), (F.floor(k / 3) + 1).cast("long").alias("parent"), (10 * k + F.col("o_custkey") % 10).cast("long").alias("z"))


def vertices_edges(spark, sf_dir):
    t = tree(spark, sf_dir)
    return t.select("id", F.col("z").cast("double").alias("z")), t.where("id <> parent").select(F.col("parent").alias("a"), F.col("id").alias("b"))


_EDGES = f"{sql.TREE}, ed AS (SELECT parent AS a, id AS b FROM tree WHERE id <> parent)"


@query("tree_leaves", f"WITH {sql.TREE} SELECT id FROM tree WHERE id NOT IN (SELECT parent FROM tree)")
def tree_leaves(spark, sf_dir):
    return summits.leaf_cells(tree(spark, sf_dir)).select("id")


@query("tree_leaf_parents", f"WITH {sql.TREE} SELECT DISTINCT parent FROM tree WHERE id NOT IN (SELECT parent FROM tree)")
def tree_leaf_parents(spark, sf_dir):
    return summits.leaf_parents(tree(spark, sf_dir)).select("parent")


_FAMILY = "fam AS (SELECT parent FROM tree WHERE id <> parent GROUP BY parent HAVING count(*) FILTER (id IN (SELECT parent FROM tree WHERE id <> parent)) = 0)"


@query("core_families", f"WITH {sql.TREE}, {_FAMILY} SELECT parent, count(*) AS n, min(id) AS first, max(id) AS last FROM tree JOIN fam USING (parent) WHERE id <> parent GROUP BY parent")
def core_families(spark, sf_dir):
    f = summits.core_families(tree(spark, sf_dir))
    return f.select("parent", F.size("children").cast("long").alias("n"), F.array_min("children").alias("first"), F.array_max("children").alias("last"))


@query("distinct_summits", f"WITH {sql.TREE}, {_FAMILY}, k AS (SELECT parent, id, z, row_number() OVER (PARTITION BY parent ORDER BY z DESC, id) AS r FROM tree JOIN fam USING (parent) WHERE id <> parent) SELECT CASE WHEN k.z > p.z THEN k.id ELSE k.parent END AS id FROM k JOIN tree p ON p.id = k.parent WHERE r = 1")
def distinct_summits(spark, sf_dir):
    t = tree(spark, sf_dir)
    return summits.distinct_summits(t, t).select("id")


@query("border_cells", f"WITH {sql.ORD} SELECT i, j FROM ord WHERE i = 1 AND j BETWEEN 2 AND 124 UNION ALL SELECT i, j FROM ord WHERE j = 125 AND i BETWEEN 2 AND 119")
def border_cells(spark, sf_dir):
    cells = rasters.orders_raster(spark, sf_dir)
    return summits.border_cells(cells, raster.extent(cells, (120, 125)), ["n", "e"]).select("i", "j")


_SUMMITS = "su AS (SELECT o_orderkey AS id, o_orderkey % 20 + 1 AS sheet, 44000 + o_orderkey % 977 AS e, 6909000 + o_orderkey // 977 AS n, CAST(round_even(o_totalprice / 250, 0) AS DOUBLE) AS z, CAST(o_custkey % 211 AS DOUBLE) AS prominence FROM orders)"


def summit_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    return rasters.table(spark, sf_dir, "orders").select(k.alias("id"), (k % 20 + 1).alias("sheet"), (F.lit(44000) + k % 977).alias("e"), (F.lit(6909000) + F.floor(k / 977)).alias("n"), F.rint(F.col("o_totalprice") / 250).alias("z"), (F.col("o_custkey") % 211).cast("double").alias("prominence"))


@query("summit_sort", f"WITH {_SUMMITS} SELECT id, row_number() OVER (ORDER BY z + CASE WHEN prominence > 100 THEN 10000 ELSE 0 END DESC, e, n) AS place FROM su WHERE prominence >= 200")
def summit_sort(spark, sf_dir):
    s = summit_rows(spark, sf_dir).where("prominence >= 200").withColumn("all", F.lit(1))
    out = graphs.ranked(s, "all", [summits.order_key(F.col("z"), F.col("prominence")).desc(), F.col("e"), F.col("n")])
    return out.select("id", F.col("rank").cast("long").alias("place"))


@query("summit_semi_join", f"WITH {_SUMMITS} SELECT id FROM su WHERE (e, n) IN (SELECT e, n FROM su WHERE z > 900) AND e BETWEEN 44100 AND 44800 AND n BETWEEN 6909000 AND 6909100")
def summit_semi_join(spark, sf_dir):
    s = summit_rows(spark, sf_dir)
    return summits.matched_leaves(s, s.where("z > 900"), (44100, 6909000, 44800, 6909100)).select("id")


@query("stress_lookup", f"WITH {_SUMMITS}, st AS (SELECT e, n, arg_max(z / 8, id) AS stress FROM su WHERE id % 3 = 0 GROUP BY e, n) SELECT id, coalesce(stress, -1) AS stress, CASE WHEN z > 1000 THEN 'peak ' || id ELSE e || ',' || n END AS name FROM su LEFT JOIN st USING (e, n)")
def stress_lookup(spark, sf_dir):
    s = summit_rows(spark, sf_dir)
    cand = s.where("id % 3 = 0").select("e", "n", (F.col("z") / 8).alias("stress"), F.col("id").alias("written"))
    names = s.select("e", "n", F.when(F.col("z") > 1000, F.concat(F.lit("peak "), F.col("id"))).otherwise("").alias("name"))
    out = summits.with_stress(s, cand, names)
    return out.select("id", F.when(F.isnan("stress"), -1.0).otherwise(F.col("stress")).alias("stress"), "name")


@query("summits_by_sheet", f"WITH {_SUMMITS} SELECT sheet, id, row_number() OVER (PARTITION BY sheet ORDER BY z + CASE WHEN prominence > 100 THEN 10000 ELSE 0 END DESC, e, n) AS rank FROM su WHERE prominence >= 50 AND id % 3 = 0")
def summits_by_sheet(spark, sf_dir):
    s = summit_rows(spark, sf_dir).withColumn("stress", F.when(F.col("id") % 3 == 0, F.lit(-1.0)).otherwise(F.lit(float("nan"))))
    return summits.regional(s).select("sheet", "id", F.col("rank").cast("long").alias("rank"))


@query("lineage_closure", f"WITH RECURSIVE {_EDGES}, up AS (SELECT id FROM tree WHERE z % 500 = 0 UNION SELECT a FROM up JOIN ed ON ed.b = up.id), down AS (SELECT id FROM tree WHERE z % 500 = 0 UNION SELECT b FROM down JOIN ed ON ed.a = down.id) SELECT id FROM up UNION SELECT id FROM down")
def lineage_closure(spark, sf_dir):
    t = tree(spark, sf_dir)
    return graphs.lineage(t.where("z % 500 = 0").select("id"), t)


@query("graph_leaves_roots", f"WITH {_EDGES} SELECT id, 'leaf' AS kind FROM tree WHERE id NOT IN (SELECT a FROM ed) UNION ALL SELECT id, 'root' FROM tree WHERE id NOT IN (SELECT b FROM ed)")
def graph_leaves_roots(spark, sf_dir):
    v, e = vertices_edges(spark, sf_dir)
    return graphs.leaves(v, e).select("id", F.lit("leaf").alias("kind")).union(graphs.roots(v, e).select("id", F.lit("root")))


@query("isolated_vertices", f"WITH {_EDGES} SELECT id FROM tree WHERE id IN (SELECT a FROM ed WHERE b % 2 = 0) OR id IN (SELECT b FROM ed WHERE b % 2 = 0)")
def isolated_vertices(spark, sf_dir):
    v, e = vertices_edges(spark, sf_dir)
    return graphs.without_isolated(v, e.where("b % 2 = 0")).select("id")


_CHAIN = "ch AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders WHERE o_orderkey % 7 < 6 AND o_orderkey < (SELECT max(o_orderkey) FROM orders) UNION ALL SELECT o_orderkey, o_orderkey + 5 FROM orders WHERE o_orderkey % 70 = 0 AND o_orderkey + 5 <= (SELECT max(o_orderkey) FROM orders))"


@query("chain_reduce", f"""WITH RECURSIVE {_CHAIN}, dg AS (SELECT id FROM (SELECT a AS id, 0 AS i, 1 AS o FROM ch UNION ALL SELECT b, 1, 0 FROM ch) GROUP BY id HAVING sum(i) = 1 AND sum(o) = 1),
inn AS (SELECT id FROM dg WHERE id % 21 <> 3 AND id NOT IN (SELECT b FROM ch WHERE a % 21 = 3) AND id NOT IN (SELECT a FROM ch WHERE b % 21 = 3)),
w AS (SELECT a, b FROM ch WHERE a NOT IN (SELECT id FROM inn) UNION ALL SELECT w.a, ch.b FROM w JOIN inn ON w.b = inn.id JOIN ch ON ch.a = w.b) SELECT DISTINCT a, b FROM w WHERE b NOT IN (SELECT id FROM inn)""")
def chain_reduce(spark, sf_dir):
    k = F.col("o_orderkey")
    o = rasters.table(spark, sf_dir, "orders").select("o_orderkey")
    most = o.agg(F.max("o_orderkey").alias("most"))
    all_ = o.crossJoin(F.broadcast(most))
    e = all_.where("o_orderkey % 7 < 6 and o_orderkey < most").select(k.alias("a"), (k + 1).alias("b")).union(all_.where("o_orderkey % 70 = 0 and o_orderkey + 5 <= most").select(k, k + 5))
    v = o.select(k.alias("id"), (k % 21 == 3).alias("border"))
    return graphs.chain_reduce(v, e)[1]


@query("prominence", f"""WITH RECURSIVE {_EDGES}, anc AS (SELECT id AS leaf, id AS pos FROM tree WHERE id NOT IN (SELECT a FROM ed) UNION ALL SELECT anc.leaf, ed.a FROM anc JOIN ed ON ed.b = anc.pos),
sub AS (SELECT pos, max(z) AS top FROM anc JOIN tree ON tree.id = anc.leaf GROUP BY pos)
SELECT l.id, CAST(l.z AS DOUBLE) AS z, CAST(l.z - coalesce(max(v.z) FILTER (sub.top > l.z), 0) AS DOUBLE) AS prominence FROM anc JOIN tree l ON l.id = anc.leaf JOIN tree v ON v.id = anc.pos JOIN sub ON sub.pos = anc.pos GROUP BY l.id, l.z""")
def prominence(spark, sf_dir):
    v, e = vertices_edges(spark, sf_dir)
    return graphs.prominence(v, e).select("id", "z", "prominence")


_SHEETED = f"{sql.ORD}, v AS (SELECT i * 1000 + j AS id, (j - 1) // 25 + 1 AS sheet, j * 3 AS e, (200 - i) * 3 AS n, z FROM ord WHERE j % 25 IN (0, 1))"


def sheeted(spark, sf_dir):
    c = rasters.orders_raster(spark, sf_dir).where("j % 25 in (0, 1)")
    return c.select((F.col("i") * 1000 + F.col("j")).alias("id"), (F.floor((F.col("j") - 1) / 25) + 1).alias("sheet"), (F.col("j") * 3).alias("e"), ((F.lit(200) - F.col("i")) * 3).alias("n"), "z")


_PAIRS = "SELECT x.id AS a, y.id AS b, x.z AS za, y.z AS zb FROM v x JOIN v y ON ((y.e = x.e + 3 AND y.n = x.n) OR (y.e = x.e AND y.n = x.n + 3)) AND x.sheet <> y.sheet"


@query("border_pairs", f"WITH {_SHEETED} {_PAIRS}")
def border_pairs(spark, sf_dir):
    return graphs.border_pairs(sheeted(spark, sf_dir), 3)


@query("orient_pairs", f"WITH {_SHEETED}, p AS (SELECT a, b, za // 1000 AS ra, zb // 1000 AS rb, za % 7 AS ha, zb % 7 AS hb, za % 5 AS la, zb % 5 AS lb FROM ({_PAIRS})), u AS (SELECT *, CASE WHEN ra < rb THEN 1 WHEN ra > rb THEN -1 WHEN ha < hb THEN 1 WHEN ha > hb THEN -1 WHEN la < lb THEN 1 WHEN la > lb THEN -1 END AS up FROM p) SELECT CASE WHEN up = 1 THEN a ELSE b END AS src, CASE WHEN up = 1 THEN b ELSE a END AS dst FROM u WHERE up IS NOT NULL")
def orient_pairs(spark, sf_dir):
    v = sheeted(spark, sf_dir)
    pairs = graphs.border_pairs(v, 3).withColumns({"za": F.floor(F.col("za") / 1000), "zb": F.floor(F.col("zb") / 1000)})
    return graphs.oriented(pairs, v.select("id", (F.col("z") % 7).alias("top")), v.select("id", (F.col("z") % 5).alias("top")))


# -- labels


@query("label_rows", f"WITH {_SUMMITS} SELECT 'P' || id AS name, CAST(z AS BIGINT) || ' m (' || CAST(prominence AS BIGINT) || ' m)' AS second, CASE WHEN e - 44000 > 0.85 * 977 THEN 'end' ELSE 'start' END AS anchor FROM su WHERE prominence >= 200")
def label_rows(spark, sf_dir):
    s = summit_rows(spark, sf_dir).where("prominence >= 200").select(F.concat(F.lit("P"), F.col("id")).alias("name"), "z", "prominence", F.lit(1).alias("i"), (F.col("e") - 44000).alias("j"))
    return svg.summit_labels(s, 977).select("name", "second", "anchor")


@query("lake_label_rows", f"WITH {_SUMMITS} SELECT CAST(z AS BIGINT) || ' m' AS text FROM su WHERE z > 1 AND prominence < 10")
def lake_label_rows(spark, sf_dir):
    s = summit_rows(spark, sf_dir).where("prominence < 10").select(F.col("z").cast("long").alias("elevation_m"), F.lit(1).alias("i"), F.lit(1).alias("j"))
    return svg.lake_labels(s).select("text")


@query("tspan_split", "SELECT p_partkey AS id, p_name AS before, CAST(p_size AS VARCHAR) AS inner, ' ' || p_brand AS after FROM part")
def tspan_split(spark, sf_dir):
    p = rasters.table(spark, sf_dir, "part")
    text = F.concat("p_name", F.lit("("), "p_size", F.lit(") "), "p_brand")
    return p.select(F.col("p_partkey").alias("id"), svg.parts(text).alias("x")).select("id", "x.before", "x.inner", "x.after")
