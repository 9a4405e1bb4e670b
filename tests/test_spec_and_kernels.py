import numpy as np
import pytest
from pyspark.sql import functions as F

from orofold.config import Settings, parse_pair
from orofold.functions import geometry as g
from orofold.functions import palette, taps, utm
from orofold.operators import kernels, marks, segments, summits, terrain
from orofold.spec import MapSpec

SMALL = MapSpec(44000, 6909047, 2, 3, 2, 3, 4, 1000, "nopath")


def test_sheets_are_numbered_northwards_from_the_south_west():
    assert [(s["row"], s["col"], s["opx"], s["opy"]) for s in SMALL] == [(1, 1, 0, 4), (2, 1, 0, 0), (1, 2, 3, 4), (2, 2, 3, 0), (1, 3, 6, 4), (2, 3, 6, 0)]
    assert SMALL.sheet(6)["folder"].endswith("2-3__44012-6909055__44018-6909063")
    assert SMALL.internal_bbox == (44000, 6909049, 44016, 6909063) and SMALL.centre == (44009, 6909055)
    with pytest.raises(IndexError):
        SMALL.sheet(7)


@pytest.mark.parametrize("bad", [{"cell2utm": 0}, {"sheet_width_mm": -1}, {"density": -5}, {"path": ""}])
def test_spec_refuses(bad):
    with pytest.raises(ValueError):
        MapSpec(**{"sw_e": 1, "sw_n": 2, "nrows": 1, "ncols": 1} | bad)


def test_spec_refuses_fractions():
    with pytest.raises(TypeError):
        MapSpec(1.5, 2, 1, 1)


def test_points_to_sheets_and_cells(spark):
    e, n = SMALL.sw_e, SMALL.sw_n
    rows = [(0, e, n), (1, e, n + 1), (2, e, n + 8), (3, e, n + 9), (4, e, n + 16), (5, e + 18, n + 16), (6, e - 1, n + 1), (7, e + 6, n + 8), (8, e, n + 2)]
    df = spark.createDataFrame(rows, "k int, e long, n long")
    row, col = g.sheet_index(F.col("e"), F.col("n"), SMALL)
    i, j = g.cell_index(F.col("e"), F.col("n"), SMALL)
    got = {r.k: r for r in df.select("k", row.alias("row"), col.alias("col"), i.alias("i"), j.alias("j")).collect()}
    assert [got[k].row for k in range(7)] == [None, 1, 1, 2, 2, None, None]
    assert (got[0].i, got[0].j) == (1, 1) and (got[7].i, got[7].j) == (1, 1) and got[1].i == got[8].i == 4
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        df.select(g.strict(row)).collect()


def test_wkt_and_text(spark):
    third = SMALL.sheets(spark).where("sheet = 3").select(g.box_wkt().alias("w")).first()[0]
    assert third == "((44006 6909047, 44012 6909047, 44012 6909055, 44006 6909055, 44006 6909047))"
    assert SMALL.sheets(spark).where("sheet = 1").select(g.bbox_text(2)).first()[0] == "(44000 6909049)-(44004 6909055)"
    assert g.unit_offset("n") == (-1, 0)
    with pytest.raises(ValueError):
        g.unit_offset("up")


def test_boxes_that_share_an_edge_do_not_overlap(spark):
    b = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 10, 0, 20, 10), (3, 5, 5, 15, 15), (4, 3, 3, 3, 9)], "id int, min_x long, min_y long, max_x long, max_y long")
    pairs = {(r.a.id, r.b.id) for r in g.overlap_join(b, b, 7).collect()}
    assert pairs == {(1, 1), (2, 2), (3, 3), (1, 3), (3, 1), (2, 3), (3, 2)}


# rows | side 3, 9, 99 | corner
COUNTS = {"on_square": (8, 32, 392), "on_circle": (9, 32, 312), "on_triangle": (6, 23, 301), "on_hline": (3, 9, 99), "on_cross": (5, 17, 197), "on_xcross": (5, 17, 197), "in_triangle": (4, 25, 3110), "in_circle": (9, 69, 7705), "in_square": (9, 81, 9801)}


@pytest.mark.parametrize("shape", COUNTS)
def test_shapes(shape):
    assert tuple(len(marks.offsets(shape, s)) for s in (3, 9, 99)) == COUNTS[shape]


TREES = [
    ("1 1 1; 1 2 1; 1 1 1", {1}, {5}),
    ("1 1 1; 1 2 2.2; 1 2.1 1", {1, 5}, {8}),
    ("21 19 19 16; 22 22 23 22; 22 23 23 21; 22 22 22 16", {1, 2, 5, 7, 13}, {7}),
    ("1 1 1 2.2; 1 2 1.2 3; 1 2.1 1 1", {1, 5, 10}, {6, 11}),
    ("0 1 0 -3 -8; 1 2 1 2.5 -7; 0 2.1 0 10 -8; -3 -2 -3 -6 -11", None, {7, 15}),
    ("0 1 0 -3 -8; 1 2 1 -2 -7; 0 1 0 4 3; -3 -2 -3 -6 -11", None, {6, 15}),
]


@pytest.mark.parametrize("text, parents, found", TREES)
def test_component_trees(spark, text, parents, found):
    z = np.array([[float(x) for x in row.split()] for row in text.split(";")])
    tree = kernels.component_tree(np.rint(z))
    if parents:
        assert set(tree.tolist()) == parents
    t = spark.createDataFrame([(1, k + 1, int(p)) for k, p in enumerate(tree)], "sheet int, id long, parent long")
    cells = spark.createDataFrame([(1, k + 1, float(v)) for k, v in enumerate(z.T.ravel())], "sheet int, id long, z double")
    assert {r.id for r in summits.distinct_summits(t, cells).collect()} == found


def test_labels_match_flood_fill():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 2, (17, 23)).astype(float)
    got = kernels.connected(v)
    for (i, j), label in np.ndenumerate(got):
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < 17 and b < 23 and v[a, b] == v[i, j]:
                assert got[a, b] == label
    assert all((got == k).ravel(order="F").argmax() + 1 == k for k in np.unique(got))


def test_thinning_keeps_a_line_and_thins_a_block():
    line = np.zeros((7, 9), bool)
    line[3, 1:8] = True
    assert (kernels.thin(line) == line).all()
    block = np.zeros((9, 30), bool)
    block[3:6, 3:27] = True
    thin = kernels.thin(block)
    assert 10 < thin.sum() < 30 and not (thin & ~block).any()


def test_regions_split_at_steps():
    z = np.zeros((10, 10))
    z[:, 5:] = 100
    labels = kernels.merge_regions(z, 1.0, 2)
    assert len(np.unique(labels)) == 2 and labels[0, 0] != labels[0, 9]


def test_prominence_of_two_peaks():
    z = np.ones((5, 9))
    z[2, 2], z[2, 4], z[2, 6] = 9, 3, 6
    z[2, 3] = z[2, 5] = 3
    got = kernels.prominence(z)
    assert got[3 + 2 * 5] == 9 and got[3 + 6 * 5] == 3


def test_taps():
    assert abs(sum(taps.fir_lowpass(101)) - 1) < 1e-12
    assert len(taps.gaussian(5)) == 21
    with pytest.raises(ValueError):
        taps.lowpass(10, 3)
    with pytest.raises(ValueError):
        taps.lowpass(11, 1)


def test_palette_and_shade(spark):
    assert palette.colour(10, 2) == pytest.approx((0.35775903, 0.38666666, 0.30674836), abs=1e-6)
    with pytest.raises(ValueError):
        palette.linterp(0, 1, 2, 2, 2)
    df = spark.createDataFrame([(float(z),) for z in range(375, 525, 25)], "z double")
    assert [round(r[0], 6) for r in df.select(terrain.shade_exponent(F.col("z"), 1)).collect()] == [1.2, 1.2, 1.0, 0.8, 0.6, 0.4]
    w = spark.createDataFrame([(0.1,), (1.0,), (0.1**0.5,)], "x double").select(terrain.tanh_window(F.col("x"), 0.1, 1.0)).collect()
    assert [round(r[0], 9) for r in w] == [0.824027137, 0.824027137, 1.0]


def test_normals_of_a_slope(spark):
    cells = spark.createDataFrame([(1, i, j, float(-i)) for i in range(1, 6) for j in range(1, 6)], "sheet int, i long, j long, z double")
    r = terrain.normals(cells).where("i = 3 and j = 3").first()
    assert (r.n_east, r.n_north, r.n_up) == pytest.approx((0, -(0.5**0.5), 0.5**0.5))


def test_utm_round_trip(spark):
    df = spark.createDataFrame([(1, 500000.0, 6900000.0), (2, 35425.0, 6920995.0)], "k int, e double, n double")
    there = utm.between_zones(df, "e", "n", 33, 32)
    back = {r.k: (r.e, r.n) for r in utm.between_zones(there, "e", "n", 32, 33).collect()}
    assert back[1] == pytest.approx((500000, 6900000), abs=5e-3) and back[2] == pytest.approx((35425, 6920995), abs=1e-2)
    geo = utm.from_utm(df.where("k = 1"), "e", "n", F.lit(33)).first()
    assert geo.lon == pytest.approx(15) and 62 < geo.lat < 63
    zones = spark.createDataFrame([(60.0, 5.0), (60.0, 15.0), (78.0, 10.0), (50.0, 7.0)], "lat double, lon double").select(utm.zone_of(F.col("lat"), F.col("lon"))).collect()
    assert [z[0] for z in zones] == [32, 33, 33, 32]


def test_settings(tmp_path):
    assert parse_pair("(3, -4)") == (3, -4) and parse_pair("x") is None
    f = tmp_path / "a.ini"
    Settings.write_defaults(f)
    assert Settings(f).get("map", "sheets") == (3, 4) and Settings(f).get("water", "flux") == -0.328
    assert Settings(f, map_cell2utm=2).get("map", "cell2utm") == 2
    with pytest.raises(TypeError):
        Settings(f, map_cell2utm="2").get("map", "cell2utm")
    assert Settings.delete(f) and not Settings.delete(f)


def test_prune_small_joins_the_highest_neighbour(spark):
    v = [[0, 0, 0, 5, 5], [0, 0, 1, 5, 5], [0, 0, 0, 5, 5]]
    cells = spark.createDataFrame([(1, i + 1, j + 1, x) for i, row in enumerate(v) for j, x in enumerate(row)], "sheet int, i long, j long, v int").withColumn("z", F.col("v"))
    out = segments.prune_small(segments.labelled(cells, "v", 3), 3)
    label = {(r.i, r.j): r.label for r in out.collect()}
    assert label[2, 3] == label[1, 4] != label[1, 1]


def test_reduced_trees_keep_prominence():
    rng = np.random.default_rng(0)
    for _ in range(60):
        z = rng.integers(0, 12, (6, 7)).astype(float)
        whole = kernels.prominence(z)
        ids, parents = kernels.reduced_tree(z, kernels.component_tree(z), 3.0, "")
        h, up = z.T.ravel(), dict(zip(ids.tolist(), parents.tolist(), strict=True))
        top = {i: h[i - 1] for i in up}
        for i in up:
            q = i
            while up[q]:
                q = up[q]
                top[q] = max(top[q], h[i - 1])
        for leaf in set(up) - set(up.values()):
            q, prominence = leaf, h[leaf - 1]
            while up[q]:
                q = up[q]
                if top[q] > h[leaf - 1]:
                    prominence = h[leaf - 1] - h[q - 1]
                    break
            assert leaf not in whole or prominence == whole[leaf]
        assert {h[i - 1] for i, p in whole.items() if p >= 3} <= {h[i - 1] for i in set(up) - set(up.values())}
