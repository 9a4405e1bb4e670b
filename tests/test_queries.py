import glob
import math
import os

import duckdb
import pytest

from orofold.operators import raster, water
from orofold.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return round(float(v), 4)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    out = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(out.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(out.columns, out.fetchall())


@pytest.mark.parametrize("name", ["thinning", "felzenszwalb", "component_tree", "utm_grid_mask", "composite_layers"])
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """Tables whose rasters have more rows (and columns) than those of sf0.01."""
    at = str(tmp_path_factory.mktemp("tall"))
    # 150 rows of 125 columns; z is 2 * 211 * 997 in rows 130 and 150 and 1 elsewhere.
    price = "IF(floor(id / 125) IN (129, 149) AND id % 125 = 60, 422 * 997, 1) * 2.5D AS o_totalprice"
    spark.range(150 * 125).selectExpr("id AS o_orderkey", price).write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(i, [5000.0 * ((i // 3 + j // 3) % 2) for j in range(64)]) for i in range(600)], "vec_id long, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    line = "1L AS l_orderkey, 1L AS l_linenumber, 50.0D AS l_extendedprice, date'2020-01-01' AS l_shipdate, 1.0D AS l_quantity"
    spark.sql(f"SELECT 2100L AS l_partkey, 120L AS l_suppkey, {line}").write.parquet(f"{at}/lineitem.parquet")
    return at


def cells_of(spark, name, at, condition="true"):
    return {(r.i, r.j) for r in registry.queries()[name](spark, at).where(condition).collect()}


def test_queries_take_the_whole_of_larger_tables(spark, tall):
    square = {(di, dj) for di in range(-2, 3) for dj in range(-2, 3)}
    near = lambda offsets: {(i + di, 61 + dj) for i in (130, 150) for di, dj in offsets if i + di <= 150}
    assert cells_of(spark, "dilate", tall) == near(square)
    assert cells_of(spark, "stamped_squares", tall) == near({d for d in square if 2 in map(abs, d)})
    assert cells_of(spark, "border_cells", tall) == {(1, j) for j in range(2, 125)} | {(i, 125) for i in range(2, 150)}
    assert max(i for i, _ in cells_of(spark, "ridge_class", tall, "ridge > 0")) == 594
    out = registry.queries()["consolidate_last_wins"](spark, tall)
    assert out.count() == 2101 * 121 and [(r.i, r.j, r.z) for r in out.where("z <> 0").collect()] == [(2101, 121, 100)]


@pytest.mark.parametrize("name", ["thinning", "prune_small_segments", "felzenszwalb", "component_tree", "forest_mask", "artifact_mask", "water_segments"])
def test_sheet_queries_run_over_the_whole_table(spark, tmp_path, name):
    """150 rows of orders make sheets of 60, 60 and 30 rows; a sheet comes out as it does from a table of its own."""
    z = "CAST((id * id % 977) * 2.5D + 25 AS DOUBLE) AS o_totalprice"
    whole = spark.range(150 * 125).selectExpr("id AS o_orderkey", z)
    whole.write.parquet(f"{tmp_path}/whole/orders.parquet")
    got = registry.queries()[name](spark, f"{tmp_path}/whole").collect()
    assert {r.sheet for r in got} == {1, 2, 3}
    for sheet in (2, 3):
        own = whole.where(f"floor(o_orderkey / 7500) = {sheet - 1}").selectExpr(f"o_orderkey - {7500 * (sheet - 1)} AS o_orderkey", "o_totalprice")
        own.write.parquet(f"{tmp_path}/{sheet}/orders.parquet")
        alone = registry.queries()[name](spark, f"{tmp_path}/{sheet}").collect()
        assert sorted(str(r[1:]) for r in got if r.sheet == sheet) == sorted(str(r[1:]) for r in alone)


def test_summit_candidates_of_sheets_that_share_a_number(spark, tmp_path):
    """150 rows of orders make five rows of sheets: the fifth's numbers are those of the first's, a column further west."""
    orders = spark.range(150 * 125).selectExpr("id AS o_orderkey", "CAST(50000 + id * id % 99991 * 5 AS DOUBLE) AS o_totalprice")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    df = registry.queries()["summit_candidates_by_sheet"](spark, str(tmp_path))
    out = con.sql(registry.oracle_sql()["summit_candidates_by_sheet"])
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == 25 and got == rows_of(out.columns, out.fetchall())


def test_heaps_that_choose_each_other_may_be_water(spark):
    """Two heaps two thirds of water within water: each has the other as the neighbour with least water, and together they are mostly water."""
    inner = {(i, j): 6 if j < 5 else 7 for i in (2, 3, 4) for j in (3, 4, 5, 6)}
    rows = [(1, i, j, 1.0, inner.get((i, j), 1), -9 if (i, j) in inner else 0, (i, j) not in inner or i > 2) for i in range(1, 6) for j in range(1, 9)]
    cells = spark.createDataFrame(rows, "sheet int, i long, j long, z double, label long, v long, water boolean")
    got = {(r.i, r.j): (r.label, r.water) for r in water.without_heaps(cells, (5, 8), 1, -8.0).collect()}
    assert got == {(i, j): (6 if (i, j) in inner else 1, True) for i in range(1, 6) for j in range(1, 9)}


def test_consolidate_makes_absent_cells_after_the_last_shuffle(spark):
    rows = [(1, 1, 1, 5.0, 1), (1, 1, 4, 6.0, 1), (1, 3, 2, 7.0, 1), (1, 3, 2, 8.0, 2), (1, 3, 3, None, 9), (1, 4, 1, 9.0, 1), (2, 2, 4, 1.0, 1), (2, 2, 5, 9.0, 1), (7, 1, 1, 9.0, 1), (None, 1, 1, 9.0, 1)]
    sources = spark.createDataFrame(rows, "sheet int, i long, j long, z double, file_order int")
    out = raster.consolidate(sources, (3, 4), spark.createDataFrame([(1,), (2,), (3,)], "sheet int"))
    want = {(1, 1, 1): 5.0, (1, 1, 4): 6.0, (1, 3, 2): 8.0, (2, 2, 4): 1.0}
    assert sorted(map(tuple, out.collect())) == [(s, i, j, want.get((s, i, j), 0.0)) for s in (1, 2, 3) for i in (1, 2, 3) for j in (1, 2, 3, 4)]
    assert out.dtypes == [("sheet", "int"), ("i", "bigint"), ("j", "bigint"), ("z", "double")]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    steps = [line for line in plan.splitlines() if "Generate" in line or "Exchange" in line or "Join" in line]
    assert "Generate" in steps[0]
