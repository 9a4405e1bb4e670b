import numpy as np
from pyspark.sql import functions as F

from orofold.config import Settings
from orofold.plans import pipeline
from orofold.sources import geotiff, png
from orofold.spec import MapSpec


def hills(n=48):
    """Two summits of different height either side of a saddle, and a level lake below them."""
    i, j = np.indices((n, 2 * n), dtype=float)
    z = 260 + 700 * np.exp(-((i - 14) ** 2 + (j - 24) ** 2) / 90) + 500 * np.exp(-((i - 20) ** 2 + (j - 70) ** 2) / 120)
    z[34:46, 30:66] = 260.0
    return np.round(z, 2)


def cells_of(spark, z, nx):
    i, j = np.indices(z.shape)
    rows = zip((j // nx + 1).ravel().tolist(), (i + 1).ravel().tolist(), (j % nx + 1).ravel().tolist(), z.ravel().tolist(), strict=True)
    return spark.createDataFrame(list(rows), "sheet int, i long, j long, z double")


def test_all_steps_of_two_sheets(spark, tmp_path):
    z, spec = hills(), MapSpec(44000, 6909000, 1, 2, 1, 48, 48, 1000)
    settings = Settings(grid_spacing=20, grid_thickness=3, water_least_area_m2=60, summit_obscure=20.0, summit_prominent=300.0, summit_least_stress=-1000.0, summit_size_prominent=5, summit_size_obscure=3)
    job = pipeline.Job(spark, spec, cells_of(spark, z, 48), str(tmp_path / "out"), settings)
    made = pipeline.run(job, 1)
    assert list(made) == [name for name, _, _ in pipeline.STEPS] and all(made.values())
    assert job.table("cells").count() == job.table("relief").count() == job.table("lakes").count() == 2 * 48 * 48
    tops = job.table("summits").orderBy(F.desc("z")).collect()
    assert [(r.sheet, r.i, r.j) for r in tops] == [(1, 15, 25), (2, 21, 23)]
    assert abs(tops[0].prominence - tops[0].z) < 1e-6 and 300 < tops[1].prominence < 500
    assert job.table("contours").count() > 100 and job.table("markers").count() > 0
    shots = {r.sheet: png.decode(bytes(r.png)) for r in job.table("images").collect()}
    assert {k: v.shape for k, v in shots.items()} == {1: (48, 48, 4), 2: (48, 48, 4)} and all((v[:, :, 3] == 255).all() for v in shots.values())
    assert {r.sheet: png.decode(bytes(r.png)).shape for r in job.table("thumbnails").collect()} == {1: (24, 24, 4), 2: (24, 24, 4)}
    pages = {r.sheet: r.svg for r in job.table("pages").collect()}
    assert set(pages) == {1, 2} and '"1.png"' in pages[1] and f"{round(tops[0].z)} m ({round(tops[0].prominence)} m)" in pages[1].replace("<tspan class=\"small\">", "").replace("</tspan>", "")
    assert not any(pipeline.run(job, 1).values())


def test_cells_from_archives(spark):
    """Two overlapping rasters in a zip: the later name wins, what none covers is 0, what is outside goes."""
    spec = MapSpec(44000, 6909000, 1, 2, 1, 4, 3, 1000)
    a = geotiff.Raster(np.full((3, 6), 5.0, np.float32), 43999, 6909003, 1)
    b = geotiff.Raster(np.full((2, 2), 7.0, np.float32), 44004, 6909003, 1)
    members = spark.createDataFrame([("x.zip", "a.tif", geotiff.dump(a)), ("x.zip", "b.tif", geotiff.dump(b))], "path string, name string, content binary")
    got = pipeline.from_archives(spark, spec, geotiff.zipped(members)).collect()
    grid = np.zeros((3, 8))
    for r in got:
        grid[r.i - 1, (r.sheet - 1) * 4 + r.j - 1] = r.z
    want = np.zeros((3, 8))
    want[:, :5], want[:2, 4:6] = 5, 7
    assert len(got) == 24 and (grid == want).all()


def test_steps_run_once_and_then_only_what_changed(spark, tmp_path):
    spec = MapSpec(44000, 6909000, 1, 2, 1, 8, 7, 1000)
    cells = cells_of(spark, hills()[:7, :16], 8)
    job = pipeline.Job(spark, spec, cells, str(tmp_path / "out"), Settings(grid_spacing=10, grid_thickness=3))
    steps = {"cells", "relief", "grid"}
    assert all(pipeline.run(job, 1, steps).values())
    assert job.table("relief").count() == 112 and job.table("grid").count() > 0
    assert not any(pipeline.run(job, 1, steps).values())
    assert [k for k, v in pipeline.run(job, 2, {"grid"}).items() if v] == ["grid"]
    assert "1.svg" in pipeline.mosaic(job)
