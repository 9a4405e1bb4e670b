"""The whole map job: steps over all sheets at once, each a table that is kept and not made again while its inputs are older."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import geometry, palette
from ..operators import forest, graphs, marks, raster, segments, summits, terrain, water
from ..sources import geotiff, png, svg, text
from ..spec import MapSpec


@dataclass
class Job:
    """cells: full-resolution cells (sheet, i, j, z), one metre each; out: the folder of all step tables."""

    spark: SparkSession
    spec: MapSpec
    cells: DataFrame
    out: str
    settings: Settings = field(default_factory=Settings)
    names: DataFrame | None = None

    @property
    def full(self) -> tuple[int, int]:
        return self.spec.ny * self.spec.cell2utm, self.spec.nx * self.spec.cell2utm

    @property
    def size(self) -> tuple[int, int]:
        return self.spec.ny, self.spec.nx

    def table(self, step: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{step}")


def _rgba(r: int, g: int, b: int, a: int = 255):
    return F.struct(*[F.lit(v).alias(k) for k, v in zip("rgba", (r, g, b, a), strict=True)])


def cells(job: Job) -> DataFrame:
    return raster.require_data(job.cells.select("sheet", "i", "j", F.coalesce("z", F.lit(0.0)).cast("double").alias("z")), job.settings.get("behaviour", "fill_empty"))


def forests(job: Job) -> DataFrame:
    return forest.forest_mask(job.table("cells"), job.full, job.spec.cell2utm)


def lakes(job: Job) -> DataFrame:
    return water.water_segments(job.table("cells"), job.full, job.settings, job.spec.cell2utm)


def relief(job: Job) -> DataFrame:
    lit = terrain.relief(raster.sampled(job.table("cells"), job.spec.cell2utm), palette.palette(job.spark))
    c = terrain.srgb(F.col("x"), F.col("y"), F.col("z"))
    return lit.select("sheet", "i", "j", F.struct(*[v.alias(k) for k, v in c.items()], F.lit(255).alias("a")).alias("rgba"))


def contours(job: Job) -> DataFrame:
    """Lines of three distances, thinned, without short ones, as thick as each is drawn."""
    import numpy as np

    from ..functions import taps

    smooth = raster.smooth_tiles(job.table("cells"), np.array(taps.gaussian(49)), job.full).withColumnRenamed("v", "smooth")
    at = raster.sampled(job.table("cells").join(smooth, ["sheet", "i", "j"]), job.spec.cell2utm)
    at = graphs.kept(at.join(job.table("forests"), ["sheet", "i", "j"]))
    out = None
    for step in (20, 100, 1000):
        thick = job.settings.get("contour", f"thickness_{step}")
        line = terrain.contour(at, float(step)).withColumnRenamed("contour", "marked")
        part = stroked(line, job.size, thick, job.settings.get("contour", "least_length"))
        out = part if out is None else out.union(part)
    return out.distinct().withColumn("rgba", _rgba(182, 85, 0))


def stroked(marked: DataFrame, size: tuple[int, int], thick: int, least: int) -> DataFrame:
    """Marked cells as pen strokes: thinned, without short ones, then thickened; as they are for thickness 0."""
    if thick == 0:
        return marked.where("marked").select("sheet", "i", "j")
    if thick % 2 == 0:
        raise ValueError("thickness is 0 or odd")
    thin = segments.thinned(marked, size).withColumn("marked", F.lit(True))
    long = segments.long_strokes(thin, size[0], least)
    return long if thick == 1 else terrain.dilate(long, thick // 2, size)


def ridges(job: Job) -> DataFrame:
    import numpy as np

    from ..functions import taps

    lap = raster.smooth_laplacian(job.table("cells"), np.array(taps.fir_lowpass(159, 16)), job.full, job.spec.cell2utm).join(job.table("forests"), ["sheet", "i", "j"])
    classed = lap.select("sheet", "i", "j", terrain.ridge_class(F.col("laplacian") / 144, F.col("forest")).alias("k"))
    out = None
    for k, thick, colour in ((1, terrain.CORNER_WIDTH, _rgba(190, 190, 190)), (2, terrain.DIEDER_WIDTH, _rgba(150, 150, 150))):
        part = stroked(classed.select("sheet", "i", "j", (F.col("k") == k).alias("marked")), job.size, thick, 5)
        part = part.where(terrain.inside_border(F.col("i"), F.col("j"), thick, job.size)).select("sheet", "i", "j", F.lit(k).alias("k"), colour.alias("rgba"))
        out = part if out is None else out.union(part)
    return out.groupBy("sheet", "i", "j").agg(F.max_by("rgba", "k").alias("rgba"))


def placed(job: Job, rows: DataFrame) -> DataFrame:
    """rows (sheet, i, j) with e and n of their sample points."""
    at = job.spec.sheets(job.spark).select("sheet", F.col("min_x").alias("x0"), F.col("min_y").alias("y0"))
    e, n = geometry.cell_utm(F.col("i"), F.col("j"), F.col("x0"), F.col("y0"), job.spec.ny, job.spec.cell2utm)
    return rows.join(F.broadcast(at), "sheet").withColumns({"e": e, "n": n}).drop("x0", "y0")


def grid(job: Job) -> DataFrame:
    one = job.spark.range(1, len(job.spec) + 1).select(F.col("id").cast("int").alias("sheet"), F.explode(F.sequence(F.lit(1), F.lit(job.spec.ny))).alias("i"))
    at = placed(job, one.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(job.spec.nx)))))
    get = job.settings.get
    return terrain.utm_grid(at, get("grid", "zone"), get("grid", "spacing"), get("grid", "thickness")).where("line").select("sheet", "i", "j", _rgba(0, 0, 0, 160).alias("rgba"))


def prominent(job: Job) -> DataFrame:
    """Summits of all sheets: trees a sheet, joined over borders, prominence in the whole."""
    get = job.settings.get
    c = graphs.kept(raster.sampled(job.table("cells"), job.spec.cell2utm).withColumn("z", F.greatest("z", F.lit(0.5))))
    tree = graphs.kept(segments.component_tree(c, job.size))
    wide = F.col("sheet").cast("long") * (1 << 40)
    v = placed(job, c).withColumn("id", segments.cell_id(job.spec.ny) + wide)
    # Each sheet's tree shrinks to what matters beyond it before sheets are joined.
    sides = "".join(k for k, there in (("w", job.spec.ncols > 1), ("n", job.spec.nrows > 1), ("s", job.spec.nrows > 1), ("e", job.spec.ncols > 1)) if there)
    small = graphs.kept(segments.reduced_tree(c, job.size, get("summit", "obscure"), sides))
    few = graphs.kept(v.join(small.select((F.col("id") + wide).alias("id")), "id", "left_semi"))
    edges = graphs.kept(small.where("parent > 0").select((F.col("parent") + wide).alias("a"), (F.col("id") + wide).alias("b")))
    if len(job.spec) > 1:
        few, edges = graphs.merge_sheets(few, edges, job.spec.cell2utm)
    told = graphs.prominence(few.select("id", "z"), edges)
    found = summits.distinct_summits(tree, v.select("sheet", (F.col("id") - wide).alias("id"), "z")).select((F.col("id") + wide).alias("id"))
    stress = raster.mean_stress(c).where((F.col("sigma") < 0) & (F.col("sigma") > job.settings.get("summit", "least_stress")))
    candidates = v.where("z > 200").join(found, "id", "left_semi").join(stress.select("sheet", "i", "j", "sigma"), ["sheet", "i", "j"])
    rows = told.join(v.drop("z"), "id")
    rows = summits.with_stress(rows, candidates.select("e", "n", F.col("sigma").alias("stress"), F.col("id").alias("written")), job.names)
    return summits.regional(rows, get("summit", "obscure"), get("summit", "prominent")).select("sheet", "rank", "z", "prominence", "e", "n", "i", "j", "stress", "name")


def consolidated(spark: SparkSession, spec: MapSpec, found: DataFrame) -> DataFrame:
    """A job's cells, one metre each, from raster files (path, content) that overlap its sheets; later paths overwrite."""
    c = geotiff.cells(found)
    row, col = geometry.sheet_index(F.col("e"), F.col("n"), spec)
    at = c.withColumns({"row": row, "col": col}).where("row is not null and col is not null")
    i = F.lit(spec.sw_n) + F.col("row") * spec.sheet_height - F.col("n") + 1
    j = F.col("e") - spec.sw_e - (F.col("col") - 1) * spec.sheet_width + 1
    sheet = (F.col("row") + (F.col("col") - 1) * spec.nrows).cast("int")
    sources = at.select(sheet.alias("sheet"), i.cast("long").alias("i"), j.cast("long").alias("j"), "z", F.struct("path").alias("file_order"))
    return raster.consolidate(sources, (spec.sheet_height, spec.sheet_width), spec.sheets(spark).select("sheet"))


def from_archives(spark: SparkSession, spec: MapSpec, archives: DataFrame) -> DataFrame:
    """A job's cells from zip files (path, content) of rasters."""
    return consolidated(spark, spec, geotiff.unzipped(archives).select(F.col("name").alias("path"), "content"))


def markers(job: Job) -> DataFrame:
    get = job.settings.get
    at = marks.summit_marks(job.table("summits"), job.size, (get("summit", "prominent"), get("summit", "obscure")), (get("summit", "symbol_prominent"), get("summit", "symbol_obscure")), (get("summit", "size_prominent"), get("summit", "size_obscure")))
    return at.withColumn("rgba", _rgba(0, 0, 0))


def images(job: Job) -> DataFrame:
    layers = {"contour": job.table("contours"), "ridge": job.table("ridges"), "water": blue(job), "grid": job.table("grid"), "markers": job.table("markers")}
    return png.sheet_images(terrain.composite(job.table("relief"), layers), job.size, job.spec.density)


def blue(job: Job) -> DataFrame:
    return job.table("lakes").select("sheet", "i", "j", water.colour(F.col("water"), F.col("z")).alias("rgba")).where("rgba.a > 0")


def thumbnails(job: Job) -> DataFrame:
    """Ridges, water and markers over the relief, smaller by as many times as the matrix has sheets along its longer side."""
    n = max(job.spec.nrows, job.spec.ncols)
    drawn = terrain.composite(job.table("relief"), {"ridge": job.table("ridges"), "water": blue(job), "markers": job.table("markers")}, terrain.THUMBNAIL_LAYERS)
    drawn = graphs.kept(drawn.select("sheet", "i", "j", "rgba.r", "rgba.g", "rgba.b"))
    mean = F.floor((2 * F.col("total") + F.col("n_cells")) / (2 * F.col("n_cells"))).cast("int")
    small = None
    for k in "rgb":
        part = raster.box_sums(drawn, n, k).select("sheet", "i", "j", mean.alias(k))
        small = part if small is None else small.join(part, ["sheet", "i", "j"])
    rgba = small.select("sheet", "i", "j", F.struct("r", "g", "b", F.lit(255).alias("a")).alias("rgba"))
    return png.sheet_images(rgba, (-(-job.size[0] // n), -(-job.size[1] // n)), job.spec.density)


def pages(job: Job) -> DataFrame:
    """sheet, svg: each sheet's image with the labels of its summits and lakes."""
    top = svg.summit_labels(job.table("summits"), job.spec.nx, job.settings.get("text", "flip")).withColumn("sheet", F.col("sheet").cast("int"))
    still = water.water_table(job.table("lakes").where("label is not null"), job.size, job.spec.cell2utm, (job.spec.sw_e, job.spec.sw_n))
    lakes_ = svg.lake_labels(still).select("sheet", F.lit("").alias("name"), F.col("text").alias("second"), "i", "j", F.lit("start").alias("anchor"))
    return svg.pages(job.spec, job.spec.sheets(job.spark), top.unionByName(lakes_), job.settings.get("text", "font_pt"))


#: step, what makes it, the steps it needs.
STEPS: list[tuple[str, Callable[[Job], DataFrame], tuple[str, ...]]] = [
    ("cells", cells, ()),
    ("forests", forests, ("cells",)),
    ("lakes", lakes, ("cells",)),
    ("relief", relief, ("cells",)),
    ("contours", contours, ("cells", "forests")),
    ("ridges", ridges, ("cells", "forests")),
    ("grid", grid, ()),
    ("summits", prominent, ("cells",)),
    ("markers", markers, ("summits",)),
    ("images", images, ("relief", "contours", "ridges", "lakes", "grid", "markers")),
    ("thumbnails", thumbnails, ("relief", "ridges", "lakes", "markers")),
    ("pages", pages, ("lakes", "summits")),
]


def _versions(job: Job) -> dict[str, int]:
    """What each step was made from last, as written beside the tables."""
    try:
        return json.loads(job.spark.read.text(f"{job.out}/manifest", wholetext=True).first()[0])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}


def run(job: Job, version: int, steps: set[str] | None = None) -> dict[str, bool]:
    """Makes each step that lacks a table of this version of the input, or one of whose needs was made anew; says which were."""
    done, made = _versions(job), {}
    for name, make, needs in STEPS:
        if steps is not None and name not in steps:
            continue
        made[name] = done.get(name) != version or any(made.get(n) for n in needs)
        if made[name]:
            make(job).write.mode("overwrite").parquet(f"{job.out}/{name}")
            done[name] = version
            job.spark.createDataFrame([(json.dumps(done),)], "value string").coalesce(1).write.mode("overwrite").text(f"{job.out}/manifest")
    return made


def summit_table(job: Job, sheet: int | None = None) -> DataFrame:
    """Rows as written to text files: heights, prominence, place, cell, stress, name."""
    s = job.table("summits") if sheet is None else job.table("summits").where(F.col("sheet") == sheet)
    pair = lambda a, b: F.format_string("(%d, %d)", a, b)
    ordered = s.orderBy("sheet", "rank")
    return text.padded(ordered.select(F.col("z").alias("Elevation_m"), F.col("prominence").alias("Prominence_m"), pair("e", "n").alias("Utm"), pair("i", "j").alias("Cell_index"), F.col("stress").alias("Stress"), F.col("name").alias("Name")))


def mosaic(job: Job, n: int = 1000) -> str:
    """The linked overview as SVG; a row a sheet."""
    rows = svg.tiles(job.spec.sheets(job.spark), job.spec, n).orderBy("sheet").collect()
    return svg.mosaic(rows, n, lambda k: (f"{k}.svg", f"{k}.png"))
