"""Water surfaces: flat, low or artificially smooth ground, in regions large and level enough."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import taps
from . import raster, segments, terrain

WATER, ICE, NONE = (133, 161, 195, 255), (204, 204, 204, 255), (0, 0, 0, 0)


def low_water(z: Column, sea_level: float) -> Column:
    return z <= sea_level


def in_slope_range(dz: Column, diagonal: Column, cell2utm: int, nominal: float, most: float) -> Column:
    """Whether a segment's height difference is within what its diagonal (in cells) allows: proportional up to a nominal length."""
    return dz <= F.least(diagonal * cell2utm, F.lit(nominal)) / nominal * most


def slope_segments(stats: DataFrame, cell2utm: int, nominal: float = 2231.0, most: float = 1.2, flat: float | None = None) -> DataFrame:
    """stats with level: segments that pass; flat: the highest mean steepness (the sentinel value itself passes)."""
    ok = in_slope_range(F.col("z_max") - F.col("z_min"), F.sqrt("diagonal2"), cell2utm, nominal, most)
    if flat is not None:
        ok = ok & (F.col("total") / F.col("n") <= flat)
    return stats.withColumn("level", ok)


def artifacts(cells: DataFrame, shape: tuple[int, int], radius: float = 5, limit: float = 0.17) -> DataFrame:
    """sheet, i, j, artifact of cells with laplacian: ground whose curvature changes as little as only interpolation's does."""
    g = raster.gradient(cells, "laplacian")
    w = g.select("sheet", "i", "j", terrain.tanh_window(F.abs((F.col("g1") + F.col("g2")) / 12.0), 1e-6, 10**-3.5).alias("z"))
    return raster.smooth_tiles(w, np.array(taps.gaussian(radius)), shape).select("sheet", "i", "j", (F.col("v") > limit).alias("artifact"))


def flux_keeps(flux: Column, cell2utm: int, limit: float = -0.328) -> Column:
    """False where more flows in through the edge than a lake's shore lets: heaps."""
    return flux > limit / cell2utm**2


def water_segments(cells: DataFrame, shape: tuple[int, int], settings: Settings | None = None, cell2utm: int | None = None) -> DataFrame:
    """sheet, i, j, z, label, water of a sheet's full-resolution cells (one metre each): candidates, merged by least area, heaps joined to
    their neighbours. cell2utm: metres a cell of the result, where it isn't the settings'."""
    s = settings or Settings()
    get = lambda k: s.get("water", k)
    c = cell2utm or s.get("map", "cell2utm")
    ny, nx = -(-shape[0] // c), -(-shape[1] // c)
    g = raster.gradient(cells)
    blur = np.array(taps.gaussian(max(get("slope_radius"), 0.5)))
    soft = {k: raster.smooth_tiles(g.select("sheet", "i", "j", (F.col(k) / 12.0).alias("z")), blur, shape).withColumnRenamed("v", k) for k in ("g1", "g2")}
    steep = soft["g1"].join(soft["g2"], ["sheet", "i", "j"]).select("sheet", "i", "j", terrain.steepness_or(F.col("g1"), F.col("g2"), get("slope_limit")).alias("v"))
    curved = raster.laplacian(cells).select("sheet", "i", "j", "z", (F.col("laplacian") / 144.0).alias("laplacian"))
    at = raster.sampled(steep.join(curved, ["sheet", "i", "j"]).join(artifacts(curved, shape, get("artifact_radius"), get("artifact_limit")), ["sheet", "i", "j"]), c)
    regions = segments.merged_regions(at, (ny, nx), 4.0, round(200 / c**2), "v")
    flat = at.join(regions, ["sheet", "i", "j"])
    level = slope_segments(segments.segment_stats(flat, (ny, nx)), c, get("diagonal"), get("elevation_range"), 2 * get("slope_limit"))
    candidate = flat.join(level.select("sheet", "label", "level"), ["sheet", "label"]).withColumn("water", F.col("level") | F.col("artifact") | low_water(F.col("z"), get("sea_level"))).drop("label")
    parts = segments.merged_regions(candidate.withColumn("w", F.col("water").cast("int")), (ny, nx), 6.0, round(get("least_area_m2") / c**2), "w")
    named = candidate.join(parts, ["sheet", "i", "j"]).withColumn("v", F.col("laplacian"))
    return without_heaps(named, (ny, nx), c, get("flux"))


def without_heaps(cells: DataFrame, shape: tuple[int, int], cell2utm: int, limit: float) -> DataFrame:
    """sheet, i, j, z, label, water of candidate regions (cells: label, z, v: the Laplacian, water): regions mostly of water whose flux is
    a heap's join their neighbour with the least share of water; what is then mostly water is water."""
    share = F.avg(F.col("water").cast("int"))
    stats = segments.segment_stats(cells, shape).join(cells.groupBy("sheet", "label").agg(share.alias("share")), ["sheet", "label"])
    heaps = stats.where((F.col("share") > 0.5) & ~flux_keeps(F.col("flux"), cell2utm, limit)).select("sheet", "label", F.col("n").alias("size"))
    merged = segments.prune(cells.withColumn("v", F.col("water").cast("int")), heaps.drop("size"), F.col("total") / F.col("n"))
    told = merged.groupBy("sheet", "label").agg((share > 0.5).alias("is_water"), F.count("*").alias("merged"))
    # A heap without a neighbour is a whole sheet: it stays a region, but isn't water. Heaps that chose each other make a larger region under
    # the label of one, which counts as any other.
    alone = F.col("size").isNotNull() & (F.col("size") == F.col("merged"))
    told = told.join(heaps, ["sheet", "label"], "left").select("sheet", "label", (F.col("is_water") & ~alone).alias("is_water"))
    return merged.drop("water").join(told, ["sheet", "label"]).select("sheet", "i", "j", "z", "label", F.col("is_water").alias("water"))


def water_table(cells: DataFrame, shape: tuple[int, int], cell2utm: int, sw: tuple[int, int]) -> DataFrame:
    """A row a water segment (cells: sheet, i, j, z, label, water): rounded elevation at its mean index, area, place and cell there.

    The mean index may lie outside a bent lake; the elevation is that of the cell there."""
    wet = cells.where("water").withColumn("v", F.lit(0))
    stats = segments.segment_stats(wet, shape).select("sheet", "label", "n", F.col("mean_i").alias("i"), F.col("mean_j").alias("j"))
    return stats.join(cells.select("sheet", "i", "j", "z"), ["sheet", "i", "j"]).select(
        "sheet", "label", F.rint("z").cast("long").alias("elevation_m"), (F.col("n") * cell2utm**2).alias("area_m2"), ((F.col("j") - 1) * cell2utm + sw[0]).alias("e"), ((F.lit(shape[0]) - F.col("i") + 1) * cell2utm + sw[1]).alias("n_"), "i", "j"
    )


def colour(water: Column, z: Column) -> Column:
    """rgba: water, ice above 1000 m, transparent elsewhere."""
    rgba = lambda c: F.struct(*[F.lit(v).alias(k) for k, v in zip("rgba", c, strict=True)])
    return F.when(water & (z > 1000), rgba(ICE)).when(water, rgba(WATER)).otherwise(rgba(NONE))
