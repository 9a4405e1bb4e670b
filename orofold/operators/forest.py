"""Forest and built-up ground: where the surface is rough at the scale of crowns and roofs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import taps
from . import raster, segments, terrain


def forest_mask(cells: DataFrame, shape: tuple[int, int], cell2utm: int = 1, patch_m2: int = 9062, width: int = 75) -> DataFrame:
    """sheet, i, j, forest (0 or 1), at every cell2utm-th cell of full-resolution cells.

    Roughness out of range counts as none; what is left is smoothed, cut into connected patches, small patches join their
    roughest neighbour, and patches of fitting mean roughness are forest."""
    rough = raster.smooth_tiles(cells, np.array(taps.fir_highpass(width, 15)), shape).join(cells.select("sheet", "i", "j", "z"), ["sheet", "i", "j"])
    bumpy = rough.select("sheet", "i", "j", terrain.bumpiness(F.col("v"), F.col("z")).alias("z"))
    smooth = raster.smooth_tiles(bumpy, np.array(taps.fir_lowpass(width, 4)), shape).select("sheet", "i", "j", F.col("v").alias("z"))
    small = (-(-shape[0] // cell2utm), -(-shape[1] // cell2utm))
    at = raster.sampled(smooth, cell2utm).withColumns({"v": F.col("z"), "rough": F.col("z") > 0.01})
    parts = segments.prune_small(segments.labelled(at, "rough", small[0]), round(patch_m2 / cell2utm**2))
    mean = parts.groupBy("sheet", "label").agg(F.avg("v").alias("mean"))
    return parts.join(mean, ["sheet", "label"]).select("sheet", "i", "j", F.when((F.col("mean") > 0.5) & (F.col("mean") < 3), 1).otherwise(0).alias("forest"))
