"""Stencils, separable filters and resampling over cell tables.

Derivatives and wide kernels run on tiles with a halo (`stencil`, `tiled`): a shuffle in all, with memory bounded by a tile. The other narrow
stencils are windows along rows and along columns of a sheet. Beyond a sheet's edge the nearest cell counts. A sheet's cells fill a rectangle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along_row():
    return Window.partitionBy("sheet", "i").orderBy("j")


def along_column():
    return Window.partitionBy("sheet", "j").orderBy("i")


AROUND = ("nw", "n", "ne", "w", "z", "e", "sw", "s", "se")


def _beside(value: Column, by: int, over) -> Column:
    return F.coalesce((F.lag if by < 0 else F.lead)(value, abs(by)).over(over), value)


def neighbours(cells: DataFrame, z: str = "z") -> DataFrame:
    """cells with the 3 x 3 neighbourhood of a column: nw n ne w z e sw s se (z under its own name)."""
    v = F.col(z)
    flat = cells.withColumns({"w": _beside(v, -1, along_row()), "e": _beside(v, 1, along_row())})
    three = F.struct(F.col("w").alias("w"), v.alias("z"), F.col("e").alias("e"))
    flat = flat.withColumns({"_n": _beside(three, -1, along_column()), "_s": _beside(three, 1, along_column())})
    named = {"nw": "_n.w", "n": "_n.z", "ne": "_n.e", "sw": "_s.w", "s": "_s.z", "se": "_s.e"}
    return flat.withColumns({k: F.col(p) for k, p in named.items()}).drop("_n", "_s")


def gradient12(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twelve times the gradient southwards and eastwards, after Bickley: central differences smoothed by 1 4 1."""
    a = np.pad(z, 1, mode="edge")
    down, right = a[2:] - a[:-2], a[:, 2:] - a[:, :-2]
    return down[:, :-2] + 4 * down[:, 1:-1] + down[:, 2:], right[:-2] + 4 * right[1:-1] + right[2:]


def _second(z: np.ndarray) -> dict[str, np.ndarray]:
    g1, g2 = gradient12(z)
    (h11, h12), (h21, h22) = gradient12(g1), gradient12(g2)
    return {"h11": h11, "h12": h12, "h21": h21, "h22": h22}


def _filled(data: np.ndarray, there: np.ndarray) -> np.ndarray:
    """data with absent cells as the nearest one above them, else below."""
    if there.all():
        return data
    rows = np.arange(len(data))[:, None]
    above = np.maximum.accumulate(np.where(there, rows, -1), 0)
    below = np.minimum.accumulate(np.where(there, rows, len(data))[::-1], 0)[::-1]
    at = np.where(above >= 0, above, below)
    return np.take_along_axis(data, np.minimum(at, len(data) - 1), 0)


def stencil(cells: DataFrame, kernel, radius: int, names: tuple[str, ...], z: str = "z", tile: int = 512) -> DataFrame:
    """sheet, i, j, z and the named columns: kernel(array) -> dict of arrays of its shape, on tiles with a halo.

    kernel repeats its array's edges itself, a cell a step for radius steps; its results count up to radius from an edge that isn't the
    sheet's. Whole numbers stay whole."""
    whole = dict(cells.dtypes)[z] in ("tinyint", "smallint", "int", "bigint")
    kind, arrow = ("long", pa.int64()) if whole else ("double", pa.float64())
    tiles = lambda x: F.explode(F.sequence(F.floor((F.col(x) - 1 - radius) / tile), F.floor((F.col(x) - 1 + radius) / tile)))
    dealt = cells.select("sheet", "i", "j", F.col(z).cast(kind).alias("z"), tiles("i").alias("ti")).withColumn("tj", tiles("j"))
    schema = pa.schema([("sheet", pa.int32()), ("i", pa.int64()), ("j", pa.int64()), ("z", arrow), *[(k, arrow) for k in names]])

    def run(key, rows):
        sheet, ti, tj = (k.as_py() for k in key)
        i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
        own = (i > ti * tile) & (i <= (ti + 1) * tile) & (j > tj * tile) & (j <= (tj + 1) * tile)
        if not own.any():  # a tile beyond the sheet's edge
            return schema.empty_table()
        i0, j0 = i.min(), j.min()
        data = np.zeros((i.max() - i0 + 1, j.max() - j0 + 1), np.int64 if whole else np.float64)
        there = np.zeros(data.shape, bool)
        data[i - i0, j - j0], there[i - i0, j - j0] = rows.column("z").to_numpy(), True
        done = kernel(_filled(data, there))
        i, j = i[own], j[own]
        return pa.table([pa.array(np.full(len(i), sheet), pa.int32()), pa.array(i), pa.array(j), pa.array(data[i - i0, j - j0]), *[pa.array(done[k][i - i0, j - j0]) for k in names]], schema=schema)

    return dealt.groupBy("sheet", "ti", "tj").applyInArrow(run, ", ".join(["sheet int, i long, j long", *[f"{k} {kind}" for k in ("z", *names)]]))


def gradient(cells: DataFrame, z: str = "z") -> DataFrame:
    """sheet, i, j, z and twelve times the gradient: g1, g2. Whole numbers stay whole."""
    return stencil(cells, lambda a: dict(zip(("g1", "g2"), gradient12(a), strict=True)), 1, ("g1", "g2"), z)


def hessian(cells: DataFrame, z: str = "z") -> DataFrame:
    """sheet, i, j, z and 144 times the second derivatives: h11, h12, h21, h22."""
    return stencil(cells, _second, 2, ("h11", "h12", "h21", "h22"), z)


def laplacian(cells: DataFrame, z: str = "z") -> DataFrame:
    """sheet, i, j, z, and 144 times the divergence of the gradient."""

    def kernel(a):
        h = _second(a)
        return {"laplacian": h["h11"] + h["h22"]}

    return stencil(cells, kernel, 2, ("laplacian",), z)


def smooth_laplacian(cells: DataFrame, taps: np.ndarray, shape: tuple[int, int], n: int) -> DataFrame:
    """sheet, i, j, laplacian (144 times) of the smoothed elevations, at every n-th row and column."""
    smooth = smooth_tiles(cells, taps, shape).withColumnRenamed("v", "z")
    return sampled(laplacian(smooth).select("sheet", "i", "j", "laplacian"), n)


def mean_stress(cells: DataFrame, z: str = "z") -> DataFrame:
    """sheet, i, j, z, sigma: half the Laplacian, below 0 on summits."""
    return laplacian(cells, z).select("sheet", "i", "j", "z", (F.col("laplacian") / 288).alias("sigma"))


def sampled(cells: DataFrame, n: int) -> DataFrame:
    """Every n-th row and column from the first, numbered anew."""
    kept = cells.where(((F.col("i") - 1) % n == 0) & ((F.col("j") - 1) % n == 0))
    return kept.withColumns({"i": (F.floor((F.col("i") - 1) / n) + 1).cast("long"), "j": (F.floor((F.col("j") - 1) / n) + 1).cast("long")})


def box_sums(cells: DataFrame, n: int, z: str = "z") -> DataFrame:
    """sheet, i, j, total, n_cells: sums over a box of odd side 2 (n div 2) + 1 about every n-th cell, edges repeated.

    Row sums first, at the columns that stay; then sums of those down the columns: 2 side, not side squared, terms a cell."""
    half = n // 2
    terms = [_shifted(F.col(z), k, along_row(), "j") for k in range(-half, half + 1)]
    rows = _with_edges(cells, along_row(), "j", z).withColumn("part", reduce(lambda a, b: a + b, terms)).where((F.col("j") - 1) % n == 0)
    rows = rows.select("sheet", "i", "j", "part")
    terms = [_shifted(F.col("part"), k, along_column(), "i") for k in range(-half, half + 1)]
    out = _with_edges(rows, along_column(), "i", "part").withColumn("total", reduce(lambda a, b: a + b, terms))
    return sampled(out.select("sheet", "i", "j", "total"), n).withColumn("n_cells", F.lit((2 * half + 1) ** 2))


def _with_edges(cells: DataFrame, over, axis: str, z: str) -> DataFrame:
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cells.withColumns({"_lo": F.first(z).over(whole), "_hi": F.last(z).over(whole)})


def _shifted(v: Column, k: int, over, axis: str) -> Column:
    if k == 0:
        return v
    return F.coalesce((F.lag if k < 0 else F.lead)(v, abs(k)).over(over), F.col("_lo" if k < 0 else "_hi"))


def separable(cells: DataFrame, taps: list, z: str = "z") -> DataFrame:
    """sheet, i, j, z filtered by the same odd number of symmetrical taps along rows and columns: built-in windows, for short taps."""
    half = len(taps) // 2
    out = cells
    for over, axis in ((along_row(), "j"), (along_column(), "i")):
        terms = [_shifted(F.col(z), k - half, over, axis) * t for k, t in enumerate(taps)]
        out = _with_edges(out, over, axis, z).withColumn(z, reduce(lambda a, b: a + b, terms)).drop("_lo", "_hi")
    return out.select("sheet", "i", "j", z)


# -- tiles with a halo

Kernel = Callable[[np.ndarray], np.ndarray]


def tiled(cells: DataFrame, kernel: Kernel, radius: int, shape: tuple[int, int], tile: int = 256, z: str = "z", out: str = "double") -> DataFrame:
    """sheet, i, j, v: kernel applied to each sheet of shape (rows, columns), tile by tile.

    A cell goes to every tile within radius of it. kernel gets a tile with its halo as a float64 array (the halo
    repeats the edge only at the sheet's own edges; absent cells are NaN) and gives an array of the same shape, right up to radius from its rim."""
    ny, nx = shape

    def tiles(x: str, n: int) -> Column:
        lo, hi = F.floor((F.greatest(F.col(x) - radius, F.lit(1)) - 1) / tile), F.floor((F.least(F.col(x) + radius, F.lit(n)) - 1) / tile)
        return F.explode(F.sequence(lo, hi))

    dealt = cells.select("sheet", "i", "j", F.col(z).cast("double").alias("z"), tiles("i", ny).alias("ti")).withColumn("tj", tiles("j", nx))

    kind = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64()}[out]

    def run(key, rows):
        sheet, ti, tj = (k.as_py() for k in key)
        i0, j0 = ti * tile + 1, tj * tile + 1
        i1, j1 = min(ny, i0 + tile - 1), min(nx, j0 + tile - 1)
        # Where a sheet has fewer rows or columns than its shape, its last ones are the edge.
        last_i, last_j = int(rows.column("i").to_numpy().max()), int(rows.column("j").to_numpy().max())
        i1, j1 = min(i1, last_i), min(j1, last_j)
        if i1 < i0 or j1 < j0:
            return pa.table({"sheet": pa.array([], pa.int32()), "i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "v": pa.array([], kind)})
        lo_i, hi_i, lo_j, hi_j = max(1, i0 - radius), min(last_i, i1 + radius), max(1, j0 - radius), min(last_j, j1 + radius)
        data = np.full((hi_i - lo_i + 1, hi_j - lo_j + 1), np.nan)
        data[rows.column("i").to_numpy() - lo_i, rows.column("j").to_numpy() - lo_j] = rows.column("z").to_numpy()
        top, left = radius - (i0 - lo_i), radius - (j0 - lo_j)
        padded = np.pad(data, ((top, radius - (hi_i - i1)), (left, radius - (hi_j - j1))), mode="edge")
        done = np.asarray(kernel(padded))[radius : radius + i1 - i0 + 1, radius : radius + j1 - j0 + 1]
        there = ~np.isnan(data[i0 - lo_i : i1 - lo_i + 1, j0 - lo_j : j1 - lo_j + 1])
        i, j = np.nonzero(there)
        return pa.table({"sheet": pa.array(np.full(len(i), sheet), pa.int32()), "i": pa.array(i + i0, pa.int64()), "j": pa.array(j + j0, pa.int64()), "v": pa.array(done[i, j].astype(np.float64)).cast(kind, safe=False)})

    return dealt.groupBy("sheet", "ti", "tj").applyInArrow(run, f"sheet int, i long, j long, v {out}")


def convolve(data: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Symmetrical taps along both axes of an array, same shape."""
    half = len(taps) // 2

    def along(x: np.ndarray) -> np.ndarray:
        wide = np.pad(x, ((half, half), (0, 0)), mode="edge")
        out = np.zeros_like(x)
        for k, t in enumerate(taps):
            out += t * wide[k : k + len(x)]
        return out

    return along(along(data).T).T


def smooth_tiles(cells: DataFrame, taps: np.ndarray, shape: tuple[int, int], tile: int = 256) -> DataFrame:
    """separable() for long taps, on tiles."""
    t = np.asarray(taps, float)
    return tiled(cells, lambda data: convolve(data, t), len(t) // 2, shape, tile)


def extent(cells: DataFrame, least: tuple[int, int]) -> tuple[int, int]:
    """Rows and columns of a sheet that holds all cells (i, j), and so many at least."""
    far = cells.agg(F.max("i"), F.max("j")).first()
    return max(int(far[0] or 0), least[0]), max(int(far[1] or 0), least[1])


def consolidate(sources: DataFrame, shape: tuple[int, int], sheets: DataFrame | None = None) -> DataFrame:
    """sheet, i, j, z of sheets of shape (rows, columns) from source cells (sheet, i, j, z, file_order): a later source overwrites, missing
    values don't, and what no source has is 0. Without sheets (sheet), all sources are of one, sheet 1."""
    spark = sources.sparkSession
    ny, nx = shape
    if sheets is None:
        sources, sheets = sources.withColumn("sheet", F.lit(1)), spark.range(1).select(F.lit(1).alias("sheet"))
    sheets = sheets.select(F.col("sheet").cast("int").alias("sheet")).distinct()
    there = sources.where("z is not null").where(F.col("i").between(1, ny) & F.col("j").between(1, nx)).join(sheets, "sheet", "left_semi")
    place = [F.col("sheet").cast("int").alias("sheet"), *[F.col(k).cast("long").alias(k) for k in ("i", "j")]]
    last = there.groupBy(*place).agg(F.max_by("z", F.struct("file_order", "z")).alias("z"))
    # Only cells that sources have are shuffled, beside a column 0 of each row: a row is then filled from each of them up to the next one.
    first = sheets.select("sheet", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(ny).cast("long"))).alias("i"), F.lit(0).cast("long").alias("j"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = last.unionByName(first, allowMissingColumns=True).repartition(parts, "sheet", "i")
    known = known.withColumns({"_from": F.greatest("j", F.lit(1)), "_to": F.lead("j", 1, nx + 1).over(along_row()) - 1}).where("_from <= _to")
    cells = known.select("sheet", "i", F.col("j").alias("_own"), "z", F.explode(F.sequence("_from", "_to")).alias("j"))
    return cells.select("sheet", "i", "j", F.coalesce(F.when(F.col("j") == F.col("_own"), F.col("z")), F.lit(0)).alias("z"))


def require_data(cells: DataFrame, fill_empty: bool = False) -> DataFrame:
    """cells, or an error for sheets of zeros alone, unless these are wanted."""
    if fill_empty:
        return cells
    empty = cells.groupBy("sheet").agg(F.max(F.abs("z")).alias("z")).where("z = 0").limit(1).collect()
    if empty:
        raise ValueError(f"sheet {empty[0]['sheet']} has no elevation data")
    return cells


def nonzero_box(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, i0, j0, i1, j1: the box of cells that are neither missing nor zero; zeros where there are none."""
    seen = F.col("z").isNotNull() & (F.col("z") != 0)
    edge = lambda f, k: F.coalesce(f(F.when(seen, F.col(k))), F.lit(0))
    return cells.groupBy(*by).agg(edge(F.min, "i").alias("i0"), edge(F.min, "j").alias("j0"), edge(F.max, "i").alias("i1"), edge(F.max, "j").alias("j1"))


def codec_encode(z: Column, least: float, most: float) -> Column:
    """Grey value 0..255 of elevations in (least, most); 0 elsewhere."""
    return F.when((z <= least) | (z >= most), F.lit(0)).otherwise(F.rint((z - least) / (most - least) * 255)).cast("int")


def codec_decode(grey: Column, z: Column, least: float, most: float) -> Column:
    """z overwritten where grey isn't 0."""
    return F.when(grey > 0, grey * ((most - least) / 255.0) + least).otherwise(z)
