"""Connected regions of cells and what is summed up over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graphs, kernels


def cell_id(ny: int, i: str = "i", j: str = "j") -> Column:
    """Column-major number of a cell, from 1: ties are broken by it."""
    return F.col(i) + (F.col(j) - 1) * ny


def labelled(cells: DataFrame, value: str, ny: int) -> DataFrame:
    """cells with label: the least cell number of the 4-connected cells of equal value (a number or boolean; null joins nothing).

    Regions end at their sheet's edge, and a sheet is of bounded size, so a task labels a sheet."""

    def kernel(data):
        i, j = np.nonzero(~np.isnan(data))
        return {"i": i + 1, "j": j + 1, "label": kernels.connected(data)[i, j]}

    labels = by_sheet(cells.withColumn("_v", F.col(value).cast("double")), kernel, (ny, None), "i long, j long, label long", "_v", np.nan)
    return cells.join(labels, ["sheet", "i", "j"])


def segment_stats(cells: DataFrame, shape: tuple[int, int], value: str = "v") -> DataFrame:
    """sheet, label, n, total, mean index (truncated), box, diagonal, z range and flux of segments (cells: label, z, value).

    flux: the value's sum, 0 for a segment that touches the sheet's border."""
    out = cells.groupBy("sheet", "label").agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.sum("i").alias("si"), F.sum("j").alias("sj"),
        F.min("i").alias("i_min"), F.max("i").alias("i_max"), F.min("j").alias("j_min"), F.max("j").alias("j_max"), F.min("z").alias("z_min"), F.max("z").alias("z_max"),
    )
    edge = (F.col("i_min") == 1) | (F.col("j_min") == 1) | (F.col("i_max") == shape[0]) | (F.col("j_max") == shape[1])
    out = out.withColumns({"mean_i": F.floor(F.col("si") / F.col("n")).cast("long"), "mean_j": F.floor(F.col("sj") / F.col("n")).cast("long"), "flux": F.when(edge, 0).otherwise(F.col("total"))})
    return out.withColumn("diagonal2", (F.col("i_max") - F.col("i_min")) ** 2 + (F.col("j_max") - F.col("j_min")) ** 2).drop("si", "sj")


def adjacency(cells: DataFrame) -> DataFrame:
    """sheet, label, other: segments that share a side, both ways."""
    own = cells.select("sheet", "i", "j", "label")
    right = cells.select("sheet", "i", (F.col("j") - 1).alias("j"), F.col("label").alias("other"))
    down = cells.select("sheet", (F.col("i") - 1).alias("i"), "j", F.col("label").alias("other"))
    half = own.join(right.unionByName(down), ["sheet", "i", "j"]).where("label <> other").select("sheet", "label", "other").distinct()
    return half.unionByName(half.select("sheet", F.col("other").alias("label"), F.col("label").alias("other"))).distinct()


def prune(cells: DataFrame, removed: DataFrame, rank: Column) -> DataFrame:
    """cells with the labels of removed segments (sheet, label) replaced by their neighbour of least rank, an expression over that
    neighbour's n and total (aliased nb); ties go to the lower label. Chains of removed segments end where one isn't removed."""
    stats = cells.groupBy("sheet", "label").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    near = adjacency(cells).join(removed, ["sheet", "label"]).join(stats.withColumnRenamed("label", "other"), ["sheet", "other"])
    to = graphs.kept(near.groupBy("sheet", "label").agg(F.min(F.struct(rank.alias("r"), "other")).alias("x")).select("sheet", "label", F.col("x.other").alias("other")))
    while True:
        step = to.select("sheet", F.col("label").alias("other"), F.col("other").alias("past"))
        # Two that chose each other meet in the lower label.
        past = F.when(F.col("past") == F.col("label"), F.least("label", "other")).otherwise(F.coalesce("past", "other"))
        new = graphs.kept(to.join(step, ["sheet", "other"], "left").select("sheet", "label", F.col("other").alias("was"), past.alias("other")))
        more = new.where("was <> other and other <> label").limit(1).count()
        to = new.select("sheet", "label", "other")
        if not more:
            break
    return cells.join(to, ["sheet", "label"], "left").withColumn("label", F.coalesce("other", "label")).drop("other")


def prune_small(cells: DataFrame, least: int, rounds: int = 3) -> DataFrame:
    """Segments (label; value v) below least cells joined, a few times over, to their neighbour of highest mean."""
    for _ in range(rounds):
        small = cells.groupBy("sheet", "label").agg(F.count("*").alias("n")).where(F.col("n") < least).select("sheet", "label")
        cells = graphs.kept(prune(cells, small, -F.col("total") / F.col("n")))
    return cells


def long_strokes(cells: DataFrame, ny: int, most: int) -> DataFrame:
    """sheet, i, j of marked cells (marked: boolean) in segments of more than most cells."""
    parts = labelled(cells.where("marked"), "marked", ny)
    big = parts.groupBy("sheet", "label").count().where(F.col("count") > most).select("sheet", "label")
    return parts.join(big, ["sheet", "label"], "left_semi").select("sheet", "i", "j")


def by_sheet(cells: DataFrame, kernel, shape: tuple[int, int | None], schema: str, z: str = "z", absent: float = 0.0) -> DataFrame:
    """kernel(array) -> dict of columns, applied to each whole sheet (one task a sheet, as sheets are of bounded size).

    shape: rows and columns; no number of columns: as many as there are."""

    def run(key, rows):
        data = np.full((shape[0], shape[1] or int(rows.column("j").to_numpy().max())), absent)
        data[rows.column("i").to_numpy() - 1, rows.column("j").to_numpy() - 1] = rows.column("z").to_numpy()
        out = kernel(data)
        n = len(next(iter(out.values())))
        return pa.table({"sheet": pa.array(np.full(n, key[0].as_py()), pa.int32()), **{k: pa.array(v, pa.int64()) for k, v in out.items()}})

    return cells.select("sheet", "i", "j", F.col(z).cast("double").alias("z")).groupBy("sheet").applyInArrow(run, f"sheet int, {schema}")


def _grid(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.indices(shape)
    return i.ravel() + 1, j.ravel() + 1


def merged_regions(cells: DataFrame, shape: tuple[int, int], k: float, least: int, z: str = "z") -> DataFrame:
    """sheet, i, j, label of graph-based regions."""

    def kernel(data):
        i, j = _grid(shape)
        return {"i": i, "j": j, "label": kernels.merge_regions(data, k, least).ravel()}

    return by_sheet(cells, kernel, shape, "i long, j long, label long", z)


def thinned(cells: DataFrame, shape: tuple[int, int], marked: str = "marked") -> DataFrame:
    """sheet, i, j of the skeleton of marked cells."""

    def kernel(data):
        i, j = np.nonzero(kernels.thin(data > 0))
        return {"i": i + 1, "j": j + 1}

    return by_sheet(cells.withColumn("m", F.col(marked).cast("int")), kernel, shape, "i long, j long", "m")


def component_tree(cells: DataFrame, shape: tuple[int, int], z: str = "z") -> DataFrame:
    """sheet, id, parent of the component tree of rounded elevations, ids column-major from 1."""

    def kernel(data):
        parent = kernels.component_tree(np.rint(data))
        return {"id": np.arange(1, len(parent) + 1), "parent": parent}

    return by_sheet(cells, kernel, shape, "id long, parent long", z)


def reduced_tree(cells: DataFrame, shape: tuple[int, int], least: float, sides: str, z: str = "z") -> DataFrame:
    """sheet, id, parent of what of each sheet's component tree matters beyond the sheet; parent 0 for roots."""

    def kernel(data):
        ids, parents = kernels.reduced_tree(data, kernels.component_tree(np.rint(data)), least, sides)
        return {"id": ids, "parent": parents}

    return by_sheet(cells, kernel, shape, "id long, parent long", z)
