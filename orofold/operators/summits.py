"""Summits: candidates from a sheet's component tree, their prominence in the graph of all sheets, their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graphs


def leaf_cells(tree: DataFrame) -> DataFrame:
    """sheet, id of nodes (sheet, id, parent) that no other names as parent."""
    parents = tree.select("sheet", F.col("parent").alias("id")).distinct()
    return tree.select("sheet", "id").join(parents, ["sheet", "id"], "left_anti")


def leaf_parents(tree: DataFrame) -> DataFrame:
    return tree.join(leaf_cells(tree), ["sheet", "id"], "left_semi").select("sheet", "parent").distinct()


def core_families(tree: DataFrame) -> DataFrame:
    """sheet, parent, children (sorted ids): parents of leaves none of whose children is a parent itself."""
    parents = tree.where("id <> parent").select("sheet", F.col("parent").alias("id")).distinct().withColumn("fertile", F.lit(True))
    kids = tree.where("id <> parent").join(leaf_parents(tree), ["sheet", "parent"], "left_semi").join(parents, ["sheet", "id"], "left")
    return kids.groupBy("sheet", "parent").agg(F.array_sort(F.collect_list("id")).alias("children"), F.count("fertile").alias("fertile")).where("fertile = 0").drop("fertile")


def distinct_summits(tree: DataFrame, cells: DataFrame) -> DataFrame:
    """sheet, id of each family's tallest child where that is above the parent, else of the parent (cells: sheet, id, z)."""
    kids = core_families(tree).select("sheet", "parent", F.explode("children").alias("id")).join(cells.select("sheet", "id", "z"), ["sheet", "id"])
    tallest = kids.groupBy("sheet", "parent").agg(F.max(F.struct("z", (-F.col("id")).alias("minus"))).alias("best"))
    named = tallest.join(cells.select("sheet", F.col("id").alias("parent"), F.col("z").alias("pz")), ["sheet", "parent"])
    return named.select("sheet", F.when(F.col("best.z") > F.col("pz"), -F.col("best.minus")).otherwise(F.col("parent")).alias("id"))


def border_cells(cells: DataFrame, shape: tuple[int, int], sides: list[str]) -> DataFrame:
    """Cells along the given sides of a sheet, corners left out; a side each, so duplicates stay."""
    i, j = F.col("i"), F.col("j")
    on = {"n": i == 1, "s": i == shape[0], "w": j == 1, "e": j == shape[1]}
    inner = {"n": j.between(2, shape[1] - 1), "s": j.between(2, shape[1] - 1), "w": i.between(2, shape[0] - 1), "e": i.between(2, shape[0] - 1)}
    out = None
    for s in sides:
        part = cells.where(on[s] & inner[s])
        out = part if out is None else out.unionAll(part)
    return cells.where("false") if out is None else out


def order_key(z: Column, prominence: Column, level: float = 100.0) -> Column:
    """Prominent summits first, then by height."""
    return z + 10_000 * (prominence > level).cast("int")


def changed(new: DataFrame, old: DataFrame, columns: list[str]) -> bool:
    """Whether two tables differ in the given columns, rows counted."""
    a, b = new.select(*columns), old.select(*columns)
    return not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty()


def matched_leaves(rows: DataFrame, leaves: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """rows (e, n) that are leaves of a graph (e, n) and lie within a box."""
    x0, y0, x1, y1 = box
    return rows.join(leaves.select("e", "n").distinct(), ["e", "n"], "left_semi").where(F.col("e").between(x0, x1) & F.col("n").between(y0, y1))


def with_stress(summits: DataFrame, candidates: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """summits (e, n) with the stress of the last candidate (e, n, stress, written) there, NaN without one, and a name: the
    given one (e, n, name), else "e,n"."""
    stress = candidates.groupBy("e", "n").agg(F.max_by("stress", "written").alias("stress"))
    out = summits.join(stress, ["e", "n"], "left").withColumn("stress", F.coalesce("stress", F.lit(float("nan"))))
    if names is None:
        return out.withColumn("name", F.concat_ws(",", "e", "n"))
    given = names.groupBy("e", "n").agg(F.min(F.when(F.col("name") != "", F.col("name"))).alias("name"))
    return out.join(given, ["e", "n"], "left").withColumn("name", F.coalesce("name", F.concat_ws(",", "e", "n")))


def regional(summits: DataFrame, obscure: float = 50.0, prominent: float = 100.0) -> DataFrame:
    """The summits that count (stress known, prominence from obscure), with rank within their sheet."""
    kept = summits.where(~F.isnan("stress") & (F.col("prominence") >= obscure))
    return graphs.ranked(kept, "sheet", [order_key(F.col("z"), F.col("prominence"), prominent).desc(), F.col("e"), F.col("n")])
