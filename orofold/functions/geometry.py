"""Sheet geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import MapSpec

#: Sides of a sheet in their fixed order, and the step to the neighbour there: (rows north, columns east).
SIDES = {"w": (0, -1), "n": (1, 0), "s": (-1, 0), "e": (0, 1)}


def _div(a: Column, b: int | Column) -> Column:
    return F.floor(a / b).cast("long")


def cell_utm(i: Column, j: Column, sw_e: Column, sw_n: Column, ny: int, cell2utm: int) -> tuple[Column, Column]:
    """Easting and northing of a cell's sample point, its north-west corner; i grows south, j east, from 1."""
    return sw_e + (j - 1) * cell2utm, sw_n + (F.lit(ny) - i + 1) * cell2utm


def sheet_index(e: Column, n: Column, spec: MapSpec) -> tuple[Column, Column]:
    """Row and column of the sheet at (e, n); null outside. A sheet holds its northern edge, not its southern one."""
    row, col = F.ceil((n - spec.sw_n) / spec.sheet_height), F.floor((e - spec.sw_e) / spec.sheet_width) + 1
    there = row.between(1, spec.nrows) & col.between(1, spec.ncols)
    return F.when(there, row.cast("long")), F.when(there, col.cast("long"))


def sheet_number(e: Column, n: Column, spec: MapSpec) -> Column:
    row, col = sheet_index(e, n, spec)
    return row + (col - 1) * spec.nrows


def strict(index: Column) -> Column:
    """index, or an error where it is null."""
    return F.coalesce(index, F.raise_error(F.lit("outside the sheets")).cast("long"))


def cell_index(e: Column, n: Column, spec: MapSpec) -> tuple[Column, Column]:
    """The cell within its sheet, wherever the sheet is."""
    north = spec.sw_n + spec.nrows * spec.sheet_height
    down, right = F.pmod(F.lit(north) - n, F.lit(spec.sheet_height)), F.pmod(e - spec.sw_e, F.lit(spec.sheet_width))
    return _div(down, spec.cell2utm) + 1, _div(right, spec.cell2utm) + 1


def corners(c: int) -> dict[str, Column]:
    """Corners of rows with min_x, min_y, max_x, max_y: external ones at cell edges, internal ones at sample points."""
    x0, y0, x1, y1 = (F.col(k) for k in ("min_x", "min_y", "max_x", "max_y"))
    pair = lambda x, y: F.struct(x.alias("e"), y.alias("n"))
    return {
        "sw": pair(x0, y0), "ne": pair(x1, y1), "nw": pair(x0, y1), "se": pair(x1, y0),
        "sw_internal": pair(x0, y0 + c), "ne_internal": pair(x1 - c, y1), "nw_internal": pair(x0, y1), "se_internal": pair(x1 - c, y0 + c),
    }


def centre(cell2utm: int) -> dict[str, Column]:
    """The middle of a box, and the grid point nearest to it, towards north-east."""
    mx, my = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    return {"centre_x": mx, "centre_y": my, "grid_x": _div(F.col("min_x") + F.col("max_x"), 2), "grid_y": _div(F.col("min_y") + cell2utm + F.col("max_y"), 2)}


def bbox_union() -> list[Column]:
    return [F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")]


def area() -> Column:
    return (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))


def box_wkt() -> Column:
    """A closed ring of the box's corners, from the south-west, counter-clockwise."""
    x0, y0, x1, y1 = (F.col(k).cast("string") for k in ("min_x", "min_y", "max_x", "max_y"))
    sp, c = F.lit(" "), F.lit(", ")
    return F.concat(F.lit("(("), x0, sp, y0, c, x1, sp, y0, c, x1, sp, y1, c, x0, sp, y1, c, x0, sp, y0, F.lit("))"))


def diagonal_wkt() -> Column:
    """The box's diagonal as a degenerate ring: what stands for a raster of zeros alone."""
    x0, y0, x1, y1 = (F.col(k).cast("string") for k in ("min_x", "min_y", "max_x", "max_y"))
    return F.concat(F.lit("(("), x0, F.lit(" "), y0, F.lit(", "), x1, F.lit(" "), y1, F.lit(", "), x0, F.lit(" "), y0, F.lit("))"))


def multipolygon(order: str) -> Column:
    """Aggregate of all boxes' rings in the order of a column."""
    return F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), box_wkt().alias("ring")))), lambda x: x["ring"]), ",\n"), F.lit(")"))


def bbox_text(cell2utm: int) -> Column:
    """The internal box: "(x0 y0)-(x1 y1)"."""
    return F.format_string("(%d %d)-(%d %d)", F.col("min_x"), F.col("min_y") + cell2utm, F.col("max_x") - cell2utm, F.col("max_y"))


def folder_parts(folder: Column) -> Column:
    """row, col and external box of a folder name; negative coordinates keep their sign."""
    n = r"(-?\d+)"
    pattern = rf"{n}-{n}__{n}-{n}__{n}-{n}$"
    names = ("row", "col", "min_x", "min_y", "max_x", "max_y")
    return F.struct(*[F.regexp_extract(folder, pattern, k).try_cast("long").alias(name) for k, name in enumerate(names, 1)])


def overlaps(a: str, b: str) -> Column:
    """Whether two boxes share area: struct or table names with min_x, min_y, max_x, max_y."""
    f = lambda t, k: F.col(f"{t}.{k}")
    return (f(a, "min_x") < f(b, "max_x")) & (f(a, "max_x") > f(b, "min_x")) & (f(a, "min_y") < f(b, "max_y")) & (f(a, "max_y") > f(b, "min_y"))


def overlap_join(left: DataFrame, right: DataFrame, step: int) -> DataFrame:
    """Pairs (struct a, struct b) of overlapping boxes, by an equi-join on the squares of side step that both touch; a pair is
    told in the square of its common south-west corner alone. Boxes should span few squares: step is about their size."""

    def squares(df: DataFrame, name: str) -> DataFrame:
        each = lambda k: F.explode(F.sequence(_div(F.col(f"min_{k}"), step), _div(F.col(f"max_{k}") - 1, step)))
        df = df.where((F.col("min_x") < F.col("max_x")) & (F.col("min_y") < F.col("max_y")))
        return df.select(F.struct(*df.columns).alias(name), each("x").alias("sx"), "min_y", "max_y").withColumn("sy", each("y")).drop("min_y", "max_y")

    pairs = squares(left, "a").join(squares(right, "b"), ["sx", "sy"]).where(overlaps("a", "b"))
    corner = lambda k: _div(F.greatest(F.col(f"a.min_{k}"), F.col(f"b.min_{k}")), step)
    return pairs.where((F.col("sx") == corner("x")) & (F.col("sy") == corner("y"))).select("a", "b")


def grown_box(sides: Column) -> list[Column]:
    """The box (min_x to max_y) a metre wider on all sides that aren't among sides (an array of letters)."""
    step = lambda side: F.when(F.array_contains(sides, side), 0).otherwise(1)
    return [(F.col("min_x") - step("w")).alias("min_x"), (F.col("min_y") - step("s")).alias("min_y"), (F.col("max_x") + step("e")).alias("max_x"), (F.col("max_y") + step("n")).alias("max_y")]


def on_border(e: Column, n: Column) -> Column:
    """Whether a place lies on a side of the box (min_x to max_y), or in line with one."""
    return (e == F.col("min_x")) | (e == F.col("max_x")) | (n == F.col("min_y")) | (n == F.col("max_y"))


def border_sides(row: Column, col: Column, spec: MapSpec) -> Column:
    """The sides on which a sheet has a neighbour, in the order w, n, s, e."""
    there = {"w": col > 1, "n": row < spec.nrows, "s": row > 1, "e": col < spec.ncols}
    return F.array_compact(F.array(*[F.when(there[k], F.lit(k)) for k in SIDES]))


def unit_offset(side: str) -> tuple[int, int]:
    """The step (rows south, columns east) within a matrix towards a side."""
    if side not in SIDES:
        raise ValueError(f"{side!r} isn't one of {', '.join(SIDES)}")
    north, east = SIDES[side]
    return -north, east


def neighbours(sheets: DataFrame) -> DataFrame:
    """sheet, side, neighbour for each pair of sheets that share a side."""
    spark = sheets.sparkSession
    step = spark.createDataFrame([(k, r, c) for k, (r, c) in SIDES.items()], "side string, dr int, dc int")
    other = sheets.select(F.col("sheet").alias("neighbour"), F.col("row").alias("r"), F.col("col").alias("c"))
    asked = sheets.crossJoin(F.broadcast(step)).select("sheet", "side", (F.col("row") + F.col("dr")).alias("r"), (F.col("col") + F.col("dc")).alias("c"))
    return asked.join(other, ["r", "c"]).select("sheet", "side", "neighbour")
