"""Marks and lines on sheets: shapes as offset tables, stamped at cells and clipped."""

from __future__ import annotations

from math import ceil, hypot, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Offset = tuple[int, int]


def _near_line(a: Offset, b: Offset):
    """Within half a cell's diagonal of a stop on the way from a to b; stops are about a cell apart."""
    stops = ceil(hypot(a[0] - b[0], a[1] - b[1])) + 1
    way = [(a[0] + (b[0] - a[0]) * t / max(stops - 1, 1), a[1] + (b[1] - a[1]) * t / max(stops - 1, 1)) for t in range(stops)]
    return lambda i, j: any((x - i) ** 2 + (y - j) ** 2 <= (sqrt(2) / 2) ** 2 for x, y in way)


def _triangle(r: int) -> tuple[Offset, Offset, Offset]:
    foot, half = round(r / 2), round(r * sqrt(3) / 2)
    return (-r, 0), (foot, half), (foot, -half)


def _on_triangle(r: int):
    a, b, c = _triangle(r)
    sides = [_near_line(*s) for s in ((a, b), (b, c), (c, a))]
    return lambda i, j: any(s(i, j) for s in sides)


def _in_triangle(r: int):
    corners = _triangle(r)

    def inside(i: int, j: int) -> bool:
        turns = [(q[0] - p[0]) * (j - p[1]) - (q[1] - p[1]) * (i - p[0]) for p, q in zip(corners, corners[1:] + corners[:1], strict=True)]
        return min(turns) >= 0 or max(turns) <= 0

    return inside


def _on_xcross(r: int):
    one, other = _near_line((-r, -r), (r, r)), _near_line((-r, r), (r, -r))
    return lambda i, j: one(i, j) or other(i, j)


#: A test of (i, j) for a largest offset r.
SHAPES = {
    "on_square": lambda r: lambda i, j: max(abs(i), abs(j)) == r,
    "in_square": lambda r: lambda i, j: True,
    "on_circle": lambda r: lambda i, j: round((r - 0.5) ** 2) <= i * i + j * j <= round((r + 0.5) ** 2),
    "in_circle": lambda r: lambda i, j: i * i + j * j <= round((r + 0.5) ** 2),
    "on_triangle": _on_triangle,
    "in_triangle": _in_triangle,
    "on_hline": lambda r: lambda i, j: i == 0,
    "on_vline": lambda r: lambda i, j: j == 0,
    "on_cross": lambda r: lambda i, j: i == 0 or j == 0,
    "on_xcross": _on_xcross,
}


def offsets(shape: str, side: int) -> list[Offset]:
    """The offsets of a shape of an odd side."""
    if side % 2 == 0:
        raise ValueError("side is odd")
    r = side // 2
    test = SHAPES[shape](r)
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if test(i, j)]


def shape_table(spark: SparkSession, shape: str, side: int) -> DataFrame:
    return spark.createDataFrame(offsets(shape, side), "di int, dj int")


def stamped(marks: DataFrame, shape: str, side: int, size: tuple[int, int]) -> DataFrame:
    """Distinct sheet, i, j that a shape covers at marks (sheet, i, j), clipped to sheets of size (rows, columns)."""
    # A shape has side squared offsets at most, so its table is broadcast to wherever the marks are.
    at = marks.crossJoin(F.broadcast(shape_table(marks.sparkSession, shape, side))).select("sheet", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    return at.where(F.col("i").between(1, size[0]) & F.col("j").between(1, size[1])).distinct()


def lines(ends: DataFrame, tolerance: int, size: tuple[int, int]) -> DataFrame:
    """Distinct sheet, i, j of lines (sheet, i0, j0, i1, j1): a stop a step along the longer axis, as wide as tolerance each way."""
    n = F.greatest(F.abs(F.col("i1") - F.col("i0")), F.abs(F.col("j1") - F.col("j0")))
    at = ends.withColumn("n", n).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long"))))
    along = lambda k: (F.col(f"{k}0") + F.floor((2 * (F.col(f"{k}1") - F.col(f"{k}0")) * F.col("t") + F.col("n")) / F.greatest(2 * F.col("n"), F.lit(1)))).cast("long")
    at = at.select("sheet", along("i").alias("i"), along("j").alias("j"))
    if tolerance:
        r = F.sequence(F.lit(-tolerance), F.lit(tolerance))
        at = at.withColumn("di", F.explode(r)).withColumn("dj", F.explode(r)).select("sheet", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    return at.where(F.col("i").between(1, size[0]) & F.col("j").between(1, size[1])).distinct()


def summit_marks(summits: DataFrame, size: tuple[int, int], levels=(100.0, 50.0), symbols=("in_triangle", "on_triangle"), sides=(31, 21)) -> DataFrame:
    """Distinct sheet, i, j of the marks of summits (sheet, i, j, prominence): prominent ones from the first level, obscure ones
    from the second, these drawn three times, a cell apart, for a bolder line."""
    big = summits.where(F.col("prominence") >= levels[0])
    small = summits.where((F.col("prominence") >= levels[1]) & (F.col("prominence") < levels[0]))
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 1), (-1, 1))])
    small = small.withColumn("o", F.explode(shift)).select("sheet", (F.col("i") + F.col("o.i")).alias("i"), (F.col("j") + F.col("o.j")).alias("j"))
    return stamped(big, symbols[0], sides[0], size).union(stamped(small, symbols[1], sides[1], size)).distinct()
