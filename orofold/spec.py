"""The map job: where it lies, how it is cut into sheets, how large those are printed."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DENSITY = 11811


@dataclass(frozen=True)
class MapSpec:
    """A matrix of nrows by ncols sheets from the south-west corner (sw_e, sw_n), numbered from there, northwards first.

    cell2utm: metres a cell; density: cells a metre of paper."""

    sw_e: int
    sw_n: int
    nrows: int
    ncols: int
    cell2utm: int = 3
    sheet_width_mm: int = 191
    sheet_height_mm: int = 275
    density: int = DENSITY
    path: str = "maps"

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            if name == "path":
                if not value:
                    raise ValueError("path is empty")
            elif not isinstance(value, int) or isinstance(value, bool):
                raise TypeError(f"{name} isn't an integer")
            elif value <= 0 and name not in ("sw_e", "sw_n"):
                raise ValueError(f"{name} isn't positive")

    # -- sizes in cells, metres and millimetres

    @property
    def nx(self) -> int:
        """Columns of a sheet."""
        return self.sheet_width_mm * self.density // 1000

    @property
    def ny(self) -> int:
        """Rows of a sheet."""
        return self.sheet_height_mm * self.density // 1000

    @property
    def sheet_width(self) -> int:
        return self.nx * self.cell2utm

    @property
    def sheet_height(self) -> int:
        return self.ny * self.cell2utm

    @property
    def scale_denominator(self) -> int:
        return self.cell2utm * self.density

    @property
    def paper_mm(self) -> tuple[int, int]:
        """Width and height of all sheets' paper together."""
        return round(self.nx * self.ncols * 1000 / self.density), round(self.ny * self.nrows * 1000 / self.density)

    @property
    def bbox(self) -> tuple[int, int, int, int]:
        """External: the cells' edges."""
        return self.sw_e, self.sw_n, self.sw_e + self.ncols * self.sheet_width, self.sw_n + self.nrows * self.sheet_height

    @property
    def internal_bbox(self) -> tuple[int, int, int, int]:
        """Of sample points, which lie in the cells' north-west corners."""
        x0, y0, x1, y1 = self.bbox
        return x0, y0 + self.cell2utm, x1 - self.cell2utm, y1

    @property
    def area(self) -> int:
        return self.ncols * self.sheet_width * self.nrows * self.sheet_height

    @property
    def centre(self) -> tuple[float, float]:
        x0, y0, x1, y1 = self.bbox
        return (x0 + x1) / 2, (y0 + y1) / 2

    # -- sheets

    def __len__(self) -> int:
        return self.nrows * self.ncols

    def row_col(self, sheet: int) -> tuple[int, int]:
        if not 1 <= sheet <= len(self):
            raise IndexError(sheet)
        return (sheet - 1) % self.nrows + 1, (sheet - 1) // self.nrows + 1

    def sheet_of(self, row: int, col: int) -> int:
        if not (1 <= row <= self.nrows and 1 <= col <= self.ncols):
            raise IndexError((row, col))
        return row + (col - 1) * self.nrows

    def sheet(self, number: int) -> dict:
        row, col = self.row_col(number)
        x0, y0 = self.sw_e + (col - 1) * self.sheet_width, self.sw_n + (row - 1) * self.sheet_height
        folder = f"{row}-{col}__{x0}-{y0}__{x0 + self.sheet_width}-{y0 + self.sheet_height}"
        return {"sheet": number, "row": row, "col": col, "opx": (col - 1) * self.nx, "opy": (self.nrows - row) * self.ny, "min_x": x0, "min_y": y0, "max_x": x0 + self.sheet_width, "max_y": y0 + self.sheet_height, "folder": f"{self.path}/{folder}"}

    def __iter__(self):
        return map(self.sheet, range(1, len(self) + 1))

    def sheets(self, spark: SparkSession) -> DataFrame:
        """sheet, row, col, pixel origin, external corners, folder: a row a sheet."""
        k = F.col("id").cast("int")
        at = spark.range(1, len(self) + 1).select(k.alias("sheet"), ((k - 1) % self.nrows + 1).alias("row"), (F.floor((k - 1) / self.nrows) + 1).cast("int").alias("col"))
        at = at.withColumns({"opx": (F.col("col") - 1) * self.nx, "opy": (F.lit(self.nrows) - F.col("row")) * self.ny})
        at = at.withColumns({"min_x": (F.lit(self.sw_e) + (F.col("col") - 1) * self.sheet_width).cast("long"), "min_y": (F.lit(self.sw_n) + (F.col("row") - 1) * self.sheet_height).cast("long")})
        at = at.withColumns({"max_x": F.col("min_x") + self.sheet_width, "max_y": F.col("min_y") + self.sheet_height})
        return at.withColumn("folder", F.format_string(f"{self.path}/%d-%d__%d-%d__%d-%d", "row", "col", "min_x", "min_y", "max_x", "max_y"))

    def describe(self, spark: SparkSession) -> DataFrame:
        """name, value: what follows from the spec, for people."""
        x0, y0, x1, y1 = self.bbox
        area = f"{self.area / 1e6:.1f} km2" if self.area > 3_000_000 else f"{self.area} m2"
        facts = {"sheets": f"{self.nrows} x {self.ncols}", "cells a sheet": f"{self.nx} x {self.ny}", "extent": f"({x0} {y0})-({x1} {y1})", "area": area, "scale": f"1 : {self.scale_denominator}", "paper mm": "{} x {}".format(*self.paper_mm), "centre": "{} {}".format(*self.centre)}
        return spark.createDataFrame(list(facts.items()), "name string, value string")
