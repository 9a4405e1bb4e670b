"""Vector output: labels as rows, sheets and the linked mosaic as SVG text."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import MapSpec

#: A typographic point in metres; lines are so many font sizes apart.
POINT_M, LINE = 0.0003528, 1.2


def font_px(points: float, density: int) -> int:
    return round(points * POINT_M * density)


def css(points: float, density: int) -> str:
    px = font_px(points, density)
    return f"text {{ font-family: sans-serif; font-size: {px}px; }}\n.small {{ font-size: {round(px * 0.75)}px; }}\n"


def summit_labels(summits: DataFrame, nx: int, flip: float = 0.85) -> DataFrame:
    """sheet if there is one, name, second line "z m (p m)", place and side of each summit (name, z, prominence, i, j): left of it near the eastern edge."""
    text = F.format_string("%d m (%d m)", F.rint("z").cast("long"), F.rint("prominence").cast("long"))
    return summits.select(*[c for c in summits.columns if c == "sheet"], "name", text.alias("second"), "i", "j", F.when(F.col("j") > flip * nx, "end").otherwise("start").alias("anchor"))


def lake_labels(lakes: DataFrame) -> DataFrame:
    """The elevation of each lake (elevation_m, i, j) above the sea."""
    return lakes.where("elevation_m > 1").select(*[c for c in lakes.columns if c == "sheet"], F.format_string("%d m", "elevation_m").alias("text"), "i", "j")


def parts(text: Column) -> Column:
    """Struct (before, inner, after): the first parenthesised part of a label, which is set apart."""
    part = lambda k: F.regexp_extract(text, r"^(.*?)(?:\((.+?)\)(.*))?$", k)
    return F.struct(part(1).alias("before"), part(2).alias("inner"), part(3).alias("after"))


def tiles(sheets: DataFrame, spec: MapSpec, n: int) -> DataFrame:
    """sheet, tile, x, y: the mosaic's square of side n cut into tiles, one a sheet."""
    most = max(spec.nrows, spec.ncols)
    at = lambda k: F.rint(k * (n - 1) / most).cast("int")
    return sheets.select("sheet", F.lit((n - 1) // most).alias("tile"), at(F.col("col") - 1).alias("x"), at(F.lit(spec.nrows) - F.col("row")).alias("y"))


def _text(x: int, y: int, anchor: str, first: str, second: str, px: int) -> str:
    before, _, rest = second.partition("(")
    inner, _, after = rest.partition(")")
    small = f'<tspan class="small">({escape(inner)})</tspan>{escape(after)}' if rest else ""
    return f'<text x="{x}" y="{y}" text-anchor="{anchor}"><tspan>{escape(first)}</tspan><tspan x="{x}" dy="{round(px * LINE)}">{escape(before)}{small}</tspan></text>'


def sheet(spec: MapSpec, image: str, labels: list, points: float = 10.0) -> str:
    """One sheet: its image and two-line labels (name, second, i, j, anchor); labels of one sheet are few."""
    px = font_px(points, spec.density)
    body = "\n".join(_text(r["j"], r["i"], r["anchor"], r["name"], r["second"], px) for r in labels)
    w, h = spec.nx * 1000 / spec.density, spec.ny * 1000 / spec.density
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w:g}mm" height="{h:g}mm" viewBox="0 0 {spec.nx} {spec.ny}">\n<style>\n{css(points, spec.density)}</style>\n<image href={quoteattr(image)} width="{spec.nx}" height="{spec.ny}"/>\n{body}\n</svg>\n'


def pages(spec: MapSpec, sheets: DataFrame, labels: DataFrame, points: float = 10.0) -> DataFrame:
    """sheet, svg: a page a sheet of sheets (sheet) with its labels (sheet, name, second, i, j, anchor), which are few."""

    def run(key, rows):
        own = [r for r in rows.sort_by([("i", "ascending"), ("j", "ascending")]).to_pylist() if r["second"] is not None]
        number = key[0].as_py()
        return pa.table({"sheet": pa.array([number], pa.int32()), "svg": [sheet(spec, f"{number}.png", own, points)]})

    every = sheets.select("sheet").join(labels, "sheet", "left").select("sheet", "name", "second", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "anchor")
    return every.groupBy("sheet").applyInArrow(run, "sheet int, svg string")


def mosaic(rows: list, n: int, link) -> str:
    """The overview: tiles (sheet, tile, x, y) that link to their sheets; link(sheet) -> (page, image)."""
    shade = '<defs><filter id="hover"><feColorMatrix type="saturate" values="0.6"/></filter></defs>'
    body = "\n".join(f'<a href={quoteattr(link(r["sheet"])[0])}><image href={quoteattr(link(r["sheet"])[1])} x="{r["x"]}" y="{r["y"]}" width="{r["tile"]}" height="{r["tile"]}"/></a>' for r in rows)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {n} {n}">\n{shade}\n{body}\n</svg>\n'
