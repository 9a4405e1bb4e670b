"""What is drawn from elevations cell by cell: contours, ridges, relief, grid lines, roughness, composites."""

from __future__ import annotations

from math import cos, log10, pi, sin, sqrt, tanh

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.utm import to_local
from .raster import AROUND, neighbours

# -- contours


def _tooth(x: Column, step) -> Column:
    """Height over the nearest contour: from -step / 2 to step / 2."""
    return F.pmod(x - step / 2, F.lit(float(step))) - step / 2


def contour(cells: DataFrame, step: float, near: float = 3.0) -> DataFrame:
    """sheet, i, j, contour of cells with z, smooth, forest: whether a contour line passes.

    In forest the smoothed surface less 4 m counts, by the share of the nine cells that are forest."""
    around = neighbours(cells.withColumn("c", F.struct("z", "smooth", F.when(F.col("forest") > 0, 1).otherwise(0).alias("f"))), "c")
    cell = {k: F.col("c" if k == "z" else k) for k in AROUND}
    share = sum((v["f"] for v in cell.values()), F.lit(0)) / 9.0
    mixed = around.withColumn("share", share)
    h = {k: F.col("share") * (v["smooth"] - 4.0) + (1 - F.col("share")) * v["z"] for k, v in cell.items()}
    mixed = mixed.select("sheet", "i", "j", *[v.alias(f"h_{k}") for k, v in h.items()])
    g = {k: F.col(f"h_{k}") for k in AROUND}
    side = {k: F.signum(_tooth(g[k], step)) for k in AROUND if k != "z"}
    crossed = [side[a] * side[b] == -1 for a, b in (("w", "e"), ("n", "s"), ("nw", "se"), ("sw", "ne"))]
    steep = [F.abs(g["z"] - g[k]) >= step / 2 for k in ("e", "w", "n", "s")]
    line = F.when(g["z"] < step, False).when(F.abs(_tooth(g["z"], step)) > near, False)
    for s in steep:
        line = line.when(s, False)
    return mixed.select("sheet", "i", "j", line.otherwise(crossed[0] | crossed[1] | crossed[2] | crossed[3]).alias("contour"))


def dilate(marked: DataFrame, r: int, shape: tuple[int, int]) -> DataFrame:
    """Distinct sheet, i, j within r rows and columns of marked cells, on a sheet of shape (rows, columns)."""
    spread = marked.select("sheet", F.explode(F.sequence(F.greatest(F.col("i") - r, F.lit(1)), F.least(F.col("i") + r, F.lit(shape[0])))).alias("i"), "j")
    spread = spread.select("sheet", "i", F.explode(F.sequence(F.greatest(F.col("j") - r, F.lit(1)), F.least(F.col("j") + r, F.lit(shape[1])))).alias("j"))
    return spread.distinct()


# -- ridges

CORNER, CORNER_WIDTH, DIEDER, DIEDER_WIDTH = -0.05, 3, 0.2, 5


def ridge_class(laplacian: Column, forest: Column) -> Column:
    """1: corner, 2: dieder (the later layer wins), 0: neither. Forest counts as flat."""
    v = F.when(forest > 0, 0).otherwise(laplacian)
    return F.when(v > DIEDER, 2).when(v < CORNER, 1).otherwise(0)


def inside_border(i: Column, j: Column, t: int, shape: tuple[int, int]) -> Column:
    """False in the first t and the last t + 1 rows and columns, where filters reflect the edge."""
    return (i > t) & (i < shape[0] - t) & (j > t) & (j < shape[1] - t)


# -- relief

SUN = 202
AZIMUTHS = (SUN, SUN - 240, SUN - 180, SUN - 120)
ELEVATIONS = (9, 30, 30, 30)


def lights() -> list[tuple[float, float, float]]:
    """Unit vectors (east, north, up) towards the four lights."""
    out = []
    for azimuth, elevation in zip(AZIMUTHS, ELEVATIONS, strict=True):
        a, e = azimuth * pi / 180, elevation * pi / 180
        out.append((cos(e) * sin(a), cos(e) * cos(a), sin(e)))
    return out


def normals(cells: DataFrame, z: str = "z") -> DataFrame:
    """sheet, i, j, z, n_east, n_north, n_up: unit normals from central differences."""
    around = neighbours(cells, z)
    we, sn = (F.col("e") - F.col("w")) / 2, (F.col("n") - F.col("s")) / 2
    size = F.sqrt(1 + sn * sn + we * we)
    return around.select("sheet", "i", "j", F.col(z).alias("z"), (-we / size).alias("n_east"), (-sn / size).alias("n_north"), (1 / size).alias("n_up"))


def shade_exponent(z: Column, light: int) -> Column:
    high = 1.2 if light == 3 else 0.4
    part = (z - 400) / 100.0
    return F.when(z <= 400, F.lit(1.2)).when(z < 500, 1.2 * (1 - part) + high * part).otherwise(F.lit(high))


def reflection(light: int) -> Column:
    """min(1, max(0, cosine) ^ exponent) for light 1..4 of cells with normals and z."""
    e, n, u = lights()[light - 1]
    return F.least(F.lit(1.0), F.pow(F.greatest(F.lit(0.0), F.col("n_north") * n + F.col("n_east") * e + F.col("n_up") * u), shade_exponent(F.col("z"), light)))


def relief(cells: DataFrame, palette: DataFrame, z: str = "z") -> DataFrame:
    """sheet, i, j, light, x, y, z: the brightest of the four lights' colours (the first of equals).

    palette: step (1..1500), light, x, y, z; its 6000 rows are broadcast."""
    lit = normals(cells, z).withColumn("step", F.least(F.greatest(F.rint("z"), F.lit(1.0)), F.lit(1500.0)).cast("int"))
    lit = lit.withColumns({f"r{k}": reflection(k) for k in (1, 2, 3, 4)})
    four = palette.groupBy("step").agg(*[F.max(F.when(F.col("light") == k, F.struct("x", "y", "z"))).alias(f"c{k}") for k in (1, 2, 3, 4)])
    told = [F.struct((F.col(f"c{k}.y") * F.col(f"r{k}")).alias("y"), F.lit(-k).alias("order"), (F.col(f"c{k}.x") * F.col(f"r{k}")).alias("x"), (F.col(f"c{k}.z") * F.col(f"r{k}")).alias("z")) for k in (1, 2, 3, 4)]
    best = lit.join(F.broadcast(four), "step").withColumn("best", F.greatest(*told))
    return best.select("sheet", "i", "j", (-F.col("best.order")).alias("light"), F.col("best.x").alias("x"), F.col("best.y").alias("y"), F.col("best.z").alias("z"))


def linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Of sRGB parts 0..1."""
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def lightness(y: Column) -> Column:
    return F.when(y <= 216 / 24389, y * (24389 / 27)).otherwise(F.pow(y, F.lit(1 / 3)) * 116 - 16)


def srgb(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Bytes of XYZ colours (D65), clamped."""
    parts = {"r": 3.2404542 * x - 1.5371385 * y - 0.4985314 * z, "g": -0.9692660 * x + 1.8760108 * y + 0.0415560 * z, "b": 0.0556434 * x - 0.2040259 * y + 1.0572252 * z}
    curve = lambda v: F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    return {k: F.rint(255 * F.least(F.greatest(curve(v), F.lit(0.0)), F.lit(1.0))).cast("int") for k, v in parts.items()}


# -- steepness, artifacts, roughness


def steepness_or(g1: Column, g2: Column, limit: float) -> Column:
    """hypot of the gradient where within limit, else twice the limit: what isn't water."""
    s = F.hypot(g1, g2)
    return F.when(s <= limit, s).otherwise(F.lit(2 * limit))


def tanh_window(x: Column, x0: float, x1: float) -> Column:
    """1 at sqrt(x0 x1), sloping off on both sides of a log axis."""
    if not x0 < x1:
        raise ValueError("x0 < x1 is needed")
    peak = (1 + tanh(log10(sqrt(x0 * x1) / x0))) * (1 - tanh(log10(sqrt(x0 * x1) / x1))) / 4
    return F.when(x > 0, (1 + F.tanh(F.log10(x / x0))) * (1 - F.tanh(F.log10(x / x1))) / 4 / peak).otherwise(F.lit(0.0))


def bumpiness(rough: Column, z: Column, least: float = 0.5, most: float = 3.0, highest: float = 680.0) -> Column:
    """|roughness| of a forest's crowns; 0 above the tree line or out of range."""
    v = F.abs(rough)
    return F.when(z >= highest, 0.0).when((v < least) | (v > most), 0.0).otherwise(v)


# -- grid


def on_grid_line(e: Column, n: Column, spacing: int, thickness: int, legacy: bool = False) -> Column:
    """Whether a local coordinate lies on a line of the grid. legacy: lines lack their upper half."""
    lower, upper = thickness // 2 - 1, spacing - thickness // 2
    hit = lambda x: (F.pmod(x, F.lit(spacing)) >= upper) | (F.lit(not legacy) & (F.pmod(x, F.lit(spacing)) <= lower))
    return hit(e) | hit(n)


def utm_grid(cells: DataFrame, zone: int, spacing: int = 1000, thickness: int = 5) -> DataFrame:
    """cells (e, n) with line: grid lines of the zone in use at each place."""
    local = to_local(cells.withColumns({"_e": F.col("e").cast("double"), "_n": F.col("n").cast("double")}), "_e", "_n", zone)
    whole = local.withColumns({k: F.rint(k).cast("long") for k in ("local_e", "local_n")})
    return whole.withColumn("line", on_grid_line(F.col("local_e"), F.col("local_n"), spacing, thickness)).drop("_e", "_n", "local_e", "local_n")


# -- composites


def over(top: Column, below: Column) -> Column:
    """Structs r g b a (bytes): top laid over below, in whole numbers, rounding half up."""
    rest = F.lit(255) - top["a"]
    mix = lambda k: F.floor((top[k] * top["a"] * 255 + below[k] * below["a"] * rest + 32512) / 65025).cast("int").alias(k)
    return F.struct(mix("r"), mix("g"), mix("b"), F.floor((top["a"] * 255 + below["a"] * rest + 127) / 255).cast("int").alias("a"))


def multiply(top: Column, below: Column) -> Column:
    """top multiplied into below, by top's opacity."""
    mix = lambda k: F.floor((below[k] * (F.lit(65025) - top["a"] * (F.lit(255) - top[k])) + 32512) / 65025).cast("int").alias(k)
    return F.struct(mix("r"), mix("g"), mix("b"), below["a"].alias("a"))


#: From the relief upwards.
LAYERS = (("contour", over), ("ridge", multiply), ("water", over), ("grid", over), ("markers", over))
THUMBNAIL_LAYERS = (("ridge", multiply), ("water", over), ("markers", over))


def composite(relief: DataFrame, layers: dict[str, DataFrame], order=LAYERS) -> DataFrame:
    """sheet, i, j, rgba: sparse layers (sheet, i, j, rgba) folded over the relief; each layer of the order must be given."""
    missing = [k for k, _ in order if k not in layers]
    if missing:
        raise ValueError(f"layers missing: {', '.join(missing)}")
    out = relief.select("sheet", "i", "j", "rgba")
    for name, mode in order:
        out = out.join(layers[name].select("sheet", "i", "j", F.col("rgba").alias("top")), ["sheet", "i", "j"], "left")
        out = out.select("sheet", "i", "j", F.when(F.col("top").isNull(), F.col("rgba")).otherwise(mode(F.col("top"), F.col("rgba"))).alias("rgba"))
    return out
