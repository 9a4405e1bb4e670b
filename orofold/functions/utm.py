"""UTM and geodetic coordinates (WGS84, northern hemisphere): Krueger's series to the third order (millimetres), over named
columns. Each step is a projection of its own, as a single expression would repeat the earlier steps many times over."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, INVERSE_FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 298.257223563, 0.9996, 500000.0
_F = 1 / INVERSE_FLATTENING
_N = _F / (2 - _F)
#: Radius of the sphere of equal meridian length.
RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_BACK = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
_LATITUDE = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)


def zone_of(lat: Column, lon: Column) -> Column:
    """The zone in use at a place, with the wider ones of south-west Norway and Svalbard."""
    plain = F.floor((lon + 180) / 6).cast("int") % 60 + 1
    far = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42), far).otherwise(plain)


def _series(terms, first, second, x: str, y: str) -> Column:
    return sum((t * first(2 * k * F.col(x)) * second(2 * k * F.col(y)) for k, t in enumerate(terms, 1)), F.lit(0.0))


def from_utm(df: DataFrame, e: str, n: str, zone: Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with latitude and longitude in degrees of an easting and a northing in a zone."""
    df = df.withColumns({"_xi": F.col(n) / (SCALE * RADIUS), "_eta": (F.col(e) - FALSE_EASTING) / (SCALE * RADIUS)})
    df = df.withColumns({"_x": F.col("_xi") - _series(_BACK, F.sin, F.cosh, "_xi", "_eta"), "_y": F.col("_eta") - _series(_BACK, F.cos, F.sinh, "_xi", "_eta")})
    df = df.withColumns({"_chi": F.asin(F.sin("_x") / F.cosh("_y")), "_lam": F.atan2(F.sinh("_y"), F.cos("_x"))})
    phi = F.col("_chi") + sum((d * F.sin(2 * k * F.col("_chi")) for k, d in enumerate(_LATITUDE, 1)), F.lit(0.0))
    return df.withColumns({lat: phi * (180 / pi), lon: F.col("_lam") * (180 / pi) + zone * 6 - 183}).drop("_xi", "_eta", "_x", "_y", "_chi", "_lam")


def to_utm(df: DataFrame, lat: str, lon: str, zone: Column, e: str = "e", n: str = "n") -> DataFrame:
    """df with the easting and northing in a zone of a place in degrees."""
    c = 2 * _N**0.5 / (1 + _N)
    df = df.withColumns({"_s": F.sin(F.col(lat) * (pi / 180)), "_lam": (F.col(lon) - (zone * 6 - 183)) * (pi / 180)})
    df = df.withColumn("_t", F.sinh(F.atanh(F.col("_s")) - c * F.atanh(c * F.col("_s"))))
    df = df.withColumns({"_xi": F.atan2(F.col("_t"), F.cos("_lam")), "_eta": F.atanh(F.sin("_lam") / F.sqrt(1 + F.col("_t") * F.col("_t")))})
    north = F.col("_xi") + _series(_FORWARD, F.sin, F.cosh, "_xi", "_eta")
    east = F.col("_eta") + _series(_FORWARD, F.cos, F.sinh, "_xi", "_eta")
    return df.withColumns({e: FALSE_EASTING + SCALE * RADIUS * east, n: SCALE * RADIUS * north}).drop("_s", "_lam", "_t", "_xi", "_eta")


def _fixed(df: DataFrame, *names: str) -> DataFrame:
    """df with columns told by a generator, so that filters on them aren't pushed below it, where they would repeat all steps."""
    rest = [c for c in df.columns if c not in names]
    return df.withColumn("_x", F.explode(F.array(F.struct(*names)))).select(*rest, *[F.col(f"_x.{k}").alias(k) for k in names])


def between_zones(df: DataFrame, e: str, n: str, source: int, target: int) -> DataFrame:
    """df with e and n of one zone replaced by those of another."""
    df = from_utm(df, e, n, F.lit(source), "_lat", "_lon")
    return _fixed(to_utm(df, "_lat", "_lon", F.lit(target), e, n).drop("_lat", "_lon"), e, n)


def to_local(df: DataFrame, e: str, n: str, zone: int, local_e: str = "local_e", local_n: str = "local_n") -> DataFrame:
    """df with the easting and northing in the zone that is in use at each place."""
    df = from_utm(df, e, n, F.lit(zone), "_lat", "_lon").withColumn("_zone", zone_of(F.col("_lat"), F.col("_lon")))
    return _fixed(to_utm(df, "_lat", "_lon", F.col("_zone"), local_e, local_n).drop("_lat", "_lon", "_zone"), local_e, local_n)
