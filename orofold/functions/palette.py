"""Colours by elevation and light."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Elevations of the stops, and XYZ colours there in sun and in shadow.
STOPS = (1, 2, 3, 5, 50, 280, 400, 500, 1500)
SUNNY = (
    (0.3226512, 0.3441505, 0.565619), (0.88518596, 0.9, 0.77778375), (0.9741367, 1.0, 0.8988308), (0.8999617, 0.97, 0.575656), (0.8005868, 0.85, 0.58168757),
    (0.5779793, 0.6, 0.6943048), (0.6286453, 0.6620548, 0.75649554), (0.9284835, 0.97471976, 1.0772146), (0.86627734, 0.96879524, 0.5444829),
)
SHADOW = (
    (0.3226512, 0.3441505, 0.565619), (0.19882682, 0.2, 0.34958988), (0.24421817, 0.25, 0.4397158), (0.17501558, 0.19, 0.21608494), (0.22622333, 0.25, 0.22332238),
    (0.19653808, 0.2, 0.308372), (0.113745496, 0.112848, 0.2411178), (0.26034087, 0.2813371, 0.44855928), (0.27235097, 0.29431581, 0.46925232),
)
#: Light from the side: three parts shadow and one sun, black on snow.
SIDE = tuple((0.0, 0.0, 0.0) if k >= len(STOPS) - 2 else tuple(0.75 * s + 0.25 * t for s, t in zip(SHADOW[k], SUNNY[k], strict=True)) for k in range(len(STOPS)))
LIGHTS = (SUNNY, SIDE, SHADOW, SIDE)


def linterp(y1: float, y2: float, x1: float, x2: float, x: float) -> float:
    if not x1 < x2 or not x1 <= x <= x2:
        raise ValueError("x is out of range")
    part = (x - x1) / (x2 - x1)
    return y1 * (1 - part) + y2 * part


def colour(elevation: float, light: int) -> tuple[float, ...]:
    """XYZ of an elevation (m) in light 1..4."""
    step = min(max(round(elevation), STOPS[0]), STOPS[-1])
    k = max(i for i, s in enumerate(STOPS) if s <= step)
    stops = LIGHTS[light - 1]
    if k == len(STOPS) - 1:
        return stops[k]
    return tuple(linterp(a, b, STOPS[k], STOPS[k + 1], step) for a, b in zip(stops[k], stops[k + 1], strict=True))


def palette(spark: SparkSession) -> DataFrame:
    """step (1..1500), light (1..4), x, y, z."""
    rows = [(step, light, *colour(step, light)) for step in range(1, STOPS[-1] + 1) for light in (1, 2, 3, 4)]
    return spark.createDataFrame(rows, "step int, light int, x double, y double, z double")
