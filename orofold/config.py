"""Settings: defaults by section and key, overridden by an INI file and by keywords, read with the default's type."""

from __future__ import annotations

import configparser
import os
import re
from pathlib import Path

#: Fixed values.
DEFAULTS: dict[tuple[str, str], object] = {
    ("printer", "width_mm"): 191,
    ("printer", "height_mm"): 275,
    ("printer", "most_dpi"): 600,
    ("map", "sw_corner"): (35425, 6920995),
    ("map", "sheets"): (3, 4),
    ("map", "density"): 11811,
    ("map", "cell2utm"): 3,
    ("behaviour", "fill_empty"): False,
    ("contour", "thickness_20"): 1,
    ("contour", "thickness_100"): 3,
    ("contour", "thickness_1000"): 5,
    ("contour", "least_length"): 6,
    ("grid", "thickness"): 5,
    ("grid", "spacing"): 1000,
    ("grid", "zone"): 33,
    ("water", "sea_level"): 0.7,
    ("water", "least_area_m2"): 5193,
    ("water", "slope_limit"): 0.015,
    ("water", "slope_radius"): 1,
    ("water", "artifact_limit"): 0.17,
    ("water", "artifact_radius"): 5,
    ("water", "elevation_range"): 1.2,
    ("water", "diagonal"): 2231.0,
    ("water", "flux"): -0.328,
    ("summit", "prominent"): 100.0,
    ("summit", "obscure"): 50.0,
    ("summit", "symbol_prominent"): "in_triangle",
    ("summit", "symbol_obscure"): "on_triangle",
    ("summit", "size_prominent"): 31,
    ("summit", "size_obscure"): 21,
    ("summit", "least_stress"): -5.0,
    ("text", "font_pt"): 10.0,
    ("text", "flip"): 0.85,
}


def parse_pair(text: str) -> tuple[int, int] | None:
    """(a, b) of text like "(12, -3)" or "12 -3"; None if it isn't one."""
    m = re.fullmatch(r"\s*\(?\s*(-?\d+)[,\s]+(-?\d+)\s*\)?\s*", text)
    return (int(m[1]), int(m[2])) if m else None


def _typed(text: str, like: object) -> object:
    text = text.split("#")[0].strip()
    if isinstance(like, bool):
        return text.lower() == "true"
    if isinstance(like, tuple):
        return parse_pair(text)
    try:
        return type(like)(text)
    except ValueError:
        return None


class Settings:
    def __init__(self, file: str | os.PathLike | None = None, **overrides):
        self._ini = configparser.ConfigParser()
        self._overrides = overrides
        if file is not None:
            self._ini.read(file, encoding="utf-8")

    def get(self, section: str, key: str):
        like = DEFAULTS[section, key]
        given = self._overrides.get(f"{section}_{key}")
        if given is not None:
            if type(given) is not type(like) and not (isinstance(like, float) and isinstance(given, int)):
                raise TypeError(f"{section}_{key}: {type(like).__name__} expected")
            return given
        if self._ini.has_option(section, key):
            found = _typed(self._ini.get(section, key), like)
            if found is None:
                raise ValueError(f"[{section}] {key}: {self._ini.get(section, key)!r} isn't a {type(like).__name__}")
            return found
        return like

    @staticmethod
    def write_defaults(file: str | os.PathLike) -> None:
        """A file to edit; one that is there stays as it is."""
        at = Path(file)
        if at.exists():
            return
        ini = configparser.ConfigParser()
        for (section, key), value in DEFAULTS.items():
            if not ini.has_section(section):
                ini.add_section(section)
            ini.set(section, key, str(value).lower() if isinstance(value, bool) else str(value))
        with at.open("w", encoding="utf-8") as f:
            ini.write(f)

    @staticmethod
    def delete(file: str | os.PathLike) -> bool:
        at = Path(file)
        there = at.exists()
        at.unlink(missing_ok=True)
        return there
