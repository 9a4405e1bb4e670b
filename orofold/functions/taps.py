"""Windowed-sinc filter taps."""

from __future__ import annotations

from math import cos, exp, pi, sin


def _checked(n: int, v: float) -> None:
    if n <= 1 or n % 2 == 0 or v <= 1:
        raise ValueError("taps are odd in number, more than one, and the wave length is more than one")


def lowpass(n: int, v: float) -> list[float]:
    """n taps of a sinc that passes wave lengths above 2 v."""
    _checked(n, v)
    w = pi / v
    return [w / pi if k == 0 else sin(w * k) / (pi * k) for k in range(-(n // 2), n // 2 + 1)]


def highpass(n: int, v: float) -> list[float]:
    _checked(n, v)
    return [(1.0 if k == n // 2 else 0.0) - t for k, t in enumerate(lowpass(n, v))]


def blackman(n: int) -> list[float]:
    return [0.42 - 0.5 * cos(2 * pi * k / (n - 1)) + 0.08 * cos(4 * pi * k / (n - 1)) for k in range(n)]


def fir_lowpass(n: int, v: float = 10) -> list[float]:
    """Sums to one."""
    t = [a * b for a, b in zip(lowpass(n, v), blackman(n), strict=True)]
    return [x / sum(t) for x in t]


def fir_highpass(n: int, v: float = 10) -> list[float]:
    return [a * b for a, b in zip(highpass(n, v), blackman(n), strict=True)]


def gaussian(sigma: float) -> list[float]:
    """4 ceil(sigma) + 1 taps that sum to one."""
    half = 2 * int(-(-sigma // 1))
    t = [exp(-k * k / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [x / sum(t) for x in t]
