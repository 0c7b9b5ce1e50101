"""Colour distances over numpy arrays, for steps that compare palettes inside a task.

The same formulas as the column expressions of ``color``; arrays of LAB values
(``[n, 3]``) on both sides, side 1 is the standard.
"""

from __future__ import annotations

import numpy as np


def delta_e76(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(1))


def delta_e94(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """CIE94 with graphic-arts weights."""
    chroma = np.hypot(x[:, 1], x[:, 2])
    gap = x - y
    dc = chroma - np.hypot(y[:, 1], y[:, 2])
    dh2 = np.maximum(gap[:, 1] ** 2 + gap[:, 2] ** 2 - dc**2, 0.0)
    return np.sqrt(gap[:, 0] ** 2 + (dc / (1 + 0.045 * chroma)) ** 2 + dh2 / (1 + 0.015 * chroma) ** 2)


def _saturation(chroma: np.ndarray) -> np.ndarray:
    seventh = chroma**7
    return np.sqrt(seventh / (seventh + 25.0**7))


def delta_e2000(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """CIEDE2000 (Sharma, Wu, Dalal 2005), unit weights."""
    stretch = 1 + 0.5 * (1 - _saturation((np.hypot(x[:, 1], x[:, 2]) + np.hypot(y[:, 1], y[:, 2])) / 2))
    a = np.stack([x[:, 1], y[:, 1]]) * stretch
    b = np.stack([x[:, 2], y[:, 2]])
    c1, c2 = np.hypot(a, b)
    h1, h2 = np.degrees(np.arctan2(b, a)) % 360.0 * ((a != 0) | (b != 0))
    gray = c1 * c2 == 0
    turn = h2 - h1
    apart = np.where(gray, 0.0, turn - 360.0 * (turn > 180.0) + 360.0 * (turn < -180.0))
    total = h1 + h2
    around = np.abs(turn) > 180.0
    hue = np.where(gray, total, (total + np.where(around, np.where(total < 360.0, 360.0, -360.0), 0.0)) / 2)
    chroma, light = (c1 + c2) / 2, ((x[:, 0] + y[:, 0]) / 2 - 50) ** 2
    cos = lambda degrees: np.cos(np.radians(degrees))
    t = 1 - 0.17 * cos(hue - 30) + 0.24 * cos(2 * hue) + 0.32 * cos(3 * hue + 6) - 0.20 * cos(4 * hue - 63)
    dl = (y[:, 0] - x[:, 0]) / (1 + 0.015 * light / np.sqrt(20 + light))
    dc = (c2 - c1) / (1 + 0.045 * chroma)
    dh = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(apart / 2)) / (1 + 0.015 * chroma * t)
    blue = np.sin(np.radians(60 * np.exp(-(((hue - 275) / 25) ** 2))))
    return np.sqrt(np.maximum(dl**2 + dc**2 + dh**2 - 2 * _saturation(chroma) * blue * dc * dh, 0.0))


DELTA_E = {"de76": delta_e76, "de94": delta_e94, "de2000": delta_e2000}
