"""Colours: parsing on the driver, and colour ramps as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Color = tuple[int, int, int, int]

# Named colours, and palettes of nine or eleven colours from light to dark.
NAMED = {
    "white": "ffffff", "black": "000000", "red": "ff0000", "lime": "00ff00", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "orange": "ffa500", "purple": "800080",
    "gray": "808080", "grey": "808080", "brown": "a52a2a", "pink": "ffc0cb", "cyan": "00ffff", "magenta": "ff00ff", "lightgreen": "90ee90", "darkgreen": "006400", "lightblue": "add8e6",
    "darkblue": "00008b", "navy": "000080", "teal": "008080", "silver": "c0c0c0", "maroon": "800000", "olive": "808000", "gold": "ffd700", "tan": "d2b48c", "beige": "f5f5dc",
}
PALETTES = {
    "YlOrRd": "ffffcc ffeda0 fed976 feb24c fd8d3c fc4e2a e31a1c bd0026 800026", "YlGnBu": "ffffd9 edf8b1 c7e9b4 7fcdbb 41b6c4 1d91c0 225ea8 253494 081d58",
    "Blues": "f7fbff deebf7 c6dbef 9ecae1 6baed6 4292c6 2171b5 08519c 08306b", "Greens": "f7fcf5 e5f5e0 c7e9c0 a1d99b 74c476 41ab5d 238b45 006d2c 00441b",
    "Reds": "fff5f0 fee0d2 fcbba1 fc9272 fb6a4a ef3b2c cb181d a50f15 67000d", "Greys": "ffffff f0f0f0 d9d9d9 bdbdbd 969696 737373 525252 252525 000000",
    "RdYlGn": "a50026 d73027 f46d43 fdae61 fee08b ffffbf d9ef8b a6d96a 66bd63 1a9850 006837", "Spectral": "9e0142 d53e4f f46d43 fdae61 fee08b ffffbf e6f598 abdda4 66c2a5 3288bd 5e4fa2",
}


def parse(color, alpha: int = 255) -> Color:
    """(r, g, b, a) of a name, hex string, rgb() string or array. An array of four keeps its own alpha."""
    if not isinstance(color, str):
        c = [int(x) for x in color]
        return (*c, alpha) if len(c) == 3 else tuple(c)
    text = color.strip().lower()
    if m := re.fullmatch(r"rgba?\(([^)]*)\)", text):
        c = [float(x) for x in m[1].split(",")]
        return (*(int(x) for x in c[:3]), alpha)
    text = NAMED.get(text, text).lstrip("#")
    if len(text) in (3, 4):
        text = "".join(2 * x for x in text)
    if not re.fullmatch(r"[0-9a-f]{6}([0-9a-f]{2})?", text):
        raise ValueError(f"no colour: {color!r}")
    return (*(int(text[i : i + 2], 16) for i in (0, 2, 4)), alpha)


def palette(scale) -> list[Color]:
    """The colours of a palette's name or of a list."""
    if isinstance(scale, str):
        for name, colors in PALETTES.items():
            if name.lower() == scale.lower():
                return [parse(c) for c in colors.split()]
        raise ValueError(f"no palette: {scale!r}")
    return [parse(c) for c in scale]


def span(low: float | Column, high: float | Column) -> float | Column:
    """high - low, or 1 if they are equal."""
    return F.when(high == low, 1.0).otherwise(high - low) if isinstance(low, Column) else (high - low) or 1


def ramp(v: Column, colors: list[Color], low: float | Column, high: float | Column) -> list[Column]:
    """r, g, b of a value: piecewise linear over [low, high], clamped, rounded half up."""
    n = len(colors) - 1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / span(low, high))) * n
    k = F.least(F.floor(t), F.lit(n - 1)) if n else F.lit(0)
    part = t - k
    out = []
    for c in range(3):
        own = F.lit([float(x[c]) for x in colors])
        at = lambda i, own=own: F.get(own, i.cast("int"))
        out.append(F.floor(at(k) + part * (at(F.least(k + 1, F.lit(n))) - at(k)) + 0.5).cast("int"))
    return out
