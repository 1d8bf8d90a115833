"""Local and screen coordinates as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo

#: Step of the finite differences, in radians.
STEP = 1e-6
MERCATOR_RADIUS = 6378137.0


def metres_per_radian(lon: Column, lat: Column, h: Column) -> tuple[Column, Column]:
    """(east, north) at a point of the ellipsoid, by finite differences."""
    step = math.degrees(STEP)
    base = geo.geocentric(lon, lat, h)

    def far(to: tuple[Column, Column, Column]) -> Column:
        return F.sqrt(sum((F.pow(a - b, F.lit(2)) for a, b in zip(base, to, strict=True)), start=F.lit(0.0))) / STEP

    return far(geo.geocentric(lon + step, lat, h)), far(geo.geocentric(lon, lat + step, h))


def to_local(origin: tuple[Column, Column, Column], lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    """Metres east, north and up of an origin (lon, lat, height)."""
    east, north = metres_per_radian(*origin)
    return F.radians(lon - origin[0]) * east, F.radians(lat - origin[1]) * north, h - origin[2]


def from_local(origin: tuple[Column, Column, Column], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    east, north = metres_per_radian(*origin)
    return origin[0] + F.degrees(x / east), origin[1] + F.degrees(y / north), origin[2] + z


def chip_envelope(lon: Column, lat: Column, radius: Column, out_w: Column, out_h: Column, h: float = 0.0) -> Column:
    """struct(west, south, east, north) around a point: the radius holds for the short side of the chip, the long one grows with it."""
    short, origin = F.least(out_w, out_h), (lon, lat, F.lit(h))
    west, south, _ = from_local(origin, -radius * out_w / short, -radius * out_h / short, F.lit(0.0))
    east, north, _ = from_local(origin, radius * out_w / short, radius * out_h / short, F.lit(0.0))
    return F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web-map metres."""
    return F.radians(lon) * MERCATOR_RADIUS, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * MERCATOR_RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(F.atan(F.exp(y / MERCATOR_RADIUS)) * 2 - math.pi / 2)


class View:
    """A screen of ``width`` by ``height`` pixels over a map: its centre in projected units, units a pixel, and its turn
    counter-clockwise in radians. Screen rows run down, clip coordinates from -1 to 1 run right and up. All are Columns."""

    def __init__(self, x: Column, y: Column, unit: Column, width: Column, height: Column, turn: Column | None = None):
        self.x, self.y, self.unit, self.width, self.height = x, y, unit, width, height
        self.turn = F.lit(0.0) if turn is None else turn

    def screen_to_clip(self, sx: Column, sy: Column) -> tuple[Column, Column]:
        return 2 * sx / self.width - 1, 1 - 2 * sy / self.height

    def clip_to_screen(self, cx: Column, cy: Column, slack: float = 1e-9) -> tuple[Column, Column]:
        """Whole pixels; ``slack`` keeps a point that lies on a pixel's corner in that pixel."""
        return F.floor(self.width * (cx + 1) / 2 + slack), F.floor(self.height * (1 - cy) / 2 + slack)

    def clip_to_projected(self, cx: Column, cy: Column) -> tuple[Column, Column]:
        dx, dy = cx * self.width / 2 * self.unit, cy * self.height / 2 * self.unit
        c, s = F.cos(self.turn), F.sin(self.turn)
        return self.x + dx * c - dy * s, self.y + dx * s + dy * c

    def projected_to_clip(self, px: Column, py: Column) -> tuple[Column, Column]:
        dx, dy = (px - self.x) / self.unit, (py - self.y) / self.unit
        c, s = F.cos(self.turn), F.sin(self.turn)
        return (dx * c + dy * s) * 2 / self.width, (dy * c - dx * s) * 2 / self.height

    def screen_to_geodetic(self, sx: Column, sy: Column) -> tuple[Column, Column]:
        return from_mercator(*self.clip_to_projected(*self.screen_to_clip(sx, sy)))

    def geodetic_to_screen(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return self.clip_to_screen(*self.projected_to_clip(*to_mercator(lon, lat)))
