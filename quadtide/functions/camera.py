"""Rational polynomial cameras: ground to image as Columns, image to ground by vectorised Newton steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# For each RPC00B term the place of the same term in RPC00A's order.
RPC00A_PLACES = (0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 7, 11, 14, 17, 12, 15, 18, 13, 16, 19)


def terms(x, y, z, one=1.0):
    """The twenty cubic terms in the order of the RPC00B standard; x longitude, y latitude, z height."""
    return [one, x, y, z, x * y, x * z, y * z, x * x, y * y, z * z, x * y * z, x * x * x, x * y * y, x * z * z, x * x * y, y * y * y, y * z * z, x * x * z, y * y * z, z * z * z]


def _ratio(num, den, t):
    top = sum((c * v for c, v in zip(num, t, strict=True)), start=0 * t[1])
    return top / sum((c * v for c, v in zip(den, t, strict=True)), start=0 * t[1])


def project(model: dict, lon, lat, height):
    """(sample, line); arguments are Columns or arrays alike."""
    x, y, z = ((v - model[f"{n}_OFF"]) / model[f"{n}_SCALE"] for v, n in ((lon, "LONG"), (lat, "LAT"), (height, "HEIGHT")))
    one = F.lit(1.0) if isinstance(lon, Column) else 1.0
    t = terms(x, y, z, one)
    return tuple(_ratio(model[f"{n}_NUM"], model[f"{n}_DEN"], t) * model[f"{n}_SCALE"] + model[f"{n}_OFF"] for n in ("SAMP", "LINE"))


def unproject(model: dict, sample: np.ndarray, line: np.ndarray, height: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat) of image points at a height, by Newton's method from the model's centre."""
    lon = np.full(len(sample), float(model["LONG_OFF"]))
    lat = np.full(len(sample), float(model["LAT_OFF"]))
    h = 1e-6
    for _ in range(rounds):
        s, n = project(model, lon, lat, height)
        sx, lx = ((a - b) / (2 * h) for a, b in zip(project(model, lon + h, lat, height), project(model, lon - h, lat, height), strict=True))
        sy, ly = ((a - b) / (2 * h) for a, b in zip(project(model, lon, lat + h, height), project(model, lon, lat - h, height), strict=True))
        det = sx * ly - sy * lx
        ds, dl = sample - s, line - n
        lon, lat = lon + (ds * ly - sy * dl) / det, lat + (sx * dl - ds * lx) / det
    return lon, lat


def from_metadata(metadata: Column) -> Column:
    """The camera in an image's metadata, a map of sections to maps of texts (``RPC00B`` to ``LINE_OFF`` and so on).

    Null without a complete RPC00A or RPC00B section, of which RPC00A counts first; its coefficients are put into RPC00B's
    order. Offsets and scales are those of the pixels at hand: a chip (ICHIPB) moves and scales them, a segment of several
    (STDIDB or STDIDC, with IMAGE_TILE_WIDTH and IMAGE_TILE_HEIGHT in section "") moves them by whole blocks. A caller whose
    camera is null may fit one (``operators.warp.fit_camera``).
    """
    section = lambda name: F.try_element_at(metadata, F.lit(name))
    field = lambda tags, name: F.try_element_at(tags, F.lit(name)).try_cast("double")
    old, tags, chip = section("RPC00A").isNotNull(), F.coalesce(section("RPC00A"), section("RPC00B")), section("ICHIPB")
    place = F.coalesce(section("STDIDB"), section("STDIDC"))
    values = {f"{n}_{k}": field(tags, f"{n}_{k}") for n in ("LONG", "LAT", "HEIGHT", "SAMP", "LINE") for k in ("OFF", "SCALE")}
    for n, corner, start, block in (("LINE", "FI_ROW_11", "START_ROW", "IMAGE_TILE_HEIGHT"), ("SAMP", "FI_COL_11", "START_COLUMN", "IMAGE_TILE_WIDTH")):
        scale, move = field(chip, "SCALE_FACTOR"), F.coalesce((field(place, start) - 1) * field(section(""), block), F.lit(0.0))
        off, size = values[f"{n}_OFF"], values[f"{n}_SCALE"]
        values[f"{n}_OFF"] = F.when(chip.isNotNull(), scale * (off - field(chip, corner))).otherwise(off - move)
        values[f"{n}_SCALE"] = F.when(chip.isNotNull(), size * scale).otherwise(size)
    lists = {}
    for n in ("LINE_NUM", "LINE_DEN", "SAMP_NUM", "SAMP_DEN"):
        own = [field(tags, f"{n}_COEFF_{i + 1}") for i in range(20)]
        lists[n] = F.when(old, F.array(*(own[i] for i in RPC00A_PLACES))).otherwise(F.array(*own))
    whole = F.lit(True)
    for v in values.values():
        whole = whole & v.isNotNull()
    for v in lists.values():
        whole = whole & ~F.exists(v, lambda c: c.isNull())
    return F.when(whole, F.struct(*(v.alias(k) for k, v in (values | lists).items())))
