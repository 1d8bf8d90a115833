"""Geodesy and geohash as Column builders: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The geohash alphabet, the sphere of the haversine, the cascade from width in km to precision.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_KM = 6371.0
PRECISION_BY_KM = ((0.00477, 9), (0.0382, 8), (0.2, 7), (1.22, 6), (4.89, 5), (39.1, 4), (156.0, 3))
COARSEST = 2
EARTH_CIRCUMFERENCE_M = 40075016.686


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def geohash_precision(width_km: Column) -> Column:
    out = F.when(width_km <= PRECISION_BY_KM[0][0], PRECISION_BY_KM[0][1])
    for limit, p in PRECISION_BY_KM[1:]:
        out = out.when(width_km <= limit, p)
    return out.otherwise(COARSEST)


def _spread(code: int, odd: bool) -> tuple[int, int]:
    """Longitude and latitude bits of a character's five; characters at odd places begin with latitude."""
    wide, narrow = (code >> 4 & 1) * 4 + (code >> 2 & 1) * 2 + (code & 1), (code >> 3 & 1) * 2 + (code >> 1 & 1)
    return (narrow, wide) if odd else (wide, narrow)


def _letters(odd: bool) -> str:
    """The alphabet in the order of (longitude bits, latitude bits)."""
    return "".join(ALPHABET[code] for code in sorted(range(32), key=lambda code: _spread(code, odd)))


def geohash(lat: Column, lon: Column, precision: Column | int, longest: int = 9) -> Column:
    """The cell of the given precision that holds the point: each character is looked up by its bits of two grid numbers."""
    top = 2**30 - 1
    qx = F.least(F.floor((lon + 180) / 360 * 2**30), F.lit(top)).cast("long")
    qy = F.least(F.floor((lat + 90) / 180 * 2**30), F.lit(top)).cast("long")

    def cell(q: Column) -> Column:
        chars, used_x, used_y = [], 0, 0
        for k in range(longest):
            odd = k % 2 == 1
            nx, ny = (2, 3) if odd else (3, 2)
            used_x, used_y = used_x + nx, used_y + ny
            x = F.shiftright(q["x"], 30 - used_x).bitwiseAND(F.lit(2**nx - 1))
            y = F.shiftright(q["y"], 30 - used_y).bitwiseAND(F.lit(2**ny - 1))
            chars.append(F.substring(F.lit(_letters(odd)), (x * 2**ny + y + 1).cast("int"), F.lit(1)))
        return F.concat(*chars)

    # bound once: filters pushed below an aggregate would repeat the grid numbers for every character
    whole = F.transform(F.array(F.struct(qx.alias("x"), qy.alias("y"))), cell)[0]
    return F.substring(whole, F.lit(1), precision if isinstance(precision, Column) else F.lit(precision))


def geohash_box(cell: Column, longest: int = 12) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) of a geohash of up to ``longest`` characters.

    Each side is a sum of exact binary fractions, one a character; characters that are missing add nothing.
    """

    names = (("min_lon", "max_lon"), ("min_lat", "max_lat"))

    def box(d: Column) -> Column:
        out = {}
        for axis, (low, span) in enumerate(((-180.0, 360.0), (-90.0, 180.0))):
            share, bits = F.lit(0.0), 0
            for k in range(longest):
                bits += 3 if k % 2 == axis else 2
                digit = F.greatest(F.ascii(F.substring(d[f"d{axis}{k % 2}"], k + 1, 1)) - ord("0"), F.lit(0))
                share = share + digit / F.lit(float(2**bits))
            half = d["n"] * 5 / 2
            width = F.pow(F.lit(2.0), -(F.floor(half) if axis else F.ceil(half)))
            out[names[axis][0]], out[names[axis][1]] = F.lit(low) + share * span, F.lit(low) + (share + width) * span
        return F.struct(*(out[c].alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))

    def digits(c: Column) -> Column:
        maps = {f"d{axis}{odd}": "".join(str(_spread(code, odd == 1)[axis]) for code in range(32)) for axis in (0, 1) for odd in (0, 1)}
        return F.struct(F.length(c).alias("n"), *(F.translate(c, ALPHABET, m).alias(n) for n, m in maps.items()))

    return F.transform(F.transform(F.array(cell), digits), box)[0]


def mercator_x(lon: Column) -> Column:
    return lon / 360 + 0.5


def mercator_y(lat: Column) -> Column:
    """Unit-square Mercator, clamped to 0..1."""
    s = F.sin(F.radians(lat))
    y = F.lit(0.5) - 0.25 * F.log((1 + s) / (1 - s)) / F.lit(3.141592653589793)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))


def slippy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = 2**zoom
    x = F.floor((lon + 180) / 360 * n)
    r = F.radians(lat)
    y = F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.lit(3.141592653589793)) / 2 * n)
    return F.greatest(F.lit(0), F.least(x, F.lit(n - 1))), F.greatest(F.lit(0), F.least(y, F.lit(n - 1)))


def slippy_corner(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """(lon, lat) of the north-west corner of a map tile."""
    n = 2**zoom
    return x / n * 360 - 180, F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * y / n))))


def slippy_valid(x: Column, y: Column, zoom: int) -> Column:
    return x.between(0, 2**zoom - 1) & y.between(0, 2**zoom - 1)


def slippy_neighbours(x: Column, y: Column, zoom: int) -> Column:
    """Array of the up to eight map tiles around one; those off the map are left out."""
    around = F.array(*(F.struct((x + i).alias("x"), (y + j).alias("y")) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j))
    return F.filter(around, lambda t: slippy_valid(t["x"], t["y"], zoom))


def slippy_children(x: Column, y: Column) -> Column:
    """Array of the four map tiles one zoom deeper."""
    return F.array(*(F.struct((x * 2 + i).alias("x"), (y * 2 + j).alias("y")) for j in (0, 1) for i in (0, 1)))


def viewport_tiles(west: Column, south: Column, east: Column, north: Column, zoom: int) -> Column:
    """Array of the map tiles that a box meets, edges that only touch included."""
    n = 2**zoom

    def along(low: Column, high: Column) -> Column:
        first, last = (F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("long") for c in (F.ceil(low * n) - 1, F.floor(high * n)))
        return F.sequence(first, last)

    rows = along(mercator_y(north), mercator_y(south))
    return F.flatten(F.transform(along(mercator_x(west), mercator_x(east)), lambda x: F.transform(rows, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def angle_off_north(ul_lon: Column, ul_lat: Column, ll_lon: Column, ll_lat: Column) -> Column:
    """Signed angle in radians from north to the way from a footprint's upper left to its lower left corner."""
    return F.atan2(ul_lon - ll_lon, ll_lat - ul_lat)


def map_gsd(lat: Column, zoom: Column) -> Column:
    """Metres per pixel of a 256-pixel web map."""
    return F.lit(EARTH_CIRCUMFERENCE_M / 256) * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom)


def map_zoom(lat: Column, gsd: Column) -> Column:
    z = F.log2(F.lit(EARTH_CIRCUMFERENCE_M / 256) * F.cos(F.radians(lat)) / gsd)
    return F.greatest(F.lit(0.0), F.least(F.lit(25.0), z))


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360)) - 180


def geocentric(lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in metres on the GRS80 ellipsoid."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    la, lo = F.radians(lat), F.radians(lon)
    n = F.lit(a) / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo) + 0.0, (n * (1 - e2) + h) * F.sin(la)
