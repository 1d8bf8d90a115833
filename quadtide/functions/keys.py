"""Keys, URLs, requests and stamps of the tile services as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits that other programs rely on.
GUIDE_PATH = r"^[0-9]{4,6}_[0-9a-zA-Z._\-]{1,36}$"
GUIDE_URI = r"^guide://[0-9]{4,6}/[0-9a-zA-Z._\-]{1,36}$"
LINE_CHARS = 7900
LINES_PER_BATCH = 500
IMPORTANCE_AREA, LEAST_IMPORTANCE, MOST_IMPORTANCE = 0.041253, 0.01, 50.0


def metadata_url(url: Column) -> Column:
    """struct(base, collection, timestamp) of ``base/collection/timestamp/metadata.json``; null for any other address."""
    steps = F.split(url, "/")
    n = F.size(steps)
    base = F.array_join(F.slice(steps, F.lit(1), n - 3), "/")
    found = F.struct(base.alias("base"), F.element_at(steps, -3).alias("collection"), F.element_at(steps, -2).alias("timestamp"))
    return F.when((n >= 4) & (F.element_at(steps, -1) == "metadata.json"), found)


def tile_url(path: Column) -> Column:
    """struct(prime, user, image, timestamp, rset, col, row, band) of a tile address, old and new form, with or without user.

    ``prime`` tells that the address only fills the cache. Null if the path addresses no tile.
    """
    pattern = r"^/?(cache/)?(?:([^/]+)/)?([^/]+)/((?!tile/)[^/]+)/(?:tile/)?(\d+)/(\d+)/(\d+)/(-?\d+)\.png$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    user = F.when(part(2) != "", part(2))
    numbers = (part(i).try_cast("int").alias(n) for i, n in ((5, "rset"), (6, "col"), (7, "row"), (8, "band")))
    return F.when(path.rlike(pattern), F.struct((part(1) != "").alias("prime"), user.alias("user"), part(3).alias("image"), part(4).alias("timestamp"), *numbers))


def get_map(query: Column) -> Column:
    """struct of a map request's query string; names count in any case, absent sizes are -1, one time is start and end."""
    pairs = F.transform_keys(F.str_to_map(query, F.lit("&"), F.lit("=")), lambda k, v: F.lower(k))
    text = lambda n: F.try_url_decode(F.try_element_at(pairs, F.lit(n)))
    items = lambda n: F.split(text(n), ",")
    at = lambda i: F.try_to_timestamp(F.try_element_at(items("time"), F.lit(i)), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))
    return F.struct(
        items("layers").alias("layers"), items("styles").alias("styles"), F.coalesce(text("srs"), text("crs")).alias("crs"),
        F.transform(items("bbox"), lambda v: v.try_cast("double")).alias("bbox"),
        *(F.coalesce(text(n).try_cast("int"), F.lit(-1)).alias(n) for n in ("width", "height")),
        text("format").alias("format"), F.coalesce(F.lower(text("transparent")) == "true", F.lit(False)).alias("transparent"),
        at(1).alias("start"), F.coalesce(at(2), at(1)).alias("end"),
    )


def iso_stamp(digits: Column) -> Column:
    """``yyyyMMddHHmmss`` as ``yyyy-MM-ddTHH:mm:ss.000Z``."""
    return F.regexp_replace(digits.cast("string"), r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6.000Z")


def name_uuid(name: Column) -> Column:
    """The version 3 identifier of a name's bytes alone (no namespace), with hyphens."""
    h = F.md5(name.cast("binary"))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    cut = lambda at, n: F.substring(h, at, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("3"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


def paired_token(token: Column) -> Column:
    """struct(prefix, value) around the first colon; null unless both have characters."""
    at = F.instr(token, ":")
    both = F.struct(F.substring(token, F.lit(1), at - 1).alias("prefix"), F.substring(token, at + 1, F.length(token)).alias("value"))
    return F.when((at > 1) & (at < F.length(token)), both)


def summary_key(key: Column) -> Column:
    """struct(location, user) of ``hash#user``; keys without user and those of ``admin`` count for everyone."""
    parts = F.split(key, "#")
    user = F.try_element_at(parts, F.lit(2))
    return F.struct(parts[0].alias("location"), F.when(user.isNull() | (user == "admin"), "global").otherwise(F.lower(user)).alias("user"))


def has_extension(key: Column, allowed: list[str]) -> Column:
    return F.coalesce(F.lower(F.substring_index(key, ".", -1)).isin([a.lower() for a in allowed]) & key.contains("."), F.lit(False))


def bbox_text(*sides: Column) -> Column:
    """Six decimals a side, joined by commas."""
    return F.format_string(",".join(["%.6f"] * len(sides)), *(s.cast("double") for s in sides))


def importance(area: Column) -> Column:
    return F.greatest(F.lit(LEAST_IMPORTANCE), F.least(F.lit(MOST_IMPORTANCE), F.lit(IMPORTANCE_AREA) / area))


def big_endian(data: Column, at: int, size: int, signed: bool = False) -> Column:
    """The integer of up to 7 bytes (8 if signed) that begins ``at`` bytes into binary data; null beyond its end."""
    value = F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("decimal(20,0)")
    if signed:
        value = F.when(value >= 2 ** (8 * size - 1), value - F.lit(2 ** (8 * size)).cast("decimal(20,0)")).otherwise(value)
    return F.when(F.length(data) >= at + size, value.cast("long"))


def telemetry_line(line: Column) -> Column:
    """At most 7,900 characters of a line's base64 text, without line breaks."""
    return F.substring(F.translate(F.base64(line.cast("binary")), "\r\n", ""), 1, LINE_CHARS)


def chip_problem(lon: Column, lat: Column, width: Column, height: Column, image: tuple[Column, Column, Column, Column]) -> Column:
    """Why a chip around a point is not served; null if it is. ``image`` is (west, south, east, north)."""
    west, south, east, north = image
    return (
        F.when((width <= 0) | (height <= 0), "size").when(F.abs(lon) > 180, "longitude").when(F.abs(lat) > 90, "latitude")
        .when((lon < west) | (lon > east) | (lat < south) | (lat > north), "outside")
    )
