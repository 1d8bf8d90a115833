"""Polygon rings as Columns: arrays of struct(x, y), open or closed, in either direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def ring_of_wkt(text: Column) -> Column:
    """The outer ring of ``POLYGON ((x y, ...))``; null for any other text."""
    body = F.regexp_extract(text, r"(?i)^\s*POLYGON\s*(?:Z\s*)?\(\s*\(([^()]+)\)", 1)

    def point(part: Column) -> Column:
        xy = F.split(F.trim(part), r"\s+")
        return F.struct(F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y"))

    ring = F.transform(F.split(body, ","), point)
    return F.when((body != "") & ~F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull()), ring)


def ring_of_box(west: Column, south: Column, east: Column, north: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north))


def edges(ring: Column) -> Column:
    """struct(ax, ay, bx, by) from each point to the next; that of a closed ring's repeated point has no length."""
    follow = lambda i: F.get(ring, ((i + 1) % F.size(ring)).cast("int"))
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), follow(i)["x"].alias("bx"), follow(i)["y"].alias("by")))


def signed_area(ring: Column) -> Column:
    """Above nought if the points run counter-clockwise."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times; west and south sides belong to the ring."""

    def crosses(e: Column) -> Column:
        at = e["ax"] + (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0))
        return ((e["ay"] > y) != (e["by"] > y)) & (x < at)

    return F.size(F.filter(edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def _meet(a: Column, b: Column) -> Column:
    """Whether two edges share a point, ends included."""
    side = lambda e, x, y: F.signum((e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]))
    apart = lambda e, f: side(e, f["ax"], f["ay"]) * side(e, f["bx"], f["by"]) <= 0
    near = F.lit(True)
    for c in ("x", "y"):
        low, high = (lambda e, c=c: F.least(e[f"a{c}"], e[f"b{c}"])), (lambda e, c=c: F.greatest(e[f"a{c}"], e[f"b{c}"]))
        near = near & (low(a) <= high(b)) & (low(b) <= high(a))
    return near & apart(a, b) & apart(b, a)


def intersects(a: Column, b: Column) -> Column:
    """Whether two rings share a point, whatever their shape: edges meet, or one ring lies within the other."""
    crossing = F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: _meet(e, f)))
    first = lambda ring: F.get(ring, F.lit(0))
    return crossing | contains(a, first(b)["x"], first(b)["y"]) | contains(b, first(a)["x"], first(a)["y"])


def clip(subject: Column, window: Column) -> Column:
    """The part of a ring inside a convex ring, cut by one of its edges after another; empty if they do not meet."""
    turned = F.when(signed_area(window) < 0, F.reverse(window)).otherwise(window)

    def cut(ring: Column, e: Column) -> Column:
        inside = lambda p: (e["bx"] - e["ax"]) * (p["y"] - e["ay"]) - (e["by"] - e["ay"]) * (p["x"] - e["ax"])

        def step(p: Column, i: Column) -> Column:
            q = F.get(ring, ((i + 1) % F.size(ring)).cast("int"))
            here, there = inside(p), inside(q)
            t = here / F.nullif(here - there, F.lit(0.0))
            at = F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))
            none = F.array().cast(RING)
            return F.concat(F.when(here >= 0, F.array(p)).otherwise(none), F.when((here > 0) & (there < 0) | (here < 0) & (there > 0), F.array(at)).otherwise(none))

        return F.flatten(F.transform(ring, step))

    proper = F.filter(edges(turned), lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))
    return F.aggregate(proper, subject.cast(RING), cut)
