"""Polynomial warps fitted to tie points, and measures of a camera."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import camera

#: The degree that stands for the terms 1, x, y, xy.
QUASILINEAR = -1


def warp_terms(x, y, degree: int) -> list:
    """Terms of a polynomial in x and y, for Columns or arrays."""
    one = F.lit(1.0) if isinstance(x, Column) else np.ones_like(x, dtype=float)
    powers = [(0, 0), (1, 0), (0, 1), (1, 1)] if degree == QUASILINEAR else [(total - j, j) for total in range(degree + 1) for j in range(total + 1)]
    out = []
    for i, j in powers:
        term = one
        for _ in range(i):
            term = term * x
        for _ in range(j):
            term = term * y
        out.append(term)
    return out


def fit_warp(ties: DataFrame, key: str, degree: int) -> DataFrame:
    """Least squares of (u, v) on the terms of (x, y) by key: columns key, n, cu, cv and chi2.

    Sums of products are plain aggregates with partial sums, so ties of one key may be any number; only a matrix a key
    reaches the solver. Too few ties for the terms raise an error.
    """
    if degree < QUASILINEAR:
        raise ValueError("the degree is -1 or more")
    t = warp_terms(F.col("x"), F.col("y"), degree)
    m = len(t)
    full = ties.filter("x IS NOT NULL AND y IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL")
    square = F.array(*(F.sum(t[i] * t[j]) for i in range(m) for j in range(i, m)))
    sums = full.groupBy(key).agg(
        F.count("*").alias("n"), square.alias("a"), *(F.array(*(F.sum(term * F.col(c)) for term in t)).alias(f"s{c}") for c in ("u", "v")),
        (F.sum(F.col("u") * F.col("u")) + F.sum(F.col("v") * F.col("v"))).alias("q"),
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(m)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.n < m:
                    raise ValueError(f"{r.n} tie points are too few for {m} terms")
                a = np.zeros((m, m))
                a[upper] = r.a
                a = a + np.triu(a, 1).T
                cu, cv = np.linalg.solve(a, np.asarray(r.su)), np.linalg.solve(a, np.asarray(r.sv))
                chi2 = r.q - 2 * (cu @ r.su + cv @ r.sv) + cu @ a @ cu + cv @ a @ cv
                out.append((getattr(r, key), r.n, cu.tolist(), cv.tolist(), max(float(chi2), 0.0)))
            yield pd.DataFrame(out, columns=[key, "n", "cu", "cv", "chi2"])

    kind = ties.schema[key].dataType.simpleString()
    return sums.mapInPandas(solve, f"{key} {kind}, n bigint, cu array<double>, cv array<double>, chi2 double")


def apply_warp(x: Column, y: Column, cu: Column, cv: Column, degree: int) -> tuple[Column, Column]:
    t = warp_terms(x, y, degree)
    return tuple(sum((c[i] * term for i, term in enumerate(t)), start=F.lit(0.0)) for c in (cu, cv))


def quad_transform(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> np.ndarray:
    """The 3 x 3 perspective matrix that takes four corners to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def perspective(matrix: np.ndarray, x, y):
    """Columns or arrays through a 3 x 3 matrix; infinite where the weight is nought."""
    a = [[float(v) for v in row] for row in matrix]
    w = a[2][0] * x + a[2][1] * y + a[2][2]
    top = [a[i][0] * x + a[i][1] * y + a[i][2] for i in (0, 1)]
    if isinstance(x, Column):
        return tuple(F.when(w == 0, F.lit(float("inf"))).otherwise(v / F.nullif(w, F.lit(0.0))) for v in top)
    with np.errstate(divide="ignore", invalid="ignore"):
        return tuple(np.where(w == 0, np.inf, v / w) for v in top)


def ground_distance(a: tuple, b: tuple) -> np.ndarray:
    """Metres between (lon, lat, height) points in a straight line on the GRS80 ellipsoid."""

    def centre(lon, lat, h):
        f = 1 / 298.257222101
        e2 = f * (2 - f)
        lo, la = np.radians(lon), np.radians(lat)
        n = 6378137.0 / np.sqrt(1 - e2 * np.sin(la) ** 2)
        return np.stack([(n + h) * np.cos(la) * np.cos(lo), (n + h) * np.cos(la) * np.sin(lo), (n * (1 - e2) + h) * np.sin(la)])

    return np.linalg.norm(centre(*a) - centre(*b), axis=0)


def _from_up(dx: float, dy: float) -> float:
    """Degrees counter-clockwise from the top of the image (lines grow downward); 0 at the nadir, where nothing moves."""
    return float(np.degrees(np.arctan2(-dx, -dy)) % 360) if max(abs(dx), abs(dy)) > 1e-9 else 0.0


def orientation(model: dict, lon: float, lat: float, h: float) -> tuple[float, float]:
    """(up is up, north is up) in degrees at a reference point."""
    at = lambda a, b, c: np.array(camera.project(model, np.array([a]), np.array([b]), np.array([c])))[:, 0]
    base = at(lon, lat, h)
    up, north = at(lon, lat, h + 1000.0) - base, at(lon, lat + 0.01, h) - base
    return _from_up(*up), _from_up(*north)


def measures(model: dict, width: int, height: int, h: float) -> dict[str, float]:
    """Ground sample distances over 100 pixels at the centre, and the image's area by its sides and diagonals."""
    cx, cy, w, l = width / 2, height / 2, width - 1.0, height - 1.0
    s = np.array([cx, cx + 100, cx, 0.0, w, w, 0.0])
    n = np.array([cy, cy, cy + 100, 0.0, 0.0, l, l])
    lon, lat = camera.unproject(model, s, n, np.full(7, h))
    p = [(lon[i : i + 1], lat[i : i + 1], h) for i in range(7)]
    far = lambda i, j: float(ground_distance(p[i], p[j])[0])
    sample, line = far(0, 1) / 100, far(0, 2) / 100
    top, right, bottom, left = far(3, 4), far(4, 5), far(5, 6), far(6, 3)
    inner = 4 * far(3, 5) ** 2 * far(4, 6) ** 2 - (left**2 + right**2 - top**2 - bottom**2) ** 2
    return {"gsd_sample": sample, "gsd_line": line, "gsd": float(np.hypot(sample, line) / np.sqrt(2)), "area_km2": 0.25 * float(np.sqrt(inner)) / 1e6}


def tie_grid(model: dict, width: int, height: int, heights: tuple[float, ...], nx: int = 10, ny: int = 10) -> pd.DataFrame:
    """Image points of a grid with their ground points on surfaces of constant height."""
    s, n, h = (v.ravel() for v in np.meshgrid(np.linspace(0, width - 1, nx), np.linspace(0, height - 1, ny), np.array(heights, float)))
    lon, lat = camera.unproject(model, s, n, h)
    return pd.DataFrame({"sample": s, "line": n, "lon": lon, "lat": lat, "height": h})


def fit_camera(ties: pd.DataFrame, rounds: int = 10, tolerance: float = float(np.finfo(np.float32).eps)) -> dict:
    """A rational polynomial camera through tie points, with ``rmse`` and ``worst`` in pixels.

    Each ratio is linear once multiplied out: 20 + 19 unknowns, weighted by the denominator of the round before, solved
    by singular values.
    """
    model: dict = {}
    unit = {}
    for c, name in (("lon", "LONG"), ("lat", "LAT"), ("height", "HEIGHT"), ("sample", "SAMP"), ("line", "LINE")):
        lo, hi = float(ties[c].min()), float(ties[c].max())
        model[f"{name}_OFF"], model[f"{name}_SCALE"] = (lo + hi) / 2, max((hi - lo) / 2, 1e-9)
        unit[c] = (ties[c].to_numpy(float) - model[f"{name}_OFF"]) / model[f"{name}_SCALE"]
    t = np.stack([np.broadcast_to(v, len(ties)) for v in camera.terms(unit["lon"], unit["lat"], unit["height"])], axis=1)
    for c, name in (("sample", "SAMP"), ("line", "LINE")):
        target, weight, before = unit[c], np.ones(len(ties)), np.inf
        design = np.hstack([t, -target[:, None] * t[:, 1:]])
        for _ in range(rounds):
            found = np.linalg.lstsq(design * weight[:, None], target * weight, rcond=1e-10)[0]
            num, den = found[:20], np.append(1.0, found[20:])
            weight = 1 / np.maximum(np.abs(t @ den), 1e-12)
            residual = float(np.max(np.abs((t @ num) / (t @ den) - target)))
            if residual <= tolerance or abs(before - residual) < 1e-14:
                break
            before = residual
        model[f"{name}_NUM"], model[f"{name}_DEN"] = num.tolist(), den.tolist()
    s, n = camera.project(model, *(ties[c].to_numpy(float) for c in ("lon", "lat", "height")))
    off = np.hypot(s - ties["sample"].to_numpy(float), n - ties["line"].to_numpy(float))
    return model | {"rmse": float(np.sqrt(np.mean(off**2))), "worst": float(off.max())}


def fit_cameras(ties: DataFrame, key: str) -> DataFrame:
    """One camera a key by :func:`fit_camera`. A key's ties are one task's memory: they are a grid of an image, set by the caller."""
    kind = ties.schema[key].dataType.simpleString()
    names = [f"{n}_{k}" for n in ("LONG", "LAT", "HEIGHT", "SAMP", "LINE") for k in ("OFF", "SCALE")]
    lists = [f"{n}_{k}" for n in ("SAMP", "LINE") for k in ("NUM", "DEN")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        model = fit_camera(rows)
        return pd.DataFrame([{key: rows[key].iloc[0], **{c: model[c] for c in (*names, *lists, "rmse", "worst")}}])

    schema = ", ".join([f"{key} {kind}", *(f"{c} double" for c in names), *(f"{c} array<double>" for c in lists), "rmse double", "worst double"])
    return ties.groupBy(key).applyInPandas(run, schema)
