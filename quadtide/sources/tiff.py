"""TIFF files: tags of every image in a file, and the pixels of uncompressed ones."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: bytes and struct code of each field type, and the tags that the pixel reader needs.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
RATIONALS = {5: "I", 10: "i"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, SAMPLE_FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 339


def directories(data: bytes) -> list[dict[int, list]]:
    """The tags of each image of a file, values as lists; text tags hold one string, fractions are divided.

    Anything that is no classic TIFF file, and directories that lie beyond its end, give nothing; a loop of directories ends.
    """
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None or len(data) < 8:
        return []
    out, seen = [], set()
    (at,) = struct.unpack_from(order + "I", data, 4)
    while at and at not in seen and at + 2 <= len(data):
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 2 + 12 * n + 4 > len(data):
            break
        out.append({})
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            code, each = (RATIONALS[kind], 2) if kind in RATIONALS else (TYPES.get(kind), 1)
            if code is None:
                continue
            size = struct.calcsize(code) * count * each
            (where,) = (at + 10 + 12 * i,) if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)
            if where + size > len(data):
                continue
            if kind == 2:
                out[-1][tag] = [data[where : where + size].split(b"\0")[0].decode("latin-1")]
                continue
            values = struct.unpack_from(f"{order}{count * each}{code}", data, where)
            out[-1][tag] = [a / b if b else None for a, b in zip(values[::2], values[1::2], strict=True)] if kind in RATIONALS else list(values)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return out


def pixel_rows(data: bytes, tags: dict[int, list]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(band, row, values) of an uncompressed image in strips; nothing for other ones and for strips beyond the end."""
    width, height = (tags.get(t, [0])[0] for t in (WIDTH, HEIGHT))
    bands, bits = tags.get(SAMPLES, [1])[0], tags.get(BITS, [1])
    kind = {1: "u", 2: "i", 3: "f"}.get(tags.get(SAMPLE_FORMAT, [1])[0])
    if tags.get(COMPRESSION, [1])[0] != 1 or STRIP_OFFSETS not in tags or len(set(bits)) > 1 or bits[0] not in (8, 16, 32, 64) or kind is None or (kind == "f" and bits[0] < 32):
        return
    dtype = np.dtype(f"{'<' if data[:2] == b'II' else '>'}{kind}{bits[0] // 8}")
    apart = tags.get(PLANAR, [1])[0] == 2
    per_strip = max(1, min(tags.get(ROWS_PER_STRIP, [height])[0], height))
    strips, across = -(-height // per_strip), 1 if apart else bands
    for s, at in enumerate(tags[STRIP_OFFSETS][: strips * (bands if apart else 1)]):
        first = s % strips * per_strip
        rows = min(per_strip, height - first)
        if at + rows * width * across * dtype.itemsize > len(data):
            continue
        block = np.frombuffer(data, dtype, rows * width * across, at).reshape(rows, width, across)
        for r in range(rows):
            for b in range(across):
                yield (s // strips if apart else b), first + r, block[r, :, b]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(path, image, tags): a map of tag numbers to their values as texts. A file is one row in memory (2 GB at most)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                for i, tags in enumerate(directories(r.content)):
                    yield pd.DataFrame([(r.path, i, {t: [None if v is None else str(v) for v in vs] for t, vs in tags.items()})], columns=["path", "image", "tags"])

    return _files(spark, path).mapInPandas(run, "path string, image int, tags map<int, array<string>>")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, image, band, row, values) of uncompressed images in strips, values as doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                for i, tags in enumerate(directories(r.content)):
                    for band, row, values in pixel_rows(r.content, tags):
                        yield pd.DataFrame([(r.path, i, band, row, values.astype(float))], columns=["path", "image", "band", "row", "values"])

    return _files(spark, path).mapInPandas(run, "path string, image int, band int, row int, values array<double>")
