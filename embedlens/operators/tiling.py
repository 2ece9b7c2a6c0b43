"""Tiles of texts and of page images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlens.functions.columns import text_ratio


def stride_of(size: int, overlap: float) -> int:
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    return max(1, round(size * (1 - overlap)))


def starts(side: Column, size: int, stride: int, snap: bool = True) -> Column:
    """Tile starts along an axis: 0, stride, ... and the last snapped to the end; only 0 where the side is no longer than a tile."""
    grid = F.sequence(F.lit(0), F.greatest(side - size, F.lit(0)).cast("int"), F.lit(stride))
    if snap:
        grid = F.array_distinct(F.concat(grid, F.array((side - size).cast("int"))))
    return F.when(side <= size, F.array(F.lit(0))).otherwise(grid)


def tile_grid(df: DataFrame, width: str, height: str, size: int, overlap: float = 0.0) -> DataFrame:
    """Adds x, y: one row for each tile."""
    s = stride_of(size, overlap)
    return df.withColumn("x", F.explode(starts(F.col(width), size, s))).withColumn("y", F.explode(starts(F.col(height), size, s)))


def tile_text(df: DataFrame, key: str, text: str, size: int, overlap: float = 0.0, min_ratio: float = 0.5) -> DataFrame:
    """(key, start, chunk): chunks with enough characters that aren't white space; a page with none gives its centre chunk."""
    t = F.coalesce(F.col(text), F.lit(""))
    tiles = F.transform(starts(F.length(t), size, stride_of(size, overlap)), lambda s: F.struct(s.alias("start"), F.substring(t, s + 1, F.lit(size)).alias("chunk")))
    good = F.filter(tiles, lambda x: (F.length(x["chunk"]) > 0) & (F.coalesce(text_ratio(x["chunk"]), F.lit(0.0)) >= min_ratio))
    centre = F.greatest(F.lit(0), F.floor((F.length(t) - size) / 2)).cast("int")
    kept = F.when(F.size(good) > 0, good).otherwise(F.array(F.struct(centre.alias("start"), F.substring(t, centre + 1, F.lit(size)).alias("chunk"))))
    return df.select(key, F.explode(kept).alias("c")).select(key, F.col("c.start").cast("long").alias("start"), F.col("c.chunk").alias("chunk"))


def bilinear(image: np.ndarray, out: int) -> np.ndarray:
    """(h, w, c) to (out, out, c), sample points at pixel centres."""
    h, w = image.shape[:2]
    ys, xs = (np.clip((np.arange(out) + 0.5) * n / out - 0.5, 0, n - 1) for n in (h, w))
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    f = image.astype(np.float64)
    return (f[y0][:, x0] * (1 - fy) * (1 - fx) + f[y0][:, x1] * (1 - fy) * fx + f[y1][:, x0] * fy * (1 - fx) + f[y1][:, x1] * fy * fx).round().astype(np.uint8)


def _axis(side: int, size: int, stride: int) -> list[int]:
    if side <= size:
        return [0]
    found = list(range(0, side - size + 1, stride))
    return found if found[-1] == side - size else [*found, side - size]


def tile_images(images: DataFrame, size: int = 490, target: int = 224, overlap: float = 0.0, min_ratio: float = 0.05, white: int = 240, centre_only: bool = False) -> DataFrame:
    """(origin, x, y, pixels) of Spark's ``image`` rows. Tiles with too little ink are left out; an image with none gives its centre
    square. A side shorter than a tile is clipped, not padded. Pixels are row-major RGB bytes."""
    stride = stride_of(size, overlap)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for origin, h, w, c, data in frame.itertuples(index=False):
                a = np.frombuffer(data, np.uint8).reshape(h, w, c)[:, :, :3][:, :, ::-1]
                spots = [] if centre_only else [(x, y) for y in _axis(h, size, stride) for x in _axis(w, size, stride)]
                tiles = [(x, y, a[y : y + size, x : x + size]) for x, y in spots]
                tiles = [t for t in tiles if (t[2].mean(2) < white).mean() >= min_ratio]
                if not tiles:
                    s = min(w, h) if centre_only else min(w, h, size)
                    x, y = (w - s) // 2, (h - s) // 2
                    tiles = [(x, y, a[y : y + s, x : x + s])]
                rows += [(origin, x, y, bilinear(t, target).tobytes()) for x, y, t in tiles]
            yield pd.DataFrame(rows, columns=["origin", "x", "y", "pixels"])

    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(run, "origin string, x int, y int, pixels binary")


def blank_images(images: DataFrame, fraction: float, white: int = 255) -> DataFrame:
    """``image`` rows whose leading round(height * fraction) rows of pixels are white."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            blank = [int(np.floor(h * fraction + 0.5)) * w * c for h, w, c in zip(frame["height"], frame["width"], frame["nChannels"])]
            yield frame.assign(data=[bytes([white]) * n + data[n:] for n, data in zip(blank, frame["data"])])

    flat = images.select("image.*")
    return flat.mapInPandas(run, flat.schema).select(F.struct(*flat.columns).alias("image"))


def image_hash(images: DataFrame) -> DataFrame:
    """(origin, hash): a 64-bit perceptual hash: low 8x8 of a 32x32 DCT against its median. The DCT is numpy's matrix product. Images that
    can't be read (no data, or not as much as their sides say) have a null hash."""
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for origin, h, w, c, data in frame.itertuples(index=False):
                if data is None or not h or len(data) != h * w * c:
                    rows.append((origin, None))
                    continue
                grey = np.frombuffer(data, np.uint8).reshape(h, w, c)[:, :, :3].mean(2, keepdims=True)
                low = (basis @ bilinear(grey, 32)[:, :, 0].astype(float) @ basis.T)[:8, :8].reshape(-1)
                bits = (low > np.median(low)).astype(np.uint64)
                rows.append((origin, int((bits << np.arange(64, dtype=np.uint64)).sum().astype(np.int64))))
            yield pd.DataFrame({"origin": [r[0] for r in rows], "hash": pd.array([r[1] for r in rows], "Int64")})

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "origin string, hash long")


def channel_normalize(v: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(v, mean, lambda a, b: a - b), std, lambda a, b: a / b)
