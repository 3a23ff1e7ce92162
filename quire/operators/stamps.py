"""Vectors of stamp images from their pixels: gray, resampled to one size, of length 1."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.python import ready

# Shares of red, green and blue in gray (of 65536), bits of a resampling weight, half-width of its kernel.
GRAY = np.array([19595, 38470, 7471])
WEIGHT_BITS, LOBES = 22, 3
#: Edge of the square that images are resampled to.
SIDE = 64
#: Images that a task resamples at once.
AT_ONCE = 1_000


@lru_cache(maxsize=1024)
def weights(size: int, side: int) -> np.ndarray:
    """side x size: how much each of `size` pixels gives to each of `side`, by a Lanczos kernel that is as wide as a
    pixel of the coarser grid; whole numbers of 2**-WEIGHT_BITS, so that sums of products are exact in doubles."""
    scale = size / side
    wide = max(scale, 1.0)
    centre = (np.arange(side)[:, None] + 0.5) * scale
    place = np.arange(size)[None, :]
    inside = (place >= np.floor(centre - LOBES * wide + 0.5)) & (place < np.floor(centre + LOBES * wide + 0.5))
    t = (place - centre + 0.5) / wide
    w = np.where(inside & (np.abs(t) < LOBES), np.sinc(t) * np.sinc(t / LOBES), 0.0)
    w *= (1 << WEIGHT_BITS) / w.sum(axis=1, keepdims=True)
    return np.trunc(w + np.copysign(0.5, w))


def _bytes(sums: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((sums + (1 << (WEIGHT_BITS - 1))) / (1 << WEIGHT_BITS)), 0, 255)


def vector(rgb: bytes | None, width: int | None, height: int | None, side: int = SIDE) -> np.ndarray | None:
    if rgb is None or not width or not height or min(width, height) < 0 or len(rgb) != 3 * width * height:
        return None
    gray = (np.frombuffer(rgb, dtype=np.uint8).reshape(height, width, 3) @ GRAY + 0x8000) >> 16
    across = _bytes(gray @ weights(width, side).T)
    v = _bytes(weights(height, side) @ across).astype(np.float32).ravel()
    length = np.linalg.norm(v)
    return v / length if length > 0 else v


def vectors(images: list[tuple[bytes | None, int | None, int | None]], side: int = SIDE) -> pa.ListArray:
    """Of images (rgb, width, height), as vector() makes them. Rows of all images of one width are resampled at once, then
    images of one height."""
    known = [k for k, (rgb, w, h) in enumerate(images) if rgb is not None and w and h and min(w, h) > 0 and len(rgb) == 3 * w * h]
    out = np.zeros((len(known), side * side), dtype=np.float32)
    across: dict[int, np.ndarray] = {}
    widths = np.array([images[k][1] for k in known], dtype=np.int64)
    heights = np.array([images[k][2] for k in known], dtype=np.int64)
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        rgb = np.frombuffer(b"".join(images[known[i]][0] for i in own), dtype=np.uint8).reshape(-1, 3)
        red, green, blue = (rgb[:, c].astype(np.int32) * int(GRAY[c]) for c in range(3))
        gray = ((red + green + blue + 0x8000) >> 16).astype(np.float64).reshape(-1, w)
        rows = _bytes(gray @ weights(w, side).T)
        ends = np.cumsum(heights[own])
        across.update(zip(own.tolist(), np.split(rows, ends[:-1]), strict=True))
    for h in np.unique(heights).tolist():
        own = np.flatnonzero(heights == h)
        out[own] = _bytes(weights(h, side) @ np.stack([across[i] for i in own.tolist()])).astype(np.float32).reshape(len(own), -1)
    for row in out:
        length = np.linalg.norm(row)
        if length > 0:
            row /= length
    given = np.zeros(len(images), dtype=np.int64)
    given[known] = side * side
    offsets = pa.array(np.concatenate([[0], np.cumsum(given)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(given == 0))


def stamp_vectors(images: DataFrame, side: int = SIDE) -> DataFrame:
    """(doc_id, img_no, width, height, rgb) -> (doc_id, img_no, v): side * side floats of length 1, row by row.

    rgb holds three bytes a pixel, row by row. Columns are resampled first, then rows, each time to whole bytes. A
    black image has a vector of zeros. An image whose bytes are null or not as many as its size says, or that has no
    pixel, has a null vector. Rows that repeat are taken each; an empty table has no rows. A task holds a batch of
    images and the weights of 1024 sizes.
    """
    ready(images.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in images.schema.fields}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                rows = zip(*(part.column(k).to_pylist() for k in (4, 2, 3)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), vectors(list(rows), side)], names=["doc_id", "img_no", "v"])

    given = images.select("doc_id", "img_no", F.col("width").cast("long"), F.col("height").cast("long"), F.col("rgb").cast("binary"))
    return given.mapInArrow(go, f"doc_id {types['doc_id']}, img_no {types['img_no']}, v array<float>")
