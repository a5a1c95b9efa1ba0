"""Collisions of rendered boxes and their placement on a page."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from folioframe.functions import geometry as G
from folioframe.operators.spatial import box_join, with_cells

# Search directions in order, number of rings.
_DIRECTIONS = ((0, -1), (0, 1), (1, 0), (-1, 0), (1, -1), (-1, -1), (1, 1), (-1, 1))
_RINGS = 6


def collisions(boxes: DataFrame, key: str = "block_id") -> DataFrame:
    """Summed overlap area of every box with the earlier boxes of its page."""
    cells = with_cells(boxes, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))

    def strict(l, r):  # noqa: E741
        cross = (l("x1") < r("x2")) & (l("x2") > r("x1")) & (l("y1") < r("y2")) & (l("y2") > r("y1"))
        return (r(key) < l(key)) & cross

    pairs = box_join(cells, cells, strict, ["page_id"])
    w = F.least("l_x2", "r_x2") - F.greatest("l_x1", "r_x1")
    h = F.least("l_y2", "r_y2") - F.greatest("l_y1", "r_y1")
    return pairs.groupBy(F.col("l_page_id").alias("page_id"), F.col(f"l_{key}").alias(key)).agg(
        F.count(F.lit(1)).alias("hits"), F.sum(w * h).alias("overlap"))


def _shared(box: np.ndarray, placed: np.ndarray) -> np.ndarray:
    """Overlap of candidate boxes (n, 4) with all placed ones, summed."""
    low = np.maximum(box[:, None, :2], placed[None, :, :2])
    high = np.minimum(box[:, None, 2:], placed[None, :, 2:])
    return np.clip(high - low, 0, None).prod(axis=2).sum(axis=1)


def _place(boxes, sides, width, height):
    placed = np.empty((0, 4))
    moves = np.array([(dx * ring, dy * ring) for ring in range(1, _RINGS + 1) for dx, dy in _DIRECTIONS], dtype="float64")
    out = []
    for box, side in zip(boxes, sides):
        base = np.asarray(box, dtype="float64")
        free = base[0] >= 0 and base[1] >= 0 and base[2] <= width and base[3] <= height
        cost = float(_shared(base[None], placed)[0])
        shift = np.zeros(2)
        if not free or cost > 0:
            steps = moves * (side * 0.35 + 10.0)
            spots = base[None] + np.concatenate([steps, steps], axis=1)
            inside = (spots[:, :2] >= 0).all(axis=1) & (spots[:, 2] <= width) & (spots[:, 3] <= height)
            price = np.where(inside, _shared(spots, placed), np.inf)
            best = int(np.argmax(price <= np.finfo("float64").eps)) if (price <= np.finfo("float64").eps).any() else int(np.argmin(price))
            if price[best] <= np.finfo("float64").eps or price[best] < cost:
                shift = steps[best]
        spot = base + np.concatenate([shift, shift])
        placed = np.vstack([placed, spot])
        out.append((float(shift[0]), float(shift[1])))
    return out


_SHIFTS = ArrayType(StructType([StructField("block_id", LongType()), StructField("dx", DoubleType()), StructField("dy", DoubleType())]))


@F.pandas_udf(_SHIFTS)
def _place_pages(ids: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, sides: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    pages = []
    for i, a, b, c, d, s, pw, ph in zip(ids, x1, y1, x2, y2, sides, w, h):
        shifts = _place(list(zip(a, b, c, d)), s, pw, ph)
        pages.append([{"block_id": int(k), "dx": dx, "dy": dy} for k, (dx, dy) in zip(i, shifts)])
    return pd.Series(pages)


def place_blocks(blocks: DataFrame) -> DataFrame:
    """Where to draw each block so that it avoids the ones drawn before it.

    ``blocks`` holds ``page_id, block_id, cx, cy, w, h, theta, page_w, page_h``.
    Each spot depends on all earlier ones, so a page is one row; only its boxes
    travel, in block order.
    """
    b = G.rotated_bounds(F.col("w"), F.col("h"), F.col("cx"), F.col("cy"), F.col("theta"))
    boxes = blocks.select("page_id", "block_id", "cx", "cy", "page_w", "page_h", F.greatest("w", "h").cast("double").alias("side"),
                          *[v.cast("double").alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"))])
    pages = boxes.groupBy("page_id").agg(
        F.max("page_w").cast("double").alias("page_w"), F.max("page_h").cast("double").alias("page_h"),
        F.sort_array(F.collect_list(F.struct("block_id", "x1", "y1", "x2", "y2", "side"))).alias("b"))
    shifts = _place_pages(*[F.col(f"b.{c}") for c in ("block_id", "x1", "y1", "x2", "y2", "side")], F.col("page_w"), F.col("page_h"))
    moved = pages.select("page_id", F.inline(shifts))
    return boxes.join(moved, ["page_id", "block_id"]).select(
        "page_id", "block_id", (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y"),
        *[(F.col(c) + F.col("dx" if c[0] == "x" else "dy")).alias(c) for c in ("x1", "y1", "x2", "y2")])
