"""Mask refinement of windows of bounded size: a window is one row, many are refined at once.

The windows of an Arrow batch lie one after the other in flat arrays, each with a
border of one empty cell, so a cell has its neighbours at fixed steps and no
window touches the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators import raster as R
from folioframe.operators.spatial import CELL, with_cells

#: Area of a window up to which it is one row.
FEW_PIXELS = 512 * 512
#: Cells that lie in the flat arrays at once.
CELLS_AT_ONCE = 1 << 20
#: Fixed value: columns that tell a window from others.
KEY = ["page_id", "block_id", "x1", "y1"]
_LOW = (1 << 40) - 1


def _strips(rgb: DataFrame) -> DataFrame:
    """Pixels of a row of a grid cell as one array, packed as column, r, g, b, v and grey; ``ok`` if each is there once and holds bytes."""
    at = lambda c: F.floor(F.col(c) / F.lit(CELL)).cast("bigint")
    whole = reduce(Column.__and__, [F.col(c).between(0, 255) & (F.col(c).cast("bigint") == F.col(c)) for c in "rgbv"])
    value = lambda c, bits: F.shiftleft(F.col(c).cast("bigint"), bits)
    gray = R.byte(R.luma(F.col("r"), F.col("g"), F.col("b")))
    packed = F.when(whole, F.shiftleft(F.pmod(F.col("x"), F.lit(CELL)).cast("bigint"), 40) + value("r", 32) + value("g", 24) + value("b", 16) + value("v", 8) + gray)
    # a set, so that copies of a pixel stay one
    strips = rgb.groupBy("page_id", at("x").alias("_cx"), at("y").alias("_cy"), "y").agg(F.collect_set(packed).alias("px"), F.count(F.lit(1)).alias("_n"))
    places = F.array_distinct(F.transform("px", lambda p: F.shiftright(p, 40)))
    return strips.withColumn("ok", (F.size("px") == F.col("_n")) & (F.size(places) == F.col("_n"))).drop("_n")


def pack(rgb: DataFrame, windows: DataFrame) -> DataFrame:
    """``(page_id, block_id, x1, y1, width, height, few, px)``: every window that has pixels; those of few bring them along.

    A window is not of few if it is large, comes twice, or has pixels that are null, no bytes or there twice.
    """
    fits = F.col("block_id").isNotNull() & ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) <= FEW_PIXELS) & (F.count(F.lit(1)).over(Window.partitionBy(*KEY)) == 1)
    cells = with_cells(windows.withColumn("_fits", fits), F.col("x1"), F.col("y1"), F.col("x2") - 1, F.col("y2") - 1).drop("_x0", "_y0", "_x1", "_y1")
    met = _strips(rgb).join(cells, ["page_id", "_cx", "_cy"]).where("y >= y1 AND y < y2")
    column = lambda p: F.shiftright(p, 40) + F.col("_cx") * CELL
    here = F.filter("px", lambda p: (column(p) >= F.col("x1")) & (column(p) < F.col("x2")))
    met = met.withColumn("_px", F.when(F.col("_fits") & F.col("ok"), here)).where("_px IS NULL OR size(_px) > 0")
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    place = lambda p: (F.col("y") - F.col("y1")) * width + column(p) - F.col("x1")
    moved = F.transform("_px", lambda p: F.shiftleft(place(p).cast("bigint"), 40) + p.bitwiseAND(F.lit(_LOW)))
    tasks = max(int(rgb.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rgb.sparkSession.sparkContext.defaultParallelism)
    return met.select(*KEY, width.alias("width"), height.alias("height"), "_fits", "ok", moved.alias("_px")).repartition(tasks, *KEY).groupBy(*KEY).agg(
        F.max("width").alias("width"), F.max("height").alias("height"), F.bool_and(F.col("_fits") & F.col("ok")).alias("few"), F.flatten(F.collect_list("_px")).alias("px"))


# --- one batch --------------------------------------------------------------


class Sheet:
    """Windows in flat arrays: the window of a cell, the step to the row below it, and whether it is no border."""

    def __init__(self, width: np.ndarray, height: np.ndarray):
        size = (width + 2) * (height + 2)
        self.n, self.width, self.first = len(width), width, np.cumsum(size) - size
        self.window = np.repeat(np.arange(self.n), size)
        self.step = (width + 2)[self.window]
        self.at = np.arange(len(self.window))
        self.y, self.x = np.divmod(self.at - self.first[self.window], self.step)
        self.inside = (self.y > 0) & (self.y <= height[self.window]) & (self.x > 0) & (self.x <= width[self.window])
        self.above, self.below = np.maximum(self.at - self.step, 0), np.minimum(self.at + self.step, len(self.at) - 1)

    def cell(self, window: np.ndarray, place: np.ndarray) -> np.ndarray:
        y, x = np.divmod(place, self.width[window])
        return self.first[window] + (y + 1) * (self.width[window] + 2) + x + 1

    def grown(self, mask: np.ndarray) -> np.ndarray:
        """By a 3x3 box, within the windows."""
        mask = mask | np.roll(mask, 1) | np.roll(mask, -1)
        return (mask | mask[self.above] | mask[self.below]) & self.inside

    def blobs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Set cells and the number of the 8-connected blob of each: runs of cells, linked to those below them."""
        run = np.cumsum(mask & ~np.roll(mask, 1)) - 1
        cells = np.flatnonzero(mask)
        under = cells + self.step[cells]
        a, b = [], []
        for d in (-1, 0, 1):
            hit = mask[under + d]
            if d:  # with a cell right below, this one is of the same run
                hit = hit & ~mask[under]
            a.append(run[cells[hit]])
            b.append(run[under[hit] + d])
        a, b = np.concatenate(a), np.concatenate(b)
        least = np.arange(run[-1] + 1 if len(run) else 0)
        while True:
            low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
            apart = low != high
            if not apart.any():
                return cells, least[run[cells]]
            a, b = a[apart], b[apart]
            np.minimum.at(least, high[apart], low[apart])
            while (least[least] != least).any():
                least = least[least]

    def merge(self, merged: np.ndarray, cells: np.ndarray, blob: np.ndarray, pred: np.ndarray) -> None:
        """Add every blob that brings the mask closer to ``pred``."""
        gain = np.bincount(blob, weights=np.where(merged[cells], 0, np.where(pred[cells], 1, -1)))
        merged[cells[gain[blob] > 0]] = True

    def fill(self, merged: np.ndarray, pred: np.ndarray) -> None:
        """Fill holes smaller than the second-largest area of the window where that helps; the mask counts as one area."""
        cells, blob = self.blobs(self.inside & ~merged)
        area = np.bincount(blob)
        home = np.zeros(len(area), dtype=np.int64)
        home[blob] = self.window[cells]
        ground = np.bincount(self.window[merged], minlength=self.n)
        holes, with_ground = np.flatnonzero(area), np.flatnonzero(ground)
        window, sizes = np.concatenate([home[holes], with_ground]), np.concatenate([area[holes], ground[with_ground]])
        order = np.lexsort((-sizes, window))
        window, sizes = window[order], sizes[order]
        top, rows = np.unique(window, return_index=True)
        last = np.append(rows[1:], len(window))
        limit = np.zeros(self.n, dtype=np.int64)
        limit[top] = sizes[np.minimum(rows + 1, last - 1)]
        small = area[blob] < limit[self.window[cells]]
        self.merge(merged, cells[small], blob[small], pred)


def _top_colors(counts: np.ndarray, most: int = 3, apart: int = 10, tol: float = 0.001) -> list[int]:
    """:func:`raster.top_colors` of one window, from its counts per grey bin."""
    bins = np.flatnonzero(counts)
    if not len(bins):
        return []
    first, *rest = bins[np.lexsort((bins, -counts[bins]))].tolist()
    total, colors = int(counts.sum()), [first * 256 // 255]
    for b in rest:
        color = b * 256 // 255
        if all(abs(c - color) > apart for c in colors):
            colors.append(color)
        if len(colors) >= most or counts[b] < total * tol:
            break
    return colors


def _thresholds(counts: np.ndarray) -> np.ndarray:
    """:func:`raster.otsu_threshold` of rows of 256 counts."""
    level = np.arange(counts.shape[1])
    w0, s0 = np.cumsum(counts, axis=1), np.cumsum(counts * level, axis=1)
    w1 = w0[:, -1:] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = s0.astype(float) / w0 - (s0[:, -1:] - s0).astype(float) / w1
        score = np.where(counts > 0, np.where(w1 > 0, (w0 * w1) * gap * gap, 0.0), -1.0)
    best = score.max(axis=1, keepdims=True)
    near = score >= best - 0.002
    found = near.argmax(axis=1)
    # scores count by three decimals, halves up, the lowest level of equal ones
    for i in np.flatnonzero(near.sum(axis=1) > 1):
        found[i] = max(np.flatnonzero(near[i]).tolist(), key=lambda k: (Decimal(repr(float(score[i, k]))).quantize(Decimal("0.001"), ROUND_HALF_UP), -k))
    return found


def refine(width: np.ndarray, height: np.ndarray, window: np.ndarray, packed: np.ndarray, inpaint: bool) -> tuple[np.ndarray, ...]:
    """Runs ``window, y, x0, x1`` of the refined masks; ``window`` tells whose the packed pixels are."""
    sheet, n = Sheet(width, height), len(width)
    cell = sheet.cell(window, packed >> 40)
    rgb, v, gray = [(packed >> bits) & 255 for bits in (32, 24, 16)], (packed >> 8) & 255, packed & 255

    def mask_of(on: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(sheet.at), dtype=bool)
        mask[cell[on]] = True
        return mask

    core = mask_of(v > 127)
    core = core & np.roll(core, 1) & np.roll(core, -1)
    seed = (core & core[sheet.above] & core[sheet.below])[cell]
    bins = np.bincount(window[seed] * 256 + gray[seed] * 255 // 256, minlength=n * 256).reshape(n, 256)
    colors = np.full((n, 3), -1)
    for i in range(n):
        found = _top_colors(bins[i])
        colors[i, :len(found)] = found
    candidates, scores, inverted = [], [], []
    for c in colors.T[:, window]:
        high = np.minimum(c + 30, 255)
        candidates.append((gray >= high - 60) & (gray <= high))
    for plane in rgb:
        counts = np.bincount(window * 256 + plane, minlength=n * 256).reshape(n, 256)
        candidates.append(plane > _thresholds(counts)[window])
    for on in candidates:
        plain = np.bincount(window, weights=np.where(on, 255 - v, v), minlength=n)
        inverse = np.bincount(window, weights=np.where(on, v, 255 - v), minlength=n)
        scores.append(np.minimum(plain, inverse))
        inverted.append(inverse < plain)
    scores, inverted = np.array(scores), np.array(inverted)
    scores[:3][colors.T < 0] = np.inf
    # only the best of the three Otsu planes takes part
    chosen = np.vstack([np.tile(np.arange(3)[:, None], n), 3 + scores[3:].argmin(axis=0)])
    own = np.arange(n)
    order = np.argsort(scores[chosen, own], axis=0, kind="stable")
    chosen = np.take_along_axis(chosen, order, axis=0)
    there = np.isfinite(scores[chosen, own])

    pred = mask_of(v > 60)
    pred = pred & np.roll(pred, 1) & np.roll(pred, -1) & pred[sheet.above] & pred[sheet.below]
    candidates, pixel = np.array(candidates), np.arange(len(window))
    merged = np.zeros(len(sheet.at), dtype=bool)
    for place, held in zip(chosen, there):
        on = candidates[place[window], pixel] != inverted[place, own][window]
        cells, blob = sheet.blobs(mask_of(on & held[window]))
        if len(cells):
            box = []
            for axis in (sheet.x, sheet.y):
                low, high = np.full(blob.max() + 1, len(sheet.at)), np.full(blob.max() + 1, -1)
                np.minimum.at(low, blob, axis[cells])
                np.maximum.at(high, blob, axis[cells])
                box.append(high - low + 1)
            worth = (box[0] * box[1] >= 3)[blob]
            sheet.merge(merged, cells[worth], blob[worth], pred)
        if inpaint:
            merged = sheet.grown(sheet.grown(merged))
        sheet.fill(merged, pred)
    start, end = np.flatnonzero(merged & ~np.roll(merged, 1)), np.flatnonzero(merged & ~np.roll(merged, -1))
    return sheet.window[start], sheet.y[start] - 1, sheet.x[start] - 1, sheet.x[end] - 1


def refined(packed: DataFrame, inpaint: bool) -> DataFrame:
    """Runs ``(page_id, y, x0, x1)`` of the refined masks of packed windows, which may overlap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, height, x1, y1 = (batch[c].to_numpy().astype(np.int64) for c in ("width", "height", "x1", "y1"))
            lot = np.cumsum((width + 2) * (height + 2)) // CELLS_AT_ONCE
            for k in np.unique(lot):
                rows = np.flatnonzero(lot == k)
                px = batch["px"].slice(rows[0], len(rows))
                window = np.repeat(np.arange(len(rows)), px.value_lengths().to_numpy())
                at, y, left, right = refine(width[rows], height[rows], window, px.flatten().to_numpy(), inpaint)
                at = rows[at]
                yield pa.RecordBatch.from_arrays([batch["page_id"].take(pa.array(at)), *(pa.array(c) for c in (y + y1[at], left + x1[at], right + x1[at]))], names=["page_id", "y", "x0", "x1"])

    kind = packed.schema["page_id"].dataType.simpleString()
    return packed.select("page_id", "x1", "y1", "width", "height", "px").mapInArrow(run, f"page_id {kind}, y bigint, x0 bigint, x1 bigint")
