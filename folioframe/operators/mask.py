"""Mask algebra on horizontal runs.

A mask is ``runs(page_id, y, x0, x1)``, inclusive ends, disjoint within a row.
Text masks hold far fewer runs than pixels, kernels cost one row of a run per
kernel row instead of one pixel per kernel cell, and nothing is ever densified.
Every window below is over one row of one page.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.graph import component_links
from folioframe.session import cut_lineage

_ROW = ["page_id", "y"]


def to_runs(pixels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Set pixels ``(page_id, y, x)`` to runs."""
    w = Window.partitionBy(*_ROW, *keep).orderBy("x")
    island = F.col("x") - F.row_number().over(w)
    return pixels.select(*_ROW, *keep, "x", island.alias("_i")).groupBy(*_ROW, *keep, "_i").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i")


def to_pixels(runs: DataFrame, *keep: str) -> DataFrame:
    return runs.select(*_ROW, *keep, F.explode(F.sequence("x0", "x1")).alias("x"))


def _cover(runs: DataFrame) -> DataFrame:
    """Segments of every row with the number of runs over them."""
    ends = runs.select(*_ROW, F.explode(F.array(
        F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")),
        F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e")).select(*_ROW, "e.*")
    steps = ends.groupBy(*_ROW, "x").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*_ROW).orderBy("x")
    return steps.select(
        *_ROW, F.col("x").alias("x0"), (F.lead("x").over(w) - 1).alias("x1"),
        F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth")).where("x1 IS NOT NULL")


def _glue(segments: DataFrame) -> DataFrame:
    """Join segments of a row that touch."""
    w = Window.partitionBy(*_ROW).orderBy("x0")
    fresh = F.coalesce((F.col("x0") > F.lag("x1").over(w) + 1).cast("int"), F.lit(1))
    marked = segments.select(*_ROW, "x0", "x1", fresh.alias("_f"))
    marked = marked.withColumn("_g", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*_ROW, "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def union(*masks: DataFrame) -> DataFrame:
    """Pixels of any of the masks; the runs of one mask may overlap."""
    rows = masks[0].select(*_ROW, "x0", "x1")
    for m in masks[1:]:
        rows = rows.unionByName(m.select(*_ROW, "x0", "x1"))
    return _glue(_cover(rows).where("depth > 0"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = a.select(*_ROW, "x0", "x1").unionByName(b.select(*_ROW, "x0", "x1"))
    return _glue(_cover(rows).where("depth > 1"))


def difference_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of pixels in exactly one of two masks, per page."""
    rows = a.select(*_ROW, "x0", "x1").unionByName(b.select(*_ROW, "x0", "x1"))
    size = F.sum(F.when(F.col("depth") == 1, F.col("x1") - F.col("x0") + 1).otherwise(0))
    return _cover(rows).groupBy("page_id").agg(size.alias("differ"))


def invert(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """The rest of every page; ``pages(page_id, width, height)``."""
    rows = pages.select("page_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height").cast("bigint") - 1)).alias("y"),
                        F.lit(0).cast("bigint").alias("x0"), (F.col("width").cast("bigint") - 1).alias("x1"))
    both = rows.unionByName(runs.select(*_ROW, "x0", "x1"))
    return _glue(_cover(both).where("depth = 1"))


# --- kernels ----------------------------------------------------------------


def box_kernel(size: int) -> list[tuple[int, int, int]]:
    """Rows ``(dy, left, right)`` of a size x size box around its centre."""
    half = size // 2
    return [(dy, -half, size - 1 - half) for dy in range(-half, size - half)]


def ellipse_kernel(size: int) -> list[tuple[int, int, int]]:
    """Rows of the ellipse inscribed in a size x size box."""
    half = size // 2
    rows = []
    for dy in range(-half, size - half):
        reach = round(half * math.sqrt(max(half * half - dy * dy, 0)) / half) if half else 0
        rows.append((dy, max(-half, -reach), min(size - 1 - half, reach)))
    return rows


def line_dilate_size(text_size: Column, offset: float = 0.0) -> Column:
    """Kernel side of a text line: odd, at least 3."""
    side = F.floor(((text_size + F.lit(float(offset))) * 0.3).cast("int") / F.lit(2)) * 2 + 1
    return F.greatest(side, F.lit(3)).cast("int")


def outline_size(font_size: Column) -> Column:
    return (F.ceil(font_size / F.lit(12.0)) * 2 + 1).cast("int")


def page_kernel_size(width: Column, height: Column) -> Column:
    return (F.greatest(width, height) * 0.025).cast("int")


def dilate(runs: DataFrame, kernel: list[tuple[int, int, int]], pages: DataFrame | None = None) -> DataFrame:
    """Grow by a kernel; with ``pages`` the result is clipped to the page."""
    rows = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(a).alias("a"), F.lit(b).alias("b")) for dy, a, b in kernel])
    grown = runs.withColumn("_k", F.explode(rows)).select(
        "page_id", (F.col("y") + F.col("_k.dy")).alias("y"),
        (F.col("x0") + F.col("_k.a")).alias("x0"), (F.col("x1") + F.col("_k.b")).alias("x1"))
    return union(clip(grown, pages) if pages is not None else grown)


def dilate_sized(runs: DataFrame, size: str, pages: DataFrame) -> DataFrame:
    """Grow every run by the ellipse of its own odd ``size`` column."""
    half = F.floor(F.col(size) / F.lit(2)).cast("bigint")
    reach = F.rint(F.sqrt((F.col("_h") * F.col("_h") - F.col("_d") * F.col("_d")).cast("double"))).cast("bigint")
    grown = runs.withColumn("_h", half).withColumn("_d", F.explode(F.sequence(-F.col("_h"), F.col("_h")))).select(
        "page_id", (F.col("y") + F.col("_d")).alias("y"), (F.col("x0") - reach).alias("x0"), (F.col("x1") + reach).alias("x1"))
    return union(clip(grown, pages))


def dilate_boxed(runs: DataFrame, size: str, pages: DataFrame) -> DataFrame:
    """Grow every run by a box with sides of its own ``size`` column; a size of 0 or 1 changes nothing."""
    sized = runs.withColumn("_s", F.greatest(F.col(size), F.lit(1)).cast("bigint")).withColumn("_h", F.floor(F.col("_s") / F.lit(2)).cast("bigint"))
    far = F.col("_s") - 1 - F.col("_h")
    grown = sized.withColumn("_d", F.explode(F.sequence(-F.col("_h"), far))).select(
        "page_id", (F.col("y") + F.col("_d")).alias("y"), (F.col("x0") - F.col("_h")).alias("x0"), (F.col("x1") + far).alias("x1"))
    return union(clip(grown, pages))


def resize_runs(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nearest resize: a target cell is set if the source cell it maps back to is; ``sizes(page_id, width, height, to_w, to_h)``."""
    first = lambda v, to, size: F.ceil(v * to / size).cast("bigint")
    j = runs.join(sizes.select("page_id", "width", "height", "to_w", "to_h"), "page_id")
    j = j.withColumns({"_y0": first(F.col("y"), F.col("to_h"), F.col("height")), "_y1": first(F.col("y") + 1, F.col("to_h"), F.col("height")) - 1})
    return j.where("_y0 <= _y1").select(
        "page_id", F.explode(F.sequence("_y0", "_y1")).alias("y"), first(F.col("x0"), F.col("to_w"), F.col("width")).alias("x0"),
        (first(F.col("x1") + 1, F.col("to_w"), F.col("width")) - 1).alias("x1")).where("x0 <= x1")


def clip(runs: DataFrame, pages: DataFrame) -> DataFrame:
    j = runs.join(pages.select("page_id", "width", "height"), "page_id")
    return j.where((F.col("y") >= 0) & (F.col("y") < F.col("height"))).select(
        *_ROW, F.greatest("x0", F.lit(0)).cast("bigint").alias("x0"),
        F.least(F.col("x1"), F.col("width") - 1).cast("bigint").alias("x1")).where("x0 <= x1")


def erode(runs: DataFrame, kernel: list[tuple[int, int, int]]) -> DataFrame:
    """Pixels whose whole kernel lies in the mask; outside the page is empty."""
    rows = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(a).alias("a"), F.lit(b).alias("b")) for dy, a, b in kernel])
    shrunk = runs.withColumn("_k", F.explode(rows)).select(
        "page_id", (F.col("y") - F.col("_k.dy")).alias("y"),
        (F.col("x0") - F.col("_k.a")).alias("x0"), (F.col("x1") - F.col("_k.b")).alias("x1")).where("x0 <= x1")
    return _glue(_cover(shrunk).where(F.col("depth") == len(kernel)))


# --- components -------------------------------------------------------------

_BASE = 1 << 32


def components(runs: DataFrame) -> DataFrame:
    """Runs with the ``component`` of their 8-connected blob (its first run).

    Only runs of neighbouring rows are paired, never pixels.
    """
    runs = cut_lineage(runs.select(*_ROW, "x0", "x1").withColumn("run", F.col("y") * _BASE + F.col("x0")))
    below = runs.select("page_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("run").alias("v"))
    touch = (F.col("x0") <= F.col("bx1") + 1) & (F.col("bx0") <= F.col("x1") + 1)
    edges = runs.join(below, _ROW).where(touch).select("page_id", F.col("run").alias("u"), "v")
    links = component_links(edges).select("page_id", F.col("u").alias("run"), F.col("v").alias("_root"))
    return runs.join(links, ["page_id", "run"], "left").withColumn(
        "component", F.coalesce("_root", "run")).drop("_root", "run")


def component_stats(labelled: DataFrame) -> DataFrame:
    """Left, top, width, height and area of every component."""
    return labelled.groupBy("page_id", "component").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


def overlay(labelled: DataFrame, pred: DataFrame, merged: DataFrame) -> DataFrame:
    """Row segments with the component over them and both masks as flags.

    Components of one mask are disjoint, so a running sum of +id and -id tells
    which one is open.
    """
    def ends(df, cid, p, m):
        step = lambda s, x: F.struct(
            x.alias("x"), (cid * s).cast("decimal(38,0)").alias("c"), F.lit(p * s).alias("p"), F.lit(m * s).alias("m"))
        return df.select(*_ROW, F.explode(F.array(step(1, F.col("x0")), step(-1, F.col("x1") + 1))).alias("e")).select(*_ROW, "e.*")

    zero = F.lit(0)
    rows = ends(labelled, F.col("component") + 1, 0, 0).unionByName(ends(pred, zero, 1, 0)).unionByName(ends(merged, zero, 0, 1))
    rows = rows.groupBy(*_ROW, "x").agg(F.sum("c").alias("c"), F.sum("p").alias("p"), F.sum("m").alias("m"))
    w = Window.partitionBy(*_ROW).orderBy("x")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        *_ROW, F.col("x").alias("x0"), (F.lead("x").over(w) - 1).alias("x1"),
        (F.sum("c").over(run) - 1).cast("bigint").alias("component"),
        (F.sum("p").over(run) > 0).alias("pred"), (F.sum("m").over(run) > 0).alias("merged")).where("x1 IS NOT NULL")


def merge_gain(labelled: DataFrame, pred: DataFrame, merged: DataFrame) -> DataFrame:
    """Per component: how much closer to ``pred`` the mask gets by adding it."""
    seg = overlay(labelled, pred, merged).where("component >= 0 AND NOT merged")
    size = F.col("x1") - F.col("x0") + 1
    return seg.groupBy("page_id", "component").agg(F.sum(F.when(F.col("pred"), size).otherwise(-size)).alias("gain"))


def merge_if_better(merged: DataFrame, labelled: DataFrame, pred: DataFrame) -> DataFrame:
    """Add every component that brings the mask closer to ``pred``."""
    good = merge_gain(labelled, pred, merged).where("gain > 0").select("page_id", "component")
    return union(merged, labelled.join(good, ["page_id", "component"], "left_semi"))


def second_largest(stats: DataFrame) -> DataFrame:
    """Second-largest area per page, the largest where there is only one.

    The two top values are enough, so each task keeps two numbers per page.
    """
    first = stats.groupBy("page_id").agg(F.max("area").alias("a1"), F.count(F.lit(1)).alias("n"))
    low = stats.join(first, "page_id").groupBy("page_id").agg(
        F.max("a1").alias("a1"), F.count_if(F.col("area") == F.col("a1")).alias("ties"),
        F.max(F.when(F.col("area") < F.col("a1"), F.col("area"))).alias("a2"))
    return low.select("page_id", F.when(F.col("ties") > 1, F.col("a1")).otherwise(F.coalesce("a2", "a1")).alias("threshold"))


def fill_holes(merged: DataFrame, pred: DataFrame, pages: DataFrame) -> DataFrame:
    """Fill holes smaller than the second-largest area where that helps.

    The areas compared are those of the blobs of the rest of the page and of the
    mask itself, which counts as one.
    """
    merged = cut_lineage(merged)
    holes = cut_lineage(components(invert(merged, pages)))
    stats = component_stats(holes).select("page_id", "component", "area")
    ground = merged.groupBy("page_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    areas = stats.select("page_id", "area").unionByName(ground)
    limit = second_largest(areas)
    small = stats.join(limit, "page_id").where("area < threshold").select("page_id", "component")
    return merge_if_better(merged, holes.join(small, ["page_id", "component"], "left_semi"), pred)


# --- shapes -----------------------------------------------------------------


def fill_boxes(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Mask of boxes ``(page_id, x, y, w, h)``, clipped to the page, ends exclusive."""
    rows = boxes.where("w > 0 AND h > 0").select(
        "page_id", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias("y"),
        F.col("x").alias("x0"), (F.col("x") + F.col("w") - 1).alias("x1"))
    return union(clip(rows, pages))


def polygon_rows(quads: DataFrame, pages: DataFrame, key: str = "quad_id") -> DataFrame:
    """Scanline rows of quads ``pts``: spans between pairs of edge crossings."""
    p = [F.col("pts").getItem(i) for i in range(4)]
    ys = [q["y"] for q in p]
    rows = quads.join(pages.select("page_id", "width", "height"), "page_id").select(
        "page_id", key, "pts", "width", F.explode(F.when(
            F.greatest(F.least(*ys), F.lit(0)) <= F.least(F.greatest(*ys), F.col("height") - 1),
            F.sequence(F.greatest(F.least(*ys), F.lit(0)), F.least(F.greatest(*ys), F.col("height") - 1).cast("bigint")))).alias("y"))
    y = F.col("y")
    crossings = []
    for i in range(4):
        a, b = p[i], p[(i + 1) % 4]
        hit = ((a["y"] <= y) & (y < b["y"])) | ((b["y"] <= y) & (y < a["y"]))
        t = F.try_divide((y - a["y"]).cast("double"), (b["y"] - a["y"]).cast("double"))
        crossings.append(F.when(hit, (a["x"] + t * (b["x"] - a["x"])).cast("bigint")))
    xs = F.sort_array(F.array_compact(F.array(*crossings)))
    last = (F.col("width") - 1).cast("bigint")
    inside = lambda v: F.least(F.greatest(v, F.lit(0)), last)
    pair = F.transform(F.sequence(F.lit(0), F.floor(F.size("_x") / 2).cast("int") - 1), lambda i: F.struct(
        inside(F.get(F.col("_x"), i * 2)).alias("x0"), inside(F.get(F.col("_x"), i * 2 + 1)).alias("x1")))
    return rows.withColumn("_x", xs).where(F.size("_x") >= 2).select("page_id", key, "y", F.inline(pair))


def fill_polygons(quads: DataFrame, pages: DataFrame) -> DataFrame:
    return union(polygon_rows(quads, pages))


# --- growth by rings --------------------------------------------------------

# Neighbours (dy, dx) of the corners top-left, bottom-left,
# top-right and bottom-right.
_DIAGONALS = {"d1": ((-1, -1), (-1, 0), (0, -1)), "d2": ((1, -1), (1, 0), (0, -1)),
              "d3": ((-1, 1), (-1, 0), (0, 1)), "d4": ((1, 1), (1, 0), (0, 1))}
#: Columns of a page whose rings are found together.
STRIP = 64
_FAR = np.iinfo(np.int32).max // 2


def _strip_rings(top: int, bottom: int, left: int, right: int, y, a, b, x0, x1, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rings of the columns ``left..right`` and rows ``top..bottom`` (ends inclusive), and which pixels are unknown.

    ``a..b`` is the part of the unknown run ``x0..x1`` in these columns. The first
    pass gives each pixel its way to the ends of its run, the second takes the
    best row above or below: the larger of the way there and of the way in it.
    """
    ring = np.zeros((bottom - top + 1, right - left + 1), dtype=np.int32)
    n = b - a + 1
    rows = np.repeat(y - top, n)
    x = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
    to_left = np.where(np.repeat(x0, n) > 0, x - np.repeat(x0, n) + 1, _FAR)
    to_right = np.where(np.repeat(x1, n) < width - 1, np.repeat(x1, n) - x + 1, _FAR)
    ring[rows, x - left] = np.minimum(to_left, to_right)
    unknown = np.zeros(ring.shape, dtype=bool)
    unknown[rows, x - left] = True
    across, d = ring.copy(), 1
    while d < len(ring) and (ring > d).any():
        np.minimum(ring[d:], np.maximum(across[:-d], d), out=ring[d:])
        np.minimum(ring[:-d], np.maximum(across[d:], d), out=ring[:-d])
        d += 1
    return ring, unknown


def ring_distance(unknown: DataFrame, pages: DataFrame) -> DataFrame:
    """``(page_id, y, x, ring, d1..d4)`` for every unknown pixel.

    Known pixels are ring 0 and grow by a 3x3 box per ring; a flag tells that
    the pixel was reached from that corner. Rings are distances to the nearest
    known pixel of the page, found along the rows first (a run knows the way to
    its ends) and then along the columns, strip by strip; a strip sees one
    column beyond its ends for the flags. A page without known pixels has none.
    """
    runs = union(unknown).join(pages.select("page_id", "width", "height"), "page_id")
    last = F.least(F.floor((F.col("x1") + 1) / F.lit(STRIP)), F.floor((F.col("width") - 1) / F.lit(STRIP))).cast("bigint")
    runs = runs.withColumn("strip", F.explode(F.sequence(F.greatest(F.floor((F.col("x0") - 1) / F.lit(STRIP)).cast("bigint"), F.lit(0).cast("bigint")), last)))
    columns = ["page_id", "strip", "y", "x0", "x1", "width", "height"]
    page_type = runs.schema["page_id"].dataType
    flags = list(_DIAGONALS)

    def strip(table: pa.Table) -> pa.Table:
        y, x0, x1 = (table[c].to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        at, width, height = (int(table[c][0].as_py()) for c in ("strip", "width", "height"))
        left, right = max(0, at * STRIP - 1), min(width - 1, (at + 1) * STRIP)
        top, bottom = max(0, int(y.min()) - 1), min(height - 1, int(y.max()) + 1)
        ring, hidden = _strip_rings(top, bottom, left, right, y, np.maximum(x0, left), np.minimum(x1, right), x0, x1, width)
        # a neighbour beyond the page is no ring; one beyond these rows is not there or known, and then out of reach
        wide = np.pad(ring, 1, constant_values=-1)
        hidden[:, :at * STRIP - left] = False
        hidden[:, (at + 1) * STRIP - left:] = False
        hidden &= ring < _FAR
        py, px = np.nonzero(hidden)
        rings = ring[py, px]
        reached = [np.any([wide[py + 1 + dy, px + 1 + dx] == rings - 1 for dy, dx in cells], axis=0) for cells in _DIAGONALS.values()]
        return pa.table([pa.chunked_array([table["page_id"].combine_chunks().take(pa.array(np.zeros(len(py), dtype=np.int64)))]),
                         pa.array(py + top), pa.array(px + left), pa.array(rings, pa.int32()), *map(pa.array, reached)], names=["page_id", "y", "x", "ring", *flags])

    schema = f"page_id {page_type.simpleString()}, y bigint, x bigint, ring int, " + ", ".join(f"{f} boolean" for f in flags)
    return runs.select(*columns).groupBy("page_id", "strip").applyInArrow(strip, schema)
