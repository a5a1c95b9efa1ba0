"""Panel layout: box relations, grouping, merging, expansion and reading order.

Panels are ``(page_id, panel_id, x, y, r, b)``.  Relations are interval joins on
the per-page grid; the fixpoints run over all pages in step.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from folioframe.operators import filters
from folioframe.operators.graph import component_links, connected_components
from folioframe.operators.ranking import ranked
from folioframe.operators.spatial import CELL, box_join, with_cells
from folioframe.session import cut_lineage

EDGES = ("x", "y", "r", "b")
_BOX = ["page_id", "panel_id", *EDGES]

#: Fixpoints stop long before; reaching the bound is an error, never a result.
MAX_ROUNDS = 10_000


class _Side:
    """Edges, size and area of one side of a join."""

    def __init__(self, get):
        self.x, self.y, self.r, self.b = (get(c) for c in EDGES)
        self.w, self.h = self.r - self.x, self.b - self.y
        self.area = self.w * self.h


def union_box(p, q):
    out = object.__new__(_Side)
    out.x, out.y = F.least(p.x, q.x), F.least(p.y, q.y)
    out.r, out.b = F.greatest(p.r, q.r), F.greatest(p.b, q.b)
    out.w, out.h = out.r - out.x, out.b - out.y
    out.area = out.w * out.h
    return out


def overlap_box(p, q):
    """Common part of two boxes that touch or overlap."""
    out = object.__new__(_Side)
    out.x, out.y = F.greatest(p.x, q.x), F.greatest(p.y, q.y)
    out.r, out.b = F.least(p.r, q.r), F.least(p.b, q.b)
    out.w, out.h = out.r - out.x, out.b - out.y
    out.area = out.w * out.h
    return out


def meets(p, q) -> Column:
    return ~((p.x > q.r) | (q.x > p.r) | (p.y > q.b) | (q.y > p.b))


def overlaps(p, q) -> Column:
    """More than a tenth of the smaller box is shared, or one has no area."""
    small = F.least(p.area, q.area)
    common = overlap_box(p, q).area
    return meets(p, q) & F.when(small == 0, F.lit(True)).otherwise(common * 10 > small)


def contains(p, q) -> Column:
    return meets(p, q) & (overlap_box(p, q).area * 2 > q.area)


def is_close(p, q) -> Column:
    dx = F.abs((p.x + p.w / F.lit(2.0)) - (q.x + q.w / F.lit(2.0)))
    dy = F.abs((p.y + p.h / F.lit(2.0)) - (q.y + q.h / F.lit(2.0)))
    return (dx <= (p.w + q.w) * 0.75) & (dy <= (p.h + q.h) * 0.75)


def roughly_equal(p, q) -> Column:
    """All four edges differ by less than a tenth of the left side."""
    wt, ht = p.w / F.lit(10.0), p.h / F.lit(10.0)
    return (
        (F.abs(p.x - q.x) < wt) & (F.abs(p.y - q.y) < ht)
        & (F.abs(p.r - q.r) < wt) & (F.abs(p.b - q.b) < ht))


def _same_band(p0, p1, q0, q1) -> Column:
    """Two intervals are disjoint, nested, or share a third of the shorter one."""
    first = p0 < q0
    a0, a1 = F.when(first, p0).otherwise(q0), F.when(first, p1).otherwise(q1)
    b0, b1 = F.when(first, q0).otherwise(p0), F.when(first, q1).otherwise(p1)
    short = F.least(a1 - a0, b1 - b0)
    shared = (F.least(a1, b1) - b0) / short.cast("double")
    return F.when(b0 > a1, F.lit(False)).when(b1 < a1, F.lit(True)).otherwise(
        F.when(short == 0, F.lit(True)).otherwise(shared >= 1.0 / 3.0))


def same_column(p, q) -> Column:
    return _same_band(p.x, p.r, q.x, q.r)


def same_row(p, q) -> Column:
    return _same_band(p.y, p.b, q.y, q.b)


def _cells(df: DataFrame, x0="x", y0="y", x1="r", y1="b", cell: int = CELL) -> DataFrame:
    at = lambda v: F.lit(v) if isinstance(v, int) else (F.col(v) if isinstance(v, str) else v)
    return with_cells(df, at(x0), at(y0), at(x1), at(y1), cell)


def relation(left: DataFrame, right: DataFrame, rule, cell: int = CELL) -> DataFrame:
    """Pairs ``l_*``/``r_*`` of touching boxes of a page that satisfy ``rule(p, q)``."""
    return box_join(
        _cells(left, cell=cell), _cells(right, cell=cell), lambda l, r: rule(_Side(l), _Side(r)), ["page_id"], cell)


def close_pairs(panels: DataFrame) -> DataFrame:
    """Pairs i < j whose centres are near for their size."""
    # near centres are the same as touching boxes grown to 1.5 times their size
    grown = _cells(panels, F.col("x") - (F.col("r") - F.col("x")) * 0.25, F.col("y") - (F.col("b") - F.col("y")) * 0.25,
                   F.col("r") + (F.col("r") - F.col("x")) * 0.25, F.col("b") + (F.col("b") - F.col("y")) * 0.25)
    return box_join(grown, grown, lambda l, r: (l("panel_id") < r("panel_id")) & is_close(_Side(l), _Side(r)), ["page_id"])


def band_pairs(panels: DataFrame, axis: str, rule) -> DataFrame:
    """Ordered pairs that share a column (axis x) or a row (axis y)."""
    if axis == "x":
        c = _cells(panels, "x", 0, "r", 0)
        same = same_column
    else:
        c = _cells(panels, 0, "y", 0, "b")
        same = same_row
    return box_join(c, c, lambda l, r: (l("panel_id") != r("panel_id")) & same(_Side(l), _Side(r)) & rule(_Side(l), _Side(r)), ["page_id"])


#: Pitch of the bands and height of the first slabs of the neighbour search, and the growth of slabs per round.
BAND, SLAB, GROWTH = 128, 64, 8
_SIDE_KEY = ["page_id", "side", "band", "slab"]


def _sides(panels: DataFrame) -> DataFrame:
    """Four rows per panel, one per side, that make all sides alike.

    The neighbour on a side has an interval ``lo..hi`` in the same band and the
    greatest ``(edge, tie)`` with ``edge`` up to the panel's ``most``.
    """
    def side(name, lo, hi, edge, most, tie):
        return F.struct(F.lit(name).alias("side"), *(v.cast("bigint").alias(n) for n, v in (("lo", lo), ("hi", hi), ("edge", edge), ("most", most), ("tie", tie))))

    x, y, r, b, i = (F.col(c) for c in (*EDGES, "panel_id"))
    rows = F.array(side("top", x, r, b, y - 1, i), side("left", y, b, r, x, i), side("right", y, b, -x, -r, -i), side("bottom", x, r, -y, -b, -i))
    return panels.select("page_id", "panel_id", F.struct("panel_id", *EDGES).alias("box"), F.explode(rows).alias("s")).select("page_id", "panel_id", "box", "s.*")


def _banded(rows: DataFrame) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / F.lit(BAND)).cast("bigint")
    return rows.withColumn("band", F.explode(F.sequence(at("lo"), at("hi"))))


#: Pages of up to so many panels are searched as one row each.
FEW_PANELS = 32


def _neighbours_by_page(panels: DataFrame) -> DataFrame:
    """:func:`neighbours` of pages with few panels: every panel against the list of its page, one shuffle."""
    whole = panels.groupBy("page_id").agg(F.collect_list(F.struct("panel_id", *EDGES)).alias("_all"))
    rows = whole.select("page_id", "_all", F.explode("_all").alias("_p"))
    # copies of an id share what any of them finds
    rows = rows.withColumn("_own", F.filter("_all", lambda c: c["panel_id"] == F.col("_p.panel_id")))

    def nearest(lo, hi, edge, most, sign) -> Column:
        of = lambda box, c: box[c].cast("bigint")

        def found(c):
            known = lambda box: box[lo].isNotNull() & box[hi].isNotNull()
            hit = F.filter("_all", lambda q: (edge(q) <= most(c)) & (c["panel_id"] != q["panel_id"]) & known(c) & known(q) & _same_band(of(c, lo), of(c, hi), of(q, lo), of(q, hi)))
            return F.transform(hit, lambda q: F.struct(edge(q).alias("edge"), (sign * of(q, "panel_id")).alias("tie"), q.alias("box")))

        return F.array_max(F.flatten(F.transform("_own", found)))["box"]

    at = lambda c, sign=1, less=0: lambda box: (sign * box[c] - less).cast("bigint")
    return rows.select(
        "page_id", "_p.*", nearest("x", "r", at("b"), at("y", 1, 1), 1).alias("top"), nearest("y", "b", at("r"), at("x"), 1).alias("left"),
        nearest("y", "b", at("x", -1), at("r", -1), -1).alias("right"), nearest("x", "r", at("y", -1), at("b", -1), -1).alias("bottom"))


def neighbours(panels: DataFrame) -> DataFrame:
    """Nearest panel on every side: ``top, left, right, bottom`` ids and edges.

    A page with few panels is one row; those of a crowded one meet in bands.
    """
    panels = cut_lineage(panels.select(*_BOX))
    pages = cut_lineage(panels.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")))
    few = (F.col("_n") <= FEW_PANELS) & F.col("page_id").isNotNull()
    light = _neighbours_by_page(panels.join(pages.where(few).select("page_id"), "page_id", "left_semi"))
    if pages.where(~few).isEmpty():
        return light
    return light.unionByName(_neighbours_by_bands(cut_lineage(panels.join(pages.where(few).select("page_id"), "page_id", "left_anti"))))


def _neighbours_by_bands(panels: DataFrame) -> DataFrame:
    """:func:`neighbours` of crowded pages.

    A panel asks in the two slabs of its bands that lie before its own edge.
    Whatever is found there is nearer than all else; who finds nothing asks in
    larger slabs. Slabs in which no edge is low enough are not asked, so a panel
    meets few others even where a page holds very many.
    """
    sides = cut_lineage(_banded(_sides(panels)))
    low = sides.groupBy("page_id", "side", "band").agg(F.min("edge").alias("_low"))
    slim = ["page_id", "side", "band", "panel_id", "lo", "hi", "most"]
    asking = cut_lineage(sides.select(*slim).join(low, ["page_id", "side", "band"]).where("_low <= most").drop("_low"))
    span = sides.agg(F.max("most") - F.min("edge")).first()[0]
    found, slab = [], SLAB
    while span is not None and not asking.isEmpty():
        at = lambda c, size=slab: F.floor(F.col(c) / F.lit(size)).cast("bigint")
        there = sides.select(*(F.col(c).alias(f"r_{c}") if c not in _SIDE_KEY else F.col(c) for c in ("page_id", "side", "band", "panel_id", "lo", "hi", "edge", "tie", "box")),
                             at("edge").alias("slab"))
        lowest = there.groupBy(*_SIDE_KEY).agg(F.min("r_edge").alias("_low"))
        asked = asking.withColumn("slab", F.explode(F.array(at("most"), at("most") - 1))).join(lowest, _SIDE_KEY).where("_low <= most").drop("_low")
        same = _same_band(F.col("lo"), F.col("hi"), F.col("r_lo"), F.col("r_hi"))
        hit = asked.join(there, _SIDE_KEY).where((F.col("r_edge") <= F.col("most")) & (F.col("panel_id") != F.col("r_panel_id")) & same)
        hit = cut_lineage(hit.groupBy("page_id", "side", "panel_id").agg(F.max(F.struct("r_edge", "r_tie", "r_box"))["r_box"].alias("box")))
        found.append(hit)
        if slab > span:  # two slabs reach over the whole page
            break
        asking = cut_lineage(asking.join(hit, ["page_id", "side", "panel_id"], "left_anti"))
        slab *= GROWTH
    if not found:
        found = [sides.select("page_id", "side", "panel_id", "box").limit(0)]
    near = reduce(DataFrame.unionByName, found).groupBy("page_id", "panel_id").agg(
        *[F.first(F.when(F.col("side") == s, F.col("box")), ignorenulls=True).alias(s) for s in ("top", "left", "right", "bottom")])
    return panels.join(near, ["page_id", "panel_id"], "left")


def gutters(near: DataFrame) -> DataFrame:
    """Smallest gap to a left and to a top neighbour per page, 1 without any."""
    return near.groupBy("page_id").agg(
        F.coalesce(F.min(F.col("x") - F.col("left.r")), F.lit(1)).alias("gap_x"),
        F.coalesce(F.min(F.col("y") - F.col("top.b")), F.lit(1)).alias("gap_y"))


# --- grouping and merging ---------------------------------------------------


def group_small(panels: DataFrame, page_w, page_h, ratio: float) -> DataFrame:
    """Replace groups of close small panels by the box around each group."""
    small = filters.is_small(F.col("r") - F.col("x"), F.col("b") - F.col("y"), page_w, page_h, ratio)
    panels = panels.select(*_BOX)
    candidates = panels.where(small)
    edges = close_pairs(candidates).select(
        F.col("l_page_id").alias("page_id"), F.col("l_panel_id").alias("u"), F.col("r_panel_id").alias("v"))
    grouped = connected_components(candidates, edges, node="panel_id")
    boxes = grouped.groupBy("page_id", F.col("component").alias("panel_id")).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("r"), F.max("b").alias("b"))
    return panels.where(~small).unionByName(boxes.select(*_BOX))


# Boxes whose ordered pairs depend on one another are folded as one row: lists [x, y, r, b] in order of their id.


def _common(p, q):
    """Width and height that two boxes share, None if they do not meet."""
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    return None if w < 0 or h < 0 else (w, h)


def _size(p) -> int:
    return (p[2] - p[0]) * (p[3] - p[1])


def _alike(p, q) -> bool:
    """Edges differ by less than a tenth of the left box."""
    w, h = (p[2] - p[0]) / 10, (p[3] - p[1]) / 10
    return abs(p[0] - q[0]) < w and abs(p[2] - q[2]) < w and abs(p[1] - q[1]) < h and abs(p[3] - q[3]) < h


def _bumps(p, others) -> bool:
    for q in others:
        shared = None if _alike(q, p) else _common(p, q)
        small = min(_size(p), _size(q))
        if shared and (small == 0 or shared[0] * shared[1] / small > 0.1):
            return True
    return False


def _toward(boxes, outer: int, inner: int):
    """The largest growth of a box to edges of another one that bumps into no third; of equal ones the last."""
    p, q = boxes[outer], boxes[inner]
    grown = [list(p)]
    for side in (0, 2, 1, 3):
        if (q[side] < p[side]) if side < 2 else (q[side] > p[side]):
            grown += [[*g[:side], q[side], *g[side + 1:]] for g in grown]
    others = [o for o in boxes if not _alike(o, p) and not _alike(o, q)]
    best = list(p)
    for g in sorted((g for g in grown if not _bumps(g, others)), key=_size):
        best = g
    return best


def _merged_page(boxes):
    """One pass over the pairs; a box that lies mostly in another one goes, but still counts until the pass ends."""
    gone = set()
    for i in range(len(boxes)):
        for j in range(i + 1, len(boxes)):
            for outer, inner in ((i, j), (j, i)):
                shared = _common(boxes[outer], boxes[inner])
                if shared and shared[0] * shared[1] * 2 > _size(boxes[inner]):
                    boxes[outer] = _toward(boxes, outer, inner)
                    gone.add(inner)
                    break
    return [None if k in gone else b for k, b in enumerate(boxes)]


def _trimmed_page(boxes):
    """Every ordered pair that meets gives up its common strip, one pair after the other."""
    for i, p in enumerate(boxes):
        for j, q in enumerate(boxes):
            shared = None if i == j or _alike(p, q) else _common(p, q)
            if not shared:
                continue
            side = 0 if shared[0] < shared[1] else 1 if shared[0] > shared[1] else None
            if side is not None and p[side + 2] <= q[side + 2]:
                p[side + 2], q[side] = max(p[side], q[side]), p[side + 2]
    return boxes


def clusters(boxes: DataFrame) -> DataFrame:
    """``boxes`` with ``cluster``: boxes that can come to touch while each stays inside the box around its own cluster.

    Touching boxes are one cluster, and so are clusters whose surrounding boxes
    touch, until none do. Boxes of different clusters can never meet, so what
    one does to another stays inside a cluster.
    """
    named = cut_lineage(boxes.select(*_BOX).withColumn("cluster", F.col("panel_id")))
    around = named.select("page_id", "cluster", *EDGES)
    for _ in range(MAX_ROUNDS):
        pairs = relation(around, around, meets).where("l_cluster < r_cluster").select(
            F.col("l_page_id").alias("page_id"), F.col("l_cluster").alias("u"), F.col("r_cluster").alias("v"))
        links = component_links(pairs).select("page_id", F.col("u").alias("cluster"), F.col("v").alias("_root"))
        if links.isEmpty():
            return named
        named = cut_lineage(named.join(links, ["page_id", "cluster"], "left").withColumn("cluster", F.coalesce("_root", "cluster")).drop("_root"))
        around = named.groupBy("page_id", "cluster").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("r"), F.max("b").alias("b"))
    raise RuntimeError("clusters of boxes did not settle")


_CLUSTER = ArrayType(StructType([StructField(n, LongType()) for n in ("panel_id", *EDGES)]))


def _few_on_page(panels: DataFrame) -> DataFrame:
    """Pages of few panels without a null, which may be one row: ``(page_id, _few)`` for every page."""
    n = F.count(F.lit(1))
    return panels.groupBy("page_id").agg((F.col("page_id").isNotNull() & (n <= FEW_PANELS) & (F.count_if(reduce(Column.__or__, [F.col(c).isNull() for c in _BOX])) == 0)).alias("_few"))


def _fold_clusters(panels: DataFrame, fold) -> DataFrame:
    """A page of few panels is folded as a whole, a crowded one cluster by cluster; panels that never meet change nothing."""
    @F.pandas_udf(_CLUSTER)
    def folded(ids: pd.Series, xs: pd.Series, ys: pd.Series, rs: pd.Series, bs: pd.Series) -> pd.Series:
        out = []
        for i, *sides in zip(ids, xs, ys, rs, bs):
            boxes = fold([list(box) for box in zip(*(side.tolist() for side in sides))])
            out.append([{"panel_id": k, **dict(zip(EDGES, box))} for k, box in zip(i.tolist(), boxes) if box is not None])
        return pd.Series(out)

    panels = cut_lineage(panels.select(*[F.col(c).cast("bigint").alias(c) for c in _BOX]))
    pages = cut_lineage(_few_on_page(panels))
    parts = [panels.join(pages.where("_few").select("page_id"), "page_id", "left_semi").groupBy("page_id")]
    if not pages.where("NOT _few").isEmpty():
        parts.append(clusters(panels.join(pages.where("_few").select("page_id"), "page_id", "left_anti")).groupBy("page_id", "cluster"))
    packed = [part.agg(F.sort_array(F.collect_list(F.struct("panel_id", *EDGES))).alias("boxes")).select("page_id", "boxes") for part in parts]
    packed = cut_lineage(reduce(DataFrame.unionByName, packed))
    alone = packed.where(F.size("boxes") == 1).select("page_id", F.inline("boxes"))
    return alone.unionByName(packed.where(F.size("boxes") > 1).select("page_id", F.inline(folded(*[F.col(f"boxes.{c}") for c in _BOX[1:]]))))


def merge_contained(panels: DataFrame) -> DataFrame:
    """Fold a panel that lies mostly inside another one into it.

    The outer panel takes the largest of its expansions toward the inner one that
    bumps into no other panel. A later pair sees what an earlier one did, so a
    cluster of panels that can touch is one row here.
    """
    return _fold_clusters(panels, _merged_page)


def deoverlap(panels: DataFrame) -> DataFrame:
    """Trim the shared right or bottom edge of overlapping panels, pair by pair; a cluster that can touch is one row here."""
    return _fold_clusters(panels, _trimmed_page)


def _band(a0, a1, b0, b1) -> bool:
    if a0 >= b0:
        a0, a1, b0, b1 = b0, b1, a0, a1
    if b0 > a1:
        return False
    if b1 < a1:
        return True
    short = min(a1 - a0, b1 - b0)
    return short == 0 or (min(a1, b1) - b0) / short >= 1 / 3


def _grow(boxes: list[list[int]], gap_x: int, gap_y: int) -> list[list[int]]:
    """Expand the panels of one page in order; later ones see the earlier result."""
    for i in range(len(boxes)):
        for d in range(4):
            p = boxes[i]
            others = [q for j, q in enumerate(boxes) if j != i]
            across = d in (0, 2)
            band = [q for q in others if (_band(q[1], q[3], p[1], p[3]) if across else _band(q[0], q[2], p[0], p[2]))]
            if d == 0:
                near = max((q[2] for q in band if q[2] <= p[0]), default=None)
            elif d == 1:
                near = max((q[3] for q in band if q[3] < p[1]), default=None)
            elif d == 2:
                near = min((q[0] for q in band if q[0] >= p[2]), default=None)
            else:
                near = min((q[1] for q in band if q[1] >= p[3]), default=None)
            gap = gap_x if across else gap_y
            if near is None:
                edge = [q[d] for q in boxes]
                goal = min(edge) if d < 2 else max(edge)
            else:
                goal = near + gap if d < 2 else near - gap
            if (goal < p[d]) if d < 2 else (goal > p[d]):
                p[d] = goal
    return boxes


_GROWN = ArrayType(StructType([StructField(n, LongType()) for n in ("panel_id", *EDGES)]))


@F.pandas_udf(_GROWN)
def _grow_pages(ids: pd.Series, xs: pd.Series, ys: pd.Series, rs: pd.Series, bs: pd.Series, gx: pd.Series, gy: pd.Series) -> pd.Series:
    out = []
    for i, x, y, r, b, a, c in zip(ids, xs, ys, rs, bs, gx, gy):
        grown = _grow([[int(v) for v in q] for q in zip(x, y, r, b)], int(a), int(c))
        out.append([{"panel_id": int(k), **dict(zip(EDGES, q))} for k, q in zip(i, grown)])
    return pd.Series(out)


def expand(panels: DataFrame) -> DataFrame:
    """Grow every panel to its neighbours less the gutter, or to the outer frame.

    Each panel depends on the one before it, so a page is one row here; the
    number of panels of a page is bounded by what fits on it.
    """
    panels = cut_lineage(panels.select(*_BOX))
    gaps = gutters(neighbours(panels))
    pages = panels.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("y", "x", "panel_id", "r", "b"))).alias("p")).join(gaps, "page_id")
    grown = _grow_pages(F.col("p.panel_id"), F.col("p.x"), F.col("p.y"), F.col("p.r"), F.col("p.b"), F.col("gap_x"), F.col("gap_y"))
    return pages.select("page_id", F.inline(grown))


#: Segments of a page up to which its panels are grouped as one row.
FEW_SEGMENTS = 4096

_GROUPED = ArrayType(StructType([StructField(n, LongType()) for n in ("panel_id", *EDGES, "pos")]))


def _group_page(ids: list[int], boxes: np.ndarray, segments: np.ndarray) -> list[dict]:
    """Panels of one page in their order, of which the first free pair is joined until there is none; ``boxes`` and ``segments`` are rows x, y, r, b."""
    area = lambda p: (p[..., 2] - p[..., 0]) * (p[..., 3] - p[..., 1])
    diagonal = lambda p: np.sqrt(((p[..., 2] - p[..., 0]) ** 2 + (p[..., 3] - p[..., 1]) ** 2).astype("float64"))

    def over(p, q):
        low, high = np.maximum(p[..., :2], q[..., :2]), np.minimum(p[..., 2:], q[..., 2:])
        w, h = high[..., 0] - low[..., 0], high[..., 1] - low[..., 1]
        small = np.minimum(area(p), area(q))
        return (w >= 0) & (h >= 0) & ((small == 0) | (w * h * 10 > small))

    def equal(o, p):
        reach = np.stack([o[..., 2] - o[..., 0], o[..., 3] - o[..., 1]] * 2, axis=-1) / 10.0
        return (np.abs(o - p) < reach).all(axis=-1)

    place, length = list(range(1, len(ids) + 1)), diagonal(segments)
    while len(ids) > 1:
        i, j = np.triu_indices(len(ids), 1)
        p, q = boxes[i], boxes[j]
        u = np.concatenate([np.minimum(p[:, :2], q[:, :2]), np.maximum(p[:, 2:], q[:, 2:])], axis=1)
        one, other, both, o = p[:, None], q[:, None], u[:, None], boxes[None]
        free = np.nonzero(~(over(both, o) & ~equal(o, one) & ~equal(o, other) & ~equal(o, both)).any(axis=1))[0]
        pick = next((k for k in free if not (over(u[k], segments) & (length > diagonal(u[k]) / 5.0)).any()), None)
        if pick is None:
            break
        a, b = int(i[pick]), int(j[pick])
        rest = [k for k in range(len(ids)) if k not in (a, b)]
        boxes = np.concatenate([boxes[rest], u[pick:pick + 1]])
        ids, place = [ids[k] for k in rest] + [min(ids[a], ids[b])], [place[k] for k in rest] + [max(place) + 1]
    return [{"panel_id": k, **dict(zip(EDGES, box)), "pos": n} for k, box, n in zip(ids, boxes.tolist(), place)]


@F.pandas_udf(_GROUPED)
def _group_pages(ids: pd.Series, xs: pd.Series, ys: pd.Series, rs: pd.Series, bs: pd.Series,
                 sx: pd.Series, sy: pd.Series, sr: pd.Series, sb: pd.Series) -> pd.Series:
    box = lambda *sides: np.stack(sides, axis=1).astype("int64")
    return pd.Series([_group_page(i.tolist(), box(*sides[:4]), box(*sides[4:])) for i, *sides in zip(ids, xs, ys, rs, bs, sx, sy, sr, sb)])


def group_big(panels: DataFrame, segments: DataFrame) -> DataFrame:
    """Join two panels when the box around both bumps into no third panel.

    A box that holds a long segment (over a fifth of its diagonal) stays split.
    Each joined pair depends on those before it: a page of few panels and
    segments is one row, crowded pages go through rounds of joins in step.
    """
    panels = cut_lineage(panels.select(*[F.col(c).cast("bigint").alias(c) for c in _BOX]))
    proper = F.count_if((F.col("r") < F.col("x")) | (F.col("b") < F.col("y"))) == 0
    single = panels.groupBy("page_id").agg((proper & (F.count_distinct("panel_id") == F.count(F.lit(1)))).alias("_single"))
    crowded = segments.groupBy("page_id").count().where(F.col("count") > FEW_SEGMENTS).select("page_id")
    pages = cut_lineage(_few_on_page(panels).join(single, "page_id").where("_few AND _single").select("page_id").join(crowded, "page_id", "left_anti"))
    lines = segments.select("page_id", F.struct(F.least("ax", "bx").alias("x"), F.least("ay", "by").alias("y"), F.greatest("ax", "bx").alias("r"), F.greatest("ay", "by").alias("b")).alias("s"))
    lines = lines.join(pages, "page_id", "left_semi").where(reduce(Column.__and__, [F.col(f"s.{e}").isNotNull() for e in EDGES]))
    lines = lines.groupBy("page_id").agg(F.collect_list("s").alias("_lines"))
    boxes = panels.join(pages, "page_id", "left_semi").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*_BOX[1:]))).alias("_boxes"))
    none = F.array().cast("array<bigint>")
    grouped = _group_pages(*[F.col(f"_boxes.{c}") for c in _BOX[1:]], *[F.coalesce(F.col(f"_lines.{e}").cast("array<bigint>"), none) for e in EDGES])
    light = boxes.join(lines, "page_id", "left").select("page_id", F.inline(grouped))
    rest = cut_lineage(panels.join(pages, "page_id", "left_anti"))
    return light if rest.isEmpty() else light.unionByName(_group_by_rounds(rest, segments.join(rest.select("page_id").distinct(), "page_id", "left_semi")))


def _group_by_rounds(panels: DataFrame, segments: DataFrame) -> DataFrame:
    """:func:`group_big` of crowded pages: every round joins the first free pair of every page.

    A page without one is done and drops out of the following rounds.
    """
    segments = cut_lineage(segments)
    done = []
    # what stands next to a panel rules most pairs out; a merged panel has the blockers of both, less itself
    near = neighbours(panels)
    around = [F.col(n) for n in ("top", "left", "right", "bottom")]
    blockers = F.transform(F.array_compact(F.array(*around)), lambda n: F.struct(n["panel_id"].alias("id"), *(n[e].alias(e) for e in EDGES)))
    state = cut_lineage(ranked(near.select(*_BOX, blockers.alias("blockers")), ["page_id"], ["panel_id"], "pos"))
    places = state.select(F.col("page_id").alias("_page"), F.col("panel_id").alias("_id"), F.col("pos").alias("_pos"))
    known = state.select("page_id", "pos", F.explode_outer("blockers").alias("k")).join(
        places, (F.col("k.id") == F.col("_id")) & (F.col("page_id") == F.col("_page")), "left").select(
        "page_id", "pos", F.when(F.col("_pos").isNotNull(), F.struct(F.col("_pos").alias("pos"), *(F.col(f"k.{e}").alias(e) for e in EDGES))).alias("k"))
    state = cut_lineage(state.drop("blockers").join(known.groupBy("page_id", "pos").agg(F.collect_list("k").alias("blockers")), ["page_id", "pos"]).select(*_BOX, "pos", "blockers"))
    me, mine, yours = (_Side(lambda c, s=s: F.col(f"{s}{c}")) for s in ("", "p.", "q."))

    def blocks(k) -> Column:
        o = _Side(lambda c: k[c])
        same = roughly_equal(o, mine) | roughly_equal(o, yours) | roughly_equal(o, me)
        return (k["pos"] != F.col("i")) & (k["pos"] != F.col("j")) & overlaps(me, o) & ~same

    for _ in range(MAX_ROUNDS):
        l, r = (state.select(*[F.col(c).alias(f"{s}_{c}") for c in state.columns]) for s in "lr")  # noqa: E741
        p, q = _Side(lambda c: F.col(f"l_{c}")), _Side(lambda c: F.col(f"r_{c}"))
        u = union_box(p, q)
        pairs = l.join(r, (F.col("l_page_id") == F.col("r_page_id")) & (F.col("l_pos") < F.col("r_pos"))).select(
            F.col("l_page_id").alias("page_id"), F.col("l_pos").alias("i"), F.col("r_pos").alias("j"),
            u.x.alias("x"), u.y.alias("y"), u.r.alias("r"), u.b.alias("b"),
            F.struct(*[F.col(f"l_{e}").alias(e) for e in EDGES]).alias("p"), F.struct(*[F.col(f"r_{e}").alias(e) for e in EDGES]).alias("q"),
            F.concat("l_blockers", "r_blockers").alias("blockers"))
        # a blocker of either panel inside the common box rules the pair out early
        pairs = cut_lineage(pairs.where(~F.exists("blockers", blocks)).drop("blockers"))
        hits = relation(pairs, state.select(*_BOX, "pos"), overlaps)
        both, o = _Side(lambda c: F.col(f"l_{c}")), _Side(lambda c: F.col(f"r_{c}"))
        # what looks like one of the two is no third panel
        one, other = _Side(lambda c: F.col(f"l_p.{c}")), _Side(lambda c: F.col(f"l_q.{c}"))
        hits = hits.where(~roughly_equal(o, one) & ~roughly_equal(o, other) & ~roughly_equal(o, both)).select(F.col("l_page_id").alias("page_id"), F.col("l_i").alias("i"), F.col("l_j").alias("j"))
        held = long_segments(pairs, segments).select("page_id", "i", "j")
        free = pairs.join(hits.unionByName(held).distinct(), ["page_id", "i", "j"], "left_anti")
        pick = cut_lineage(free.groupBy("page_id").agg(F.min(F.struct("i", "j", *EDGES)).alias("m")).select("page_id", "m.*"))
        if pick.isEmpty():
            done.append(state)
            break
        active = pick.select("page_id")
        done.append(state.join(active, "page_id", "left_anti"))
        state = state.join(active, "page_id", "left_semi")
        ends = pick.select("page_id", F.explode(F.array("i", "j")).alias("pos"))
        ids = state.join(ends, ["page_id", "pos"], "left_semi").groupBy("page_id").agg(F.min("panel_id").alias("panel_id"))
        top = state.groupBy("page_id").agg((F.max("pos") + 1).alias("pos"))
        inherited = state.join(ends, ["page_id", "pos"], "left_semi").groupBy("page_id").agg(F.flatten(F.collect_list("blockers")).alias("blockers"))
        merged = pick.join(ids, "page_id").join(top, "page_id").join(inherited, "page_id").select(*_BOX, "pos", "blockers")
        rest = state.join(ends, ["page_id", "pos"], "left_anti").unionByName(merged).join(pick.select("page_id", "i", "j"), "page_id")
        still = F.filter("blockers", lambda k: (k["pos"] != F.col("i")) & (k["pos"] != F.col("j")))
        state = cut_lineage(rest.select(*_BOX, "pos", still.alias("blockers")))
    else:
        raise RuntimeError("panel grouping did not end")
    return reduce(DataFrame.unionByName, done).select(*_BOX, "pos")


def largest_first(panels: DataFrame) -> DataFrame:
    """Add ``place``: panels of a page by falling area."""
    sized = panels.withColumn("_area", -(F.col("r") - F.col("x")) * (F.col("b") - F.col("y")))
    return ranked(sized, ["page_id"], ["_area", "panel_id"], "place").drop("_area")


def long_segments(boxes: DataFrame, segments: DataFrame, share: float = 5.0) -> DataFrame:
    """Rows of ``boxes`` that hold a segment longer than a fifth of the diagonal."""
    seg = segments.select(
        "page_id", F.col("seg_id"), F.least("ax", "bx").alias("x"), F.least("ay", "by").alias("y"),
        F.greatest("ax", "bx").alias("r"), F.greatest("ay", "by").alias("b"))
    pairs = relation(boxes, seg, overlaps)
    p, s = _Side(lambda c: F.col(f"l_{c}")), _Side(lambda c: F.col(f"r_{c}"))
    length = lambda q: F.sqrt((q.w * q.w + q.h * q.h).cast("double"))
    kept = pairs.where(length(s) > length(p) / share)
    return kept.select(*[F.col(f"l_{c}").alias(c) for c in boxes.columns], F.col("r_seg_id").alias("seg_id"))


# --- reading order ----------------------------------------------------------


def reading_order(panels: DataFrame, ltr: bool = False) -> DataFrame:
    """Number panels so that the top neighbour and the row before come first."""
    panels = cut_lineage(panels.select(*_BOX))
    near = neighbours(panels).where("top IS NOT NULL").select(
        "page_id", F.col("top.panel_id").alias("u"), F.col("panel_id").alias("v"))
    row = band_pairs(panels, "y", (lambda p, q: q.r <= p.x) if ltr else (lambda p, q: q.x >= p.r)).select(
        F.col("l_page_id").alias("page_id"), F.col("r_panel_id").alias("u"), F.col("l_panel_id").alias("v"))
    edges = cut_lineage(near.unionByName(row).distinct())
    depth = panels.select("page_id", F.col("panel_id").alias("u"), F.lit(0).alias("depth"))
    level = cut_lineage(edges.select("page_id", F.col("v").alias("u")).distinct())
    levels = [depth]
    n = 0
    # a panel sits at the length of the longest chain that leads to it
    while not level.isEmpty():
        n += 1
        if n > MAX_ROUNDS:
            raise RuntimeError("reading order has a cycle")
        levels.append(level.withColumn("depth", F.lit(n)))
        level = cut_lineage(edges.join(level, ["page_id", "u"]).select("page_id", F.col("v").alias("u")).distinct())
    depth = reduce(DataFrame.unionByName, levels).groupBy("page_id", F.col("u").alias("panel_id")).agg(F.max("depth").alias("depth"))
    side = F.col("x") if ltr else -F.col("x")
    return ranked(panels.join(depth, ["page_id", "panel_id"]), ["page_id"], ["depth", "y", side, "panel_id"], "number")


# --- segments ---------------------------------------------------------------


def _angle(dx, dy) -> Column:
    return F.atan2(dy.cast("double"), dx.cast("double"))


def collinear_pairs(segments: DataFrame, gutter: float, by: str = "seg_id") -> DataFrame:
    """Pairs u < v of segments that lie on one line with a small gap."""
    grow = gutter
    s = segments.withColumns({
        "x": F.least("ax", "bx"), "y": F.least("ay", "by"), "r": F.greatest("ax", "bx"), "b": F.greatest("ay", "by")})
    s = s.withColumn("len", F.sqrt(((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)))
    reach = F.col("len") * 0.05 + F.lit(grow)
    cells = with_cells(s, F.col("x") - reach, F.col("y") - reach, F.col("r") + reach, F.col("b") + reach)

    def rule(l, r):  # noqa: E741
        turn = F.abs(_angle(l("bx") - l("ax"), l("by") - l("ay")) - _angle(r("bx") - r("ax"), r("by") - r("ay")))
        ten = F.radians(F.lit(10.0))
        straight = (turn < ten) | (F.abs(turn - F.lit(3.141592653589793)) < ten)
        gap_x = F.greatest(l("x") - r("r"), r("x") - l("r"), F.lit(0))
        gap_y = F.greatest(l("y") - r("b"), r("y") - l("b"), F.lit(0))
        limit = F.greatest(l("len"), r("len")) * 0.05
        off = lambda a, p: _line_offset(a, p[0], p[1])
        mean = (off(l, (r("ax"), r("ay"))) + off(l, (r("bx"), r("by")))
                + off(r, (l("ax"), l("ay"))) + off(r, (l("bx"), l("by")))) / F.lit(4.0)
        return (l(by) < r(by)) & straight & (gap_x <= limit) & (gap_y <= limit) & (mean <= gutter)

    return box_join(cells, cells, rule, ["page_id"]).select(
        F.col("l_page_id").alias("page_id"), F.col(f"l_{by}").alias("u"), F.col(f"r_{by}").alias("v"))


def _line_offset(s, px, py) -> Column:
    """Distance of a point from the line through a segment."""
    dx, dy = s("bx") - s("ax"), s("by") - s("ay")
    cross = F.abs(dx * (py - s("ay")) - dy * (px - s("ax"))).cast("double")
    away = F.sqrt(((px - s("ax")) ** 2 + (py - s("ay")) ** 2))
    return F.when(s("len") == 0, away).otherwise(F.try_divide(cross, s("len")))


#: Segments of a page up to which its collinear ones are found in one row.
FEW_TO_PAIR = 512


#: Pairs of segments that are tested together.
PAIRS_AT_ONCE = 1 << 19


def _collinear(page: np.ndarray, ids: np.ndarray, ends: np.ndarray, gutter: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of :func:`collinear_pairs` among segments ``(ax, ay, bx, by)`` sorted by page, as positions."""
    count = np.bincount(page)
    n, first = count[page], (np.cumsum(count) - count)[page]
    i = np.repeat(np.arange(len(page)), n)
    j = np.arange(len(i)) + np.repeat(first - (np.cumsum(n) - n), n)
    i, j = (p[ids[i] < ids[j]] for p in (i, j))
    ax, ay, bx, by = ends
    length = lambda dx, dy: np.sqrt(dx.astype("float64") ** 2 + dy.astype("float64") ** 2)
    size = length(ax - bx, ay - by)
    angle = np.arctan2((by - ay).astype("float64"), (bx - ax).astype("float64"))
    turn = np.abs(angle[i] - angle[j])
    straight = (turn < np.radians(10.0)) | (np.abs(turn - np.pi) < np.radians(10.0))
    i, j = i[straight], j[straight]
    limit = np.maximum(size[i], size[j]) * 0.05
    gap = lambda p, q: np.maximum(np.minimum(p, q)[i] - np.maximum(p, q)[j], np.minimum(p, q)[j] - np.maximum(p, q)[i])
    near = (gap(ax, bx) <= limit) & (gap(ay, by) <= limit)
    i, j = i[near], j[near]

    def off(s, px, py):
        cross = np.abs((bx[s] - ax[s]) * (py - ay[s]) - (by[s] - ay[s]) * (px - ax[s])).astype("float64")
        return np.where(size[s] == 0, length(px - ax[s], py - ay[s]), cross / np.where(size[s] == 0, 1.0, size[s]))

    on = (off(i, ax[j], ay[j]) + off(i, bx[j], by[j]) + off(j, ax[i], ay[i]) + off(j, bx[i], by[i])) / 4.0 <= gutter
    return i[on], j[on]


def _smallest_reached(page: np.ndarray, ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id of its page that each position reaches over the pairs; equal ids are one vertex."""
    order = np.lexsort((ids, page))
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (page[order][1:] != page[order][:-1])
    at = np.empty(len(ids), dtype=np.int64)
    at[order] = np.cumsum(fresh) - 1
    names = ids[order][fresh]
    low, i, j = np.arange(len(names)), at[i], at[j]
    while (low[i] != low[j]).any():
        least = np.minimum(low[i], low[j])
        new = low.copy()
        for end in (low[i], low[j]):
            np.minimum.at(new, end, least)
        low = new[new]
    while (low[low] != low).any():
        low = low[low]
    return names[low][at]


def _united_pages(segments: DataFrame, gutter: float) -> DataFrame:
    """Segments of pages of few with their ``component``: a page is one row, many pages are searched at once."""
    @F.pandas_udf("array<bigint>")
    def united(ids: pd.Series, axs: pd.Series, ays: pd.Series, bxs: pd.Series, bys: pd.Series) -> pd.Series:
        n = ids.map(len).to_numpy()
        out = []
        for _, rows in pd.Series(range(len(ids))).groupby(np.cumsum(n * n) // PAIRS_AT_ONCE):
            part = slice(rows.iloc[0], rows.iloc[-1] + 1)
            page = np.repeat(np.arange(len(rows)), n[part])
            key, *ends = (np.concatenate(c.iloc[part].tolist()).astype(np.int64) for c in (ids, axs, ays, bxs, bys))
            found = _smallest_reached(page, key, *_collinear(page, key, np.stack(ends), gutter))
            out += np.split(found, np.cumsum(n[part])[:-1])
        return pd.Series(out)

    item = F.struct("seg_id", "ax", "ay", "bx", "by")
    packed = segments.groupBy("page_id").agg(F.collect_list(item).alias("_s"))
    labels = united(*[F.col(f"_s.{c}") for c in ("seg_id", "ax", "ay", "bx", "by")])
    rows = packed.select("page_id", F.explode(F.arrays_zip(F.col("_s").alias("s"), labels.alias("component"))).alias("z"))
    return rows.select("page_id", "z.s.*", "z.component")


def _united(segments: DataFrame, gutter: float) -> DataFrame:
    """Segments with their ``component``: a page of few is one row, a crowded one takes rounds of joins."""
    columns = ["seg_id", "ax", "ay", "bx", "by"]
    segments = segments.select("page_id", *columns)
    if any(segments.schema[c].dataType.typeName() not in ("long", "integer", "short", "byte") for c in columns):
        return connected_components(segments, collinear_pairs(segments, gutter), node="seg_id")
    null = reduce(Column.__or__, [F.col(c).isNull() for c in columns])
    few = F.col("page_id").isNotNull() & (F.count(F.lit(1)) <= FEW_TO_PAIR) & (F.count_if(null) == 0)
    pages = cut_lineage(segments.groupBy("page_id").agg(few.alias("_few")))
    crowded = pages.where("NOT _few").select("page_id")
    if crowded.isEmpty():
        return _united_pages(segments, gutter)
    here = F.col("page_id").eqNullSafe(F.col("_page"))
    crowded = crowded.withColumnRenamed("page_id", "_page")
    rest = cut_lineage(segments.join(crowded, here, "left_semi"))
    light = _united_pages(segments.join(crowded, here, "left_anti"), gutter)
    return light.unionByName(connected_components(rest, collinear_pairs(rest, gutter), node="seg_id"))


def union_segments(segments: DataFrame, gutter: float) -> DataFrame:
    """Merge collinear segments; the union spans their outermost end points."""
    grouped = _united(segments, gutter)
    wide = F.abs(F.col("bx") - F.col("ax")) >= F.abs(F.col("by") - F.col("ay"))
    ends = grouped.select("page_id", "component", F.col("seg_id"), wide.alias("wide"), F.explode(F.array(
        F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e"))
    by_x, by_y = F.struct("e.x", "e.y"), F.struct("e.y", "e.x")
    out = ends.groupBy("page_id", "component").agg(
        F.count_distinct("seg_id").alias("parts"), (F.count_if("wide") * 2 >= F.count(F.lit(1))).alias("wide"),
        F.min_by("e", by_x).alias("x0"), F.max_by("e", by_x).alias("x1"),
        F.min_by("e", by_y).alias("y0"), F.max_by("e", by_y).alias("y1"))
    a, b = F.when(F.col("wide"), F.col("x0")).otherwise(F.col("y0")), F.when(F.col("wide"), F.col("x1")).otherwise(F.col("y1"))
    return out.select("page_id", F.col("component").alias("seg_id"), "parts",
                      a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


# --- the whole layout -------------------------------------------------------


def not_small(panels: DataFrame, page_w, page_h, ratio: float) -> DataFrame:
    return panels.where(~filters.is_small(F.col("r") - F.col("x"), F.col("b") - F.col("y"), page_w, page_h, ratio))


def layout(panels: DataFrame, segments: DataFrame, page_w, page_h, ratio: float = 0.1,
           expand_panels: bool = True, ltr: bool = False) -> DataFrame:
    """Panel boxes and segments to numbered panels; an empty page is one panel."""
    pages = panels.select("page_id").distinct()
    tiny = filters.is_small(F.col("r") - F.col("x"), F.col("b") - F.col("y"), page_w, page_h, ratio, 0.1)
    p = group_small(panels.where(~tiny), page_w, page_h, ratio)
    p = merge_contained(not_small(p, page_w, page_h, ratio))
    p = cut_lineage(not_small(deoverlap(p), page_w, page_h, ratio))
    if expand_panels:
        p = expand(p)
    whole = pages.join(p.select("page_id"), "page_id", "left_anti").select(
        "page_id", F.lit(0).cast("bigint").alias("panel_id"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"),
        F.lit(page_w).cast("bigint").alias("r"), F.lit(page_h).cast("bigint").alias("b"))
    p = group_big(p.select(*_BOX).unionByName(whole), segments)
    return reading_order(p, ltr)
