"""Spatial self-joins of quads and boxes, bucketed by a per-page grid.

Boxes are laid on a grid; two rows meet only in a shared cell, and a pair is
kept only in the cell that holds the corner of their overlap, so no pair comes
out twice and no shuffle is spent on removing doubles.  Crowded pages spread
over many cells, and AQE splits the cells that are still too large.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.session import cut_lineage

#: Default grid pitch in pixels; a line of ordinary size covers a few cells.
CELL = 512


@dataclass(frozen=True)
class MergeRule:
    """Tolerances of the mergeable-pair predicate."""

    ratio: float = 1.9
    discard: float = 2.0
    gap1: float = 1.0
    gap2: float = 3.0
    font_tol: float = 2.0
    aspect_tol: float = 1.3


#: The rule for merging lines and the one for reading direction.
MERGE_RULE = MergeRule()
DIRECTION_RULE = MergeRule(gap1=0.6, gap2=1.5, font_tol=1.5, aspect_tol=1.0)


def with_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, cell: int = CELL) -> DataFrame:
    """One row per grid cell that the box covers."""
    at = lambda v: F.floor(v / F.lit(cell)).cast("bigint")
    return (
        df.withColumns({"_x0": x0.cast("double"), "_y0": y0.cast("double"),
                        "_x1": x1.cast("double"), "_y1": y1.cast("double")})
        .withColumn("_cx", F.explode(F.sequence(at(F.col("_x0")), at(F.col("_x1")))))
        .withColumn("_cy", F.explode(F.sequence(at(F.col("_y0")), at(F.col("_y1")))))
    )


def box_join(left: DataFrame, right: DataFrame, condition, by: list[str], cell: int = CELL) -> DataFrame:
    """Inner join of two ``with_cells`` tables on overlapping boxes.

    ``condition(l, r)`` gets two column accessors and refines the match.  The
    result holds the columns as ``l_*`` and ``r_*``.
    """
    lt = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    rt = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    l = lambda c: F.col(f"l_{c}")  # noqa: E731, E741
    r = lambda c: F.col(f"r_{c}")
    at = lambda v: F.floor(v / F.lit(cell)).cast("bigint")
    on = l("_cx") == r("_cx")
    on &= l("_cy") == r("_cy")
    for k in by:
        on &= l(k) == r(k)
    on &= (l("_x0") <= r("_x1")) & (r("_x0") <= l("_x1")) & (l("_y0") <= r("_y1")) & (r("_y0") <= l("_y1"))
    on &= at(F.greatest(l("_x0"), r("_x0"))) == l("_cx")
    on &= at(F.greatest(l("_y0"), r("_y0"))) == l("_cy")
    on &= condition(l, r)
    out = lt.join(rt, on)
    return out.drop(*[f"{s}_{c}" for s in "lr" for c in ("_x0", "_y0", "_x1", "_y1", "_cx", "_cy")])


_MEASURES = ("page_id", "quad_id", "pts", "bx", "by", "bw", "bh", "font_size", "aspect", "angle", "aligned")


def _near_sql(rule: MergeRule) -> str:
    """Tests that need no polygon distance; they run inside the join."""
    low = "least(l_font_size, r_font_size)"
    gap = lambda p, s: f"greatest(l_{p} - r_{p} - r_{s}, r_{p} - l_{p} - l_{s}, 0)"
    tol = f"{float(rule.aspect_tol)}D"
    return (
        f"l_quad_id < r_quad_id AND greatest(l_font_size, r_font_size) / {low} <= {float(rule.font_tol)}D"
        f" AND NOT (l_aspect > {tol} AND r_aspect < 1.0D / {tol}) AND NOT (r_aspect > {tol} AND l_aspect < 1.0D / {tol})"
        f" AND {gap('bx', 'bw')} <= {low} * {float(rule.discard)}D AND {gap('by', 'bh')} <= {low} * {float(rule.discard)}D")


def can_merge_sql(dist: str, rule: MergeRule) -> str:
    """The mergeable-pair predicate over ``l_*`` and ``r_*``, given the distance."""
    cs = "least(l_font_size, r_font_size)"
    wide = lambda q: f"{q}_bw > {q}_bh * {float(rule.ratio)}D"
    tall = lambda q: f"{q}_bh > {q}_bw * {float(rule.ratio)}D"
    reach = f"{cs} * {float(rule.gap2)}D"
    edges = lambda p, s: f"(abs(l_{p} - r_{p}) < {reach} OR abs(l_{p} + l_{s} - r_{p} - r_{s}) < {reach})"
    return f"""CASE WHEN {dist} > {cs} * {float(rule.discard)}D THEN false
      WHEN l_aligned AND r_aligned THEN CASE
        WHEN NOT ({dist} < {cs} * {float(rule.gap1)}D) THEN false
        WHEN abs(l_bx + l_bw div 2 - r_bx - r_bw div 2) < {float(rule.gap2)}D THEN true
        WHEN ({wide('l')} AND {tall('r')}) OR ({wide('r')} AND {tall('l')}) THEN false
        WHEN {wide('l')} OR {wide('r')} THEN {edges('bx', 'bw')}
        WHEN {tall('l')} OR {tall('r')} THEN {edges('by', 'bh')}
        ELSE false END
      WHEN NOT (abs(l_angle - r_angle) < radians(15.0D)) THEN false
      WHEN {dist} > {reach} THEN false
      ELSE NOT (abs(l_font_size - r_font_size) / {cs} > 0.25D) END"""


def mergeable_pairs(quads: DataFrame, rule: MergeRule = MERGE_RULE, cell: int = CELL) -> DataFrame:
    """All pairs u < v of a page that may belong together.

    ``quads`` is the output of ``with_geometry``.  Each box grows by half of its
    own reach, which covers every pair within the reach of the smaller font.
    Lines without a font size can never merge and are left out of the join.  The
    measures are written once, since both sides of the join read them.
    """
    slim = cut_lineage(quads.select(*_MEASURES)).where(F.col("font_size") > 0)
    grow = F.col("font_size") * (rule.discard / 2.0)
    cells = with_cells(
        slim, F.col("bx") - grow, F.col("by") - grow,
        F.col("bx") + F.col("bw") + grow, F.col("by") + F.col("bh") + grow, cell)
    pairs = box_join(
        cells, cells,
        lambda l, r: F.expr(_near_sql(rule)), ["page_id"], cell)
    # the distance is bound once: it decides, and it is the result
    dist = f"filter(array({G.quad_distance_sql('l_pts', 'r_pts')}), d -> {can_merge_sql('d', rule)})"
    return pairs.selectExpr("l_page_id AS page_id", "l_quad_id AS u", "r_quad_id AS v", f"explode({dist}) AS dist")


def grouping_edges(quads: DataFrame, rule: MergeRule = MERGE_RULE, cell: int = CELL) -> DataFrame:
    """Edges with the same connected components as ``mergeable_pairs``.

    Exact copies of a quad always merge with each other, so each copy is tied to
    one representative and only distinct quads take part in the pair join.  A
    pile of copies therefore costs one edge per copy instead of one per pair.
    """
    quads = cut_lineage(quads)
    key = ["page_id", "pts"]
    rep = quads.groupBy(*key).agg(
        F.min("quad_id").alias("quad_id"), F.count(F.lit(1)).alias("_copies"),
        *[F.first(c).alias(c) for c in _MEASURES if c not in ("page_id", "pts", "quad_id")])
    pairs = mergeable_pairs(rep, rule, cell).select("page_id", "u", "v")
    piles = rep.where((F.col("_copies") > 1) & (F.col("font_size") > 0)).select(
        F.col("page_id").alias("_p"), F.col("pts").alias("_pts"), F.col("quad_id").alias("u"))
    copies = quads.select("page_id", "pts", F.col("quad_id").alias("v")).join(
        piles, (F.col("page_id") == F.col("_p")) & (F.col("pts") == F.col("_pts")) & (F.col("u") < F.col("v")))
    return pairs.unionByName(copies.select("page_id", "u", "v"))
