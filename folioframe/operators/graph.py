"""Connected components and spanning forests as rounds of joins.

Vertices are ``(page_id, id)`` with BIGINT ids, edges ``(page_id, u, v)``.  Every
round works on all pages at once and ends in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.session import cut_lineage

#: Rounds shrink paths geometrically, so this is far above any real need.
MAX_ROUNDS = 100


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u: one aggregate, no join."""
    ends = edges.select("page_id", F.explode(F.array(
        F.struct(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("page_id", "e.*")
    seen = ends.groupBy("page_id", "n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def _link_larger(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of every vertex to its smallest neighbour."""
    both = edges.unionByName(edges.select("page_id", F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("page_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(low, ["page_id", "u"])
        .select("page_id", F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _link_smaller(edges: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of every vertex, and itself, to the smallest."""
    down = edges.select("page_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("page_id", "u").agg(F.min("v").alias("m"))
    moved = (
        down.join(low, ["page_id", "u"]).where("v <> m")
        .select("page_id", F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(low.select("page_id", "u", F.col("m").alias("v"))).distinct()


def component_links(edges: DataFrame) -> DataFrame:
    """``(page_id, u, v)``: every non-root vertex u with its root v.

    Alternates the two linking steps until the edge set is a set of stars.  Both
    aggregate with ``min`` before the shuffle, so a vertex with very many edges
    stays cheap, and each vertex keeps one edge at the end.
    """
    # oriented from the larger to the smaller id, like the result
    current = cut_lineage(edges.where("u <> v").select("page_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    for _ in range(MAX_ROUNDS):
        if _are_stars(current):
            return current
        current = cut_lineage(_link_smaller(_link_larger(current)))
    raise RuntimeError("connected components did not converge")


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "quad_id") -> DataFrame:
    """Add ``component``, the smallest vertex id reachable on the page."""
    links = component_links(edges).select("page_id", F.col("u").alias(node), F.col("v").alias("_root"))
    return (
        nodes.join(links, ["page_id", node], "left")
        .withColumn("component", F.coalesce("_root", F.col(node))).drop("_root")
    )


#: Points of a cell up to which the search radius may grow while fragments are still found.
CROWD = 16


def _pitch(column: str, radius: float):
    return F.floor(F.col(column) / F.lit(float(radius))).cast("bigint")


def _crowd(points: DataFrame, radius: float) -> int:
    """Most points in a cell of pitch ``radius``."""
    cells = points.groupBy("page_id", "component", _pitch("x", radius).alias("gx"), _pitch("y", radius).alias("gy")).count()
    return cells.agg(F.max("count")).first()[0] or 0


def _around(rows: DataFrame, *keep) -> DataFrame:
    """Rows of a grid, copied to the nine cells around their own."""
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return rows.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).select(
        "page_id", "component", (F.col("_gx") + F.col("_dx")).alias("_gx"), (F.col("_gy") + F.col("_dy")).alias("_gy"), *keep)


def _nearest_outside(points: DataFrame, fragments: DataFrame, radius: float) -> DataFrame:
    """Cheapest edge of every fragment to another one within ``radius``.

    Rows meet in grid cells of pitch ``radius``; the right side is copied to the
    nine cells around it. A census of the cells comes first: where a cell and
    those around it hold one fragment, its points have nothing to look for, so
    the inside of a large fragment is never paired with itself. Fragments without
    such an edge get no row.
    """
    p = points.join(fragments, ["page_id", "id"]).withColumns({"_gx": _pitch("x", radius), "_gy": _pitch("y", radius)})
    cell = ["page_id", "component", "_gx", "_gy"]
    census = p.groupBy(*cell).agg(F.min("fragment").alias("_low"), F.max("fragment").alias("_high"))
    mixed = _around(census, "_low", "_high").groupBy(*cell).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")).where("_low <> _high").select(*cell)
    p = cut_lineage(p.join(mixed, cell, "left_semi"))
    l = p.select(*cell, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("fragment").alias("fa"))  # noqa: E741
    r = _around(p, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("fragment").alias("fb"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    near = (
        l.join(r, cell)
        .where((F.col("fa") != F.col("fb")) & (dx * dx + dy * dy <= float(radius) ** 2))
        .withColumn("w", F.sqrt((dx * dx + dy * dy).cast("double")))
    )
    return near.groupBy("page_id", F.col("fa").alias("fragment")).agg(
        F.min(F.struct("w", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))).alias("e"))


def spanning_forest(points: DataFrame, start_radius: float = 64.0) -> DataFrame:
    """Minimum spanning tree of every component: ``(page_id, component, u, v, w)``.

    ``points`` is ``(page_id, component, id, x, y)``; edge weights are distances
    and ties go to the smaller ids, so the tree is unique.  Fragments grow by
    their cheapest edge; an edge within the current radius is cheaper than any
    beyond it, so a radius is searched out before it doubles, and the complete
    graph of a component is never built.  Where points are crowded the search
    begins with a small radius, which grows only when nothing is left within it:
    a cell then holds few points, or points of few fragments.  Points that
    coincide are chained to their first one beforehand.
    """
    spot = ["page_id", "component", "x", "y"]
    first = points.groupBy(*spot).agg(F.min("id").alias("rep"))
    chained = (
        points.join(first, spot).where("id <> rep")
        .select("page_id", "component", F.col("rep").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("w"))
    )
    sites = cut_lineage(first.select("page_id", "component", F.col("rep").alias("id"), "x", "y"))
    tree = chained
    fragments = sites.select("page_id", "id", F.col("id").alias("fragment"))
    parts = sites.select("page_id", "component").distinct().count()
    left = sites.count() - parts
    radius, crowd = start_radius, _crowd(sites, start_radius)
    while crowd > CROWD and radius > 1:  # a cell of half the pitch holds about a quarter
        radius, crowd = radius / 2, crowd / 4
    while left > 0:
        picks = cut_lineage(_nearest_outside(sites, fragments, radius).select("page_id", "fragment", "e.*"))
        chosen = cut_lineage(picks.join(
            sites.select("page_id", F.col("id").alias("u"), "component"), ["page_id", "u"]
        ).select("page_id", "component", "u", "v", "w").distinct())
        found = chosen.count()
        # any radius is exact; a larger one finds more edges per round
        if found == 0 or crowd <= CROWD:
            radius, crowd = (radius * 2, crowd * 4) if found else (radius * 4, crowd * 16)
        if found == 0:
            continue
        left -= found
        tree = tree.unionByName(chosen)
        ends = chosen.join(fragments.select("page_id", F.col("id").alias("u"), F.col("fragment").alias("fu")), ["page_id", "u"])
        ends = ends.join(fragments.select("page_id", F.col("id").alias("v"), F.col("fragment").alias("fv")), ["page_id", "v"])
        links = component_links(ends.select("page_id", F.col("fu").alias("u"), F.col("fv").alias("v")))
        fragments = cut_lineage(
            fragments.join(links.select("page_id", F.col("u").alias("fragment"), F.col("v").alias("_root")), ["page_id", "fragment"], "left")
            .select("page_id", "id", F.coalesce("_root", "fragment").alias("fragment"))
        )
    return cut_lineage(tree)
