"""Line quads against masks: expansion, component assignment and the text mask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.operators import mask as M
from folioframe.operators import raster as R
from folioframe.operators import windows as W
from folioframe.operators.spatial import CELL, box_join, with_cells
from folioframe.session import cut_lineage

#: Fixed value: overlap up to this share does not decide an assignment.
KEEP_THRESHOLD = 1e-2


# --- expansion to the next line ---------------------------------------------


def _meet(p, v, q, w) -> Column:
    """How far to go from p along v to reach the line through q along w."""
    d = v[0] * w[1] - v[1] * w[0]
    t = ((q[0] - p[0]) * w[1] - (q[1] - p[1]) * w[0]) / d
    return F.when(F.abs(d) >= 1e-9, t)


def _sub(a, b):
    return (a[0] - b[0]).cast("double"), (a[1] - b[1]).cast("double")


def _along(p, v, t, rounding) -> Column:
    return G.point(rounding(p[0] + v[0] * t), rounding(p[1] + v[1] * t))


def expand_to_next(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Extend every line toward the one after it, seen from the end of its block.

    Vertical lines grow to the right up to the left edge of the next quad,
    horizontal ones upward to its bottom edge; the last one doubles.
    """
    w = Window.partitionBy("page_id", "block_id").orderBy(F.desc(order))
    df = lines.withColumn("_next", F.lead("pts").over(w))
    q, n = G.corners(F.col("pts")), G.corners(F.col("_next"))
    tl, tr, br, bl = q
    ntl, _, nbr, nbl = n
    same = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    top, low = _sub(tr, tl), _sub(br, bl)
    t1, t2 = _meet(tl, top, ntl, _sub(nbl, ntl)), _meet(bl, low, ntl, _sub(nbl, ntl))
    right = F.array(same(tl), _along(tl, top, t1, F.ceil), _along(bl, low, t2, F.ceil), same(bl))
    right = F.when(t1.isNull() | t2.isNull(), F.col("pts")).otherwise(right)
    up_l, up_r = _sub(tl, bl), _sub(tr, br)
    s1, s2 = _meet(br, up_r, nbr, _sub(nbl, nbr)), _meet(bl, up_l, nbr, _sub(nbl, nbr))
    upper = F.array(_along(bl, up_l, s2, F.ceil), _along(br, up_r, s1, F.ceil), same(br), same(bl))
    upper = F.when(s1.isNull() | s2.isNull(), F.col("pts")).otherwise(upper)
    two = F.lit(2.0)
    keep = lambda v: v
    wide = F.array(same(tl), _along(tl, top, two, keep), _along(bl, low, two, keep), same(bl))
    tall = F.array(_along(bl, up_l, two, keep), _along(br, up_r, two, keep), same(br), same(bl))
    last = F.col("_next").isNull()
    pts = F.when(F.col("vertical"), F.when(last, wide).otherwise(right)).otherwise(F.when(last, tall).otherwise(upper))
    return df.withColumn("expanded", pts).drop("_next")


# --- components to lines ----------------------------------------------------


def clipped_area(pts: Column, x0, y0, x1, y1) -> Column:
    """Area of a convex quad inside an upright box, one half-plane at a time."""
    plane = lambda a, b, c: F.struct(
        F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), c.cast("double").alias("c"))
    planes = F.array(plane(1, 0, x0), plane(-1, 0, -x1), plane(0, 1, y0), plane(0, -1, -y1))
    corner = "array<struct<x:double,y:double>>"

    def cut(poly, h):
        depth = lambda p: h["a"] * p["x"] + h["b"] * p["y"] - h["c"]
        sided = F.transform(poly, lambda p, i: F.struct(
            p["x"].alias("x"), p["y"].alias("y"), depth(p).alias("d"),
            F.element_at(poly, ((i + 1) % F.size(poly) + 1).cast("int")).alias("q")))

        def emit(s):
            dq = depth(s["q"])
            t = s["d"] / (s["d"] - dq)
            cross = F.struct((s["x"] + t * (s["q"]["x"] - s["x"])).alias("x"), (s["y"] + t * (s["q"]["y"] - s["y"])).alias("y"))
            me = F.struct(s["x"].alias("x"), s["y"].alias("y"))
            none = F.array().cast(corner)
            mine = F.when(s["d"] >= 0, F.array(me)).otherwise(none)
            hit = F.when(((s["d"] >= 0) & (dq < 0)) | ((s["d"] < 0) & (dq >= 0)), F.array(cross)).otherwise(none)
            return F.concat(mine, hit)

        return F.flatten(F.transform(sided, emit))

    clipped = F.aggregate(planes, pts.cast(corner), cut)
    terms = lambda poly: F.transform(poly, lambda p, i: (
        p["x"] * F.element_at(poly, ((i + 1) % F.size(poly) + 1).cast("int"))["y"]
        - p["y"] * F.element_at(poly, ((i + 1) % F.size(poly) + 1).cast("int"))["x"]))
    area = G.let(clipped, lambda poly: F.abs(F.aggregate(terms(poly), F.lit(0.0), lambda a, t: a + t)) / 2.0)
    return F.coalesce(area, F.lit(0.0))


def point_distance_sql(pts: str, x: str, y: str) -> str:
    """Distance from a point to a convex quad, 0 inside."""
    turns = ", ".join(
        f"({pts}[{(i + 1) % 4}].x - {pts}[{i}].x) * ({y} - {pts}[{i}].y) - ({pts}[{(i + 1) % 4}].y - {pts}[{i}].y) * ({x} - {pts}[{i}].x)"
        for i in range(4))
    edge = f"array_min(transform({G.segments_sql(pts)}, s -> {G.point_segment_sql('c', 's')}))"
    away = f"transform(array(struct(CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y)), c -> sqrt({edge}))[0]"
    return f"CASE WHEN least({turns}) >= 0 OR greatest({turns}) <= 0 THEN 0.0D ELSE {away} END"


def assign_components(stats: DataFrame, lines: DataFrame) -> DataFrame:
    """Give every mask component of more than nine pixels to one line, or to none.

    The line with the largest overlap wins (the earlier one on a tie) unless the
    component is larger than the line.  With hardly any overlap it goes to the
    nearest line (the later one on a tie) if that is near for its size.  Reach
    depends on the component alone, so the join sees every line that can win.
    """
    cc = stats.where("area > 9").withColumns({
        "mx": F.col("x") + F.col("w") / 2.0, "my": F.col("y") + F.col("h") / 2.0,
        "reach": F.greatest(F.lit(10.0), F.least("w", "h").cast("double")) * 0.5})
    left = with_cells(
        cc, F.least(F.col("x"), F.col("mx") - F.col("reach")), F.least(F.col("y"), F.col("my") - F.col("reach")),
        F.greatest(F.col("x") + F.col("w"), F.col("mx") + F.col("reach")), F.greatest(F.col("y") + F.col("h"), F.col("my") + F.col("reach")))
    # written once: the derived measures would otherwise be expanded into the join
    g = cut_lineage(lines.select("page_id", "quad_id", "pts", "font_size", F.col("area").alias("line_area"), "bx", "by", "bw", "bh"))
    right = with_cells(g, F.col("bx"), F.col("by"), F.col("bx") + F.col("bw"), F.col("by") + F.col("bh"))
    pairs = box_join(left, right, lambda l, r: F.lit(True), ["page_id"])
    l = lambda c: F.col(f"l_{c}")  # noqa: E731, E741
    r = lambda c: F.col(f"r_{c}")
    shared = clipped_area(r("pts"), l("x"), l("y"), l("x") + l("w"), l("y") + l("h"))
    pairs = cut_lineage(pairs.select(
        l("page_id").alias("page_id"), l("component").alias("component"), l("area").alias("area"), l("w").alias("w"), l("h").alias("h"),
        r("quad_id").alias("quad_id"), r("line_area").alias("line_area"), r("font_size").alias("font_size"),
        (shared / F.least(r("line_area"), l("area").cast("double"))).alias("ratio"),
        F.expr(point_distance_sql("r_pts", "l_mx", "l_my")).alias("dist")))
    who = F.struct("quad_id", "line_area", "font_size", "ratio", "dist")
    best = pairs.groupBy("page_id", "component").agg(
        F.max("area").alias("area"), F.max("w").alias("w"), F.max("h").alias("h"),
        F.max_by(who, F.struct(F.round("ratio", 9), -F.col("quad_id"))).alias("most"),
        F.min_by(who, F.struct(F.round("dist", 9), -F.col("quad_id"))).alias("near"))
    unit = F.greatest(F.lit(10.0), F.least(F.col("near.font_size"), F.col("w").cast("double"), F.col("h").cast("double")))
    chosen = (
        F.when((F.col("most.ratio") > 0) & (F.col("area") >= F.col("most.line_area")), F.lit(None))
        .when(F.col("most.ratio") > KEEP_THRESHOLD, F.col("most.quad_id"))
        .when((F.col("near.dist") < unit * 0.5) & (F.col("area") < F.col("near.line_area")), F.col("near.quad_id"))
    )
    return best.select("page_id", "component", chosen.alias("quad_id")).where("quad_id IS NOT NULL")


# --- the text mask ----------------------------------------------------------


def cut_along_boxes(mask: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The mask without the one-pixel outlines of the line boxes, so that lettering across an edge falls apart."""
    right, low = F.col("bx") + F.col("bw") - 1, F.col("by") + F.col("bh") - 1
    row = lambda y, x0, x1: F.struct(y.alias("y"), x0.alias("x0"), x1.alias("x1"))
    sides = F.transform(F.sequence(F.col("by"), low), lambda y: row(y, F.col("bx"), F.col("bx")))
    other = F.transform(F.sequence(F.col("by"), low), lambda y: row(y, right, right))
    ends = F.array(row(F.col("by"), F.col("bx"), right), row(low, F.col("bx"), right))
    outline = lines.where("bw > 0 AND bh > 0").select("page_id", F.inline(F.concat(sides, other, ends)))
    return M.intersect(mask, M.invert(M.clip(outline, pages), pages))


def fit_text(lines: DataFrame, mask: DataFrame, pages: DataFrame, offset: float, kernel: int) -> DataFrame:
    """Components of the mask, cut along the line boxes, go to lines, grow by a
    kernel that follows the line's text size, are united and grow once more."""
    labelled = cut_lineage(M.components(cut_along_boxes(mask, lines, pages)))
    stats = cut_lineage(M.component_stats(labelled))
    owner = cut_lineage(assign_components(stats, lines))
    boxes = owner.join(stats, ["page_id", "component"]).groupBy("page_id", "quad_id").agg(
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))
    sized = boxes.join(lines.select("page_id", "quad_id", "font_size"), ["page_id", "quad_id"])
    text = F.least(F.col("font_size"), F.col("w").cast("double"), F.col("h").cast("double"))
    sized = sized.select("page_id", "quad_id", M.line_dilate_size(text, offset).alias("size"))
    runs = labelled.join(owner, ["page_id", "component"]).join(sized, ["page_id", "quad_id"]).select("page_id", "y", "x0", "x1", "size")
    return M.dilate(M.dilate_sized(runs, "size", pages), M.ellipse_kernel(kernel), pages)


def work_sizes(pages: DataFrame, mask_height: str = "height") -> DataFrame:
    """Pages with the ``factor`` and size at which their text mask is made."""
    tall = F.col(mask_height).cast("double")
    factor = F.least(F.greatest((tall - F.col("height") / F.lit(3.0)) / tall, F.lit(0.5)), F.lit(1.0))
    return pages.select("page_id", "width", "height", factor.alias("factor")).withColumns({
        "to_w": (F.col("width") * F.col("factor")).cast("bigint"), "to_h": (F.col("height") * F.col("factor")).cast("bigint")})


def not_in_bubbles(mask: DataFrame, rgb: DataFrame, pages: DataFrame, bubble: int) -> DataFrame:
    """Blobs of the mask, grown by a kernel that follows the page, without those whose surroundings are no bubble.

    A pixel meets the boxes of its grid cell only. A page too small for a kernel
    leaves its blobs as they are.
    """
    grown = M.dilate_boxed(mask.join(pages.select("page_id", M.page_kernel_size(F.col("width"), F.col("height")).alias("size")), "page_id"), "size", pages)
    blobs = cut_lineage(M.components(grown))
    box = cut_lineage(M.component_stats(blobs).select("page_id", "component", F.col("x").alias("left"), F.col("y").alias("top"), "w", "h"))
    cells = with_cells(box, F.col("left"), F.col("top"), F.col("left") + F.col("w") - 1, F.col("top") + F.col("h") - 1).drop("_x0", "_y0", "_x1", "_y1")
    at = lambda c: F.floor(F.col(c) / F.lit(CELL)).cast("bigint")
    crops = rgb.withColumns({"_cx": at("x"), "_cy": at("y")}).join(cells, ["page_id", "_cx", "_cy"]).where(
        F.col("x").between(F.col("left"), F.col("left") + F.col("w") - 1) & F.col("y").between(F.col("top"), F.col("top") + F.col("h") - 1))
    crops = crops.select("page_id", "component", (F.col("y") - F.col("top")).alias("y"), (F.col("x") - F.col("left")).alias("x"),
                         "r", "g", "b", F.col("w").alias("width"), F.col("h").alias("height"))
    drop = R.ignore_region(crops, ["page_id", "component"], bubble).where("ignore").select("page_id", "component")
    return blobs.join(drop, ["page_id", "component"], "left_anti").select("page_id", "y", "x0", "x1")


def text_mask(lines: DataFrame, mask: DataFrame, pages: DataFrame, rgb: DataFrame | None = None, offset: float = 20.0, kernel: int = 3,
              bubble: int = 0, method: str = "fit", expand: bool = False, scale: bool = True) -> DataFrame:
    """Mask of the lettering of all lines, as runs.

    ``lines`` carry geometry, with ``expand`` also ``block_id`` and ``line_no``:
    they then reach to the next line. ``fit`` follows the lettering found in the
    page mask, at the reduced size of :func:`work_sizes` unless ``scale`` is
    off; ``fill`` takes the line boxes whole. With ``bubble`` in 1..50, blobs
    whose surroundings are no bubble are removed.
    """
    if method not in ("fit", "fill"):
        raise ValueError(f"no method {method!r}")
    measure = lambda df: cut_lineage(G.with_geometry(G.with_corner_order(cut_lineage(df))))
    # the geometry is a long expression; written here, no branch carries it into its joins
    lines = cut_lineage(lines)
    if expand:
        whole = F.transform("expanded", lambda p: F.struct(p["x"].cast("bigint").alias("x"), p["y"].cast("bigint").alias("y")))
        lines = measure(expand_to_next(lines).select("page_id", "quad_id", whole.alias("pts")))
    if method == "fill":
        final = M.fill_boxes(cut_lineage(lines.select("page_id", *(F.col(f"b{c}").cast("bigint").alias(c) for c in "xywh"))), pages)
    elif scale:
        sizes = cut_lineage(work_sizes(pages))
        small = sizes.select("page_id", F.col("to_w").alias("width"), F.col("to_h").alias("height"))
        scaled = measure(lines.join(sizes.select("page_id", "factor"), "page_id").select(
            "page_id", "quad_id", G.scale(F.col("pts"), F.col("factor")).alias("pts")))
        final = fit_text(scaled, M.resize_runs(mask, sizes), small, offset, kernel)
        back = sizes.select("page_id", F.col("to_w").alias("width"), F.col("to_h").alias("height"), F.col("width").alias("to_w"), F.col("height").alias("to_h"))
        final = M.resize_runs(final, back)
    else:
        final = fit_text(lines, mask, pages, offset, kernel)
    if not 1 <= bubble <= 50 or rgb is None:
        return final
    return not_in_bubbles(final, rgb, pages, bubble)


# --- refinement inside block windows ----------------------------------------


def refine_masks(rgb: DataFrame, windows: DataFrame, inpaint: bool = False) -> DataFrame:
    """Refine the predicted mask around every block and unite the results.

    ``rgb`` holds ``page_id, y, x, r, g, b`` and the prediction ``v``;
    ``windows`` holds ``page_id, block_id, x1, y1, x2, y2`` (ends exclusive).
    Each window proposes masks from its dominant greys and from Otsu thresholds;
    in the order of their distance to the prediction, components are added while
    they bring the result closer, and small holes are closed.

    A window of up to :data:`windows.FEW_PIXELS` is one row; larger ones, and those
    whose pixels are null or there twice, go through rounds of joins in step.
    """
    windows = cut_lineage(windows)
    packed = cut_lineage(W.pack(rgb, windows))
    moved = W.refined(packed.where("few"), inpaint)
    crowded = packed.where("NOT few").select(*[F.col(c).alias(f"_{c}") for c in W.KEY])
    if not crowded.isEmpty():
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in W.KEY])
        moved = moved.unionByName(_refine_crowded(rgb, cut_lineage(windows.join(crowded, same, "left_semi")), inpaint))
    return M.union(moved)


def _refine_crowded(rgb: DataFrame, windows: DataFrame, inpaint: bool) -> DataFrame:
    """:func:`refine_masks` of windows of any size: one row per pixel and candidate, runs of the results."""
    key = ["page_id"]
    cells = with_cells(windows, F.col("x1"), F.col("y1"), F.col("x2") - 1, F.col("y2") - 1).drop("_x0", "_y0", "_x1", "_y1")
    at = lambda c: F.floor(F.col(c) / F.lit(512)).cast("bigint")
    px = rgb.withColumns({"_cx": at("x"), "_cy": at("y")}).join(cells, ["page_id", "_cx", "_cy"]).where(
        "x >= x1 AND x < x2 AND y >= y1 AND y < y2")
    # a window is a page of its own from here on
    px = cut_lineage(px.select(
        F.struct("page_id", "block_id", "x1", "y1").alias("page_id"), (F.col("y") - F.col("y1")).alias("y"), (F.col("x") - F.col("x1")).alias("x"),
        "r", "g", "b", "v", R.byte(R.luma(F.col("r"), F.col("g"), F.col("b"))).alias("gray"),
        (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height")))
    pages = px.groupBy("page_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    core = M.to_pixels(M.erode(M.to_runs(px.where("v > 127")), M.box_kernel(3)))
    seeds = core.join(px, ["page_id", "y", "x"]).select("page_id", F.col("gray").alias("v"))
    colors = R.top_colors(R.gray_bins(seeds, key), key).select("page_id", F.posexplode("colors").alias("rank", "color"))
    high = F.least(F.col("color") + 30, F.lit(255))
    tops = px.join(colors, "page_id").select("page_id", "rank", "y", "x", "v", F.col("gray").between(high - 60, high).alias("on"))
    limits = R.otsu_threshold(R.split_channels(px), [*key, "channel"])
    planes = R.split_channels(px).withColumnRenamed("v", "level").join(limits, [*key, "channel"])
    planes = planes.join(px.select("page_id", "y", "x", "v"), ["page_id", "y", "x"])
    rank = F.when(F.col("channel") == "r", 10).when(F.col("channel") == "g", 11).otherwise(12)
    otsu = planes.select("page_id", rank.alias("rank"), "y", "x", "v", (F.col("level") > F.col("threshold")).alias("on"))
    both = cut_lineage(tops.unionByName(otsu))
    scores = R.xor_score(both, [*key, "rank"], F.when(F.col("on"), 255).otherwise(0), F.col("v"))
    # only the best of the three Otsu planes takes part
    group = F.when(F.col("rank") >= 10, F.lit(10)).otherwise(F.col("rank"))
    first = Window.partitionBy("page_id", "_g").orderBy("score", "rank")
    scores = scores.withColumn("_g", group).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("score", "rank"))
    scores = scores.select("page_id", "rank", "inverted", place.alias("place"))
    # a window and a place make one page, so all candidates are labelled together
    masks = M.to_runs(both.join(scores, [*key, "rank"]).where(F.col("on") != F.col("inverted")).select(
        F.struct("page_id", "place").alias("page_id"), "y", "x"))
    blobs = cut_lineage(M.components(masks))
    worth = M.component_stats(blobs).where("w * h >= 3").select("page_id", "component")
    blobs = cut_lineage(blobs.join(worth, ["page_id", "component"], "left_semi").select(
        F.col("page_id.page_id").alias("page_id"), F.col("page_id.place").alias("place"), "component", "y", "x0", "x1"))
    cross = [(-1, 0, 0), (0, -1, 1), (1, 0, 0)]
    pred = cut_lineage(M.erode(M.to_runs(px.where("v > 60")), cross))
    merged = pred.limit(0)
    for n in range(1, 5):
        merged = M.merge_if_better(merged, blobs.where(F.col("place") == n).drop("place"), pred)
        if inpaint:
            merged = M.dilate(merged, M.box_kernel(5), pages)
        merged = cut_lineage(M.fill_holes(merged, pred, pages))
    return merged.select(
        F.col("page_id.page_id").alias("page_id"), (F.col("y") + F.col("page_id.y1")).alias("y"),
        (F.col("x0") + F.col("page_id.x1")).alias("x0"), (F.col("x1") + F.col("page_id.x1")).alias("x1"))
