"""Projections on quads and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.operators import blocks as B
from folioframe.operators import plans_table as PT
from folioframe.plans.registry import query
from folioframe.plans.sqltext import BOX_LINES, SLANTED_GEO
from folioframe.plans.views import ctes, slanted, textlines

def _pts():
    return F.col("pts")


def _flat(df, *keep):
    """Corner columns instead of the nested quad."""
    cols = [c.alias(n) for i, (x, y) in enumerate(G.corners(_pts())) for c, n in ((x, f"x{i}"), (y, f"y{i}"))]
    return df.select(*keep, *cols)


def _r6(c):
    return F.round(c, 6)


@query("p1_corner_order", sql=ctes("slanted") + """
SELECT quad_id, x0, y0, x1, y1, x2, y2, x3, y3, false AS vertical FROM slanted""")
def p1_corner_order(spark, sf):
    df = slanted(spark, sf)
    shift = (F.col("quad_id") % 4).cast("int")
    turned = F.concat(F.slice(_pts(), shift + 1, F.lit(4)), F.slice(_pts(), F.lit(1), shift))
    return _flat(G.with_corner_order(df.withColumn("pts", turned)), "quad_id", "vertical")


@query("p1_corner_order_upright", sql=BOX_LINES + """
SELECT quad_id, x0, y0, x1, y1, x2, y2, x3, y3, vertical FROM boxes""")
def p1_corner_order_upright(spark, sf):
    df = textlines(spark, sf).withColumn("pts", F.reverse("pts"))
    return _flat(G.with_corner_order(df), "quad_id", "vertical")


@query("p2_aabb", sql=SLANTED_GEO + """
SELECT quad_id, bx AS x, by_ AS y, bw AS w, bh AS h, ex AS x2, ey AS y2 FROM geo""")
def p2_aabb(spark, sf):
    x, y, x2, y2 = G.bounds(_pts())
    return slanted(spark, sf).select(
        "quad_id", x.alias("x"), y.alias("y"), (x2 - x).alias("w"), (y2 - y).alias("h"), x2.alias("x2"), y2.alias("y2"))


@query("p3_p9_measures", sql=SLANTED_GEO + """
SELECT quad_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(aspect, 6) AS aspect, round(fs, 6) AS font_size,
 round(angle, 6) AS angle, round(area, 6) AS area, aligned FROM geo""")
def p3_p9_measures(spark, sf):
    return G.with_geometry(slanted(spark, sf)).select(
        "quad_id", _r6("cx").alias("cx"), _r6("cy").alias("cy"), _r6("aspect").alias("aspect"),
        _r6("font_size").alias("font_size"), _r6("angle").alias("angle"), _r6("area").alias("area"), "aligned")


@query("p4_midpoints", sql=ctes("slanted") + """
SELECT quad_id, (x0 + x1) // 2 AS ax, (y0 + y1) // 2 AS ay, (x2 + x3) // 2 AS bx, (y2 + y3) // 2 AS "by",
 (x1 + x2) // 2 AS cx, (y1 + y2) // 2 AS cy, (x3 + x0) // 2 AS dx, (y3 + y0) // 2 AS dy FROM slanted""")
def p4_midpoints(spark, sf):
    m = G.midpoints(_pts())
    return slanted(spark, sf).select(
        "quad_id", *[c.alias(n + k) for n, p in zip("abcd", m) for c, k in zip(p, "xy")])


@query("p10_scale", sql=ctes("slanted") + """
SELECT quad_id, """ + ", ".join(f"CAST(trunc({k}{i} * 1.37::DOUBLE) AS BIGINT) AS {k}{i}" for i in range(4) for k in "xy") + " FROM slanted")
def p10_scale(spark, sf):
    df = slanted(spark, sf)
    return _flat(df.withColumn("pts", G.scale(_pts(), F.lit(1.37))), "quad_id")


@query("p11_rotate_back", sql=ctes("slanted") + """
SELECT quad_id, """ + ", ".join(f"y{i} AS x{i}, 4000 - x{i} AS y{i}" for i in range(4)) + " FROM slanted")
def p11_rotate_back(spark, sf):
    return _flat(slanted(spark, sf).withColumn("pts", G.rotate_back(_pts(), F.lit(4000))), "quad_id")


@query("p12_rescale", sql=ctes("slanted") + """
SELECT quad_id, """ + ", ".join(
    f"CAST(trunc(least(greatest(round({k}{i} / {net}::DOUBLE * {dest}), 0), {dest}) * {ratio}::DOUBLE) AS BIGINT) AS {k}{i}"
    for i in range(4) for k, net, dest, ratio in (("x", "2048.0", "1500", "0.8"), ("y", "1024.0", "300", "1.25"))) + " FROM slanted")
def p12_rescale(spark, sf):
    pts = G.rescale(_pts(), F.lit(2048.0), F.lit(1024.0), F.lit(1500), F.lit(300), F.lit(0.8), F.lit(1.25))
    return _flat(slanted(spark, sf).withColumn("pts", pts), "quad_id")


@query("p13_roll_to_origin", sql=ctes("slanted") + """
, r AS (SELECT *, quad_id % 4 AS k0 FROM slanted), t AS (SELECT quad_id, """ + ", ".join(
    f"CASE k0 " + " ".join(f"WHEN {s} THEN {k}{(i + s) % 4}" for s in range(4)) + f" END AS {k}{i}" for i in range(4) for k in "xy") + """ FROM r),
 m AS (SELECT *, least(x0 + y0, x1 + y1, x2 + y2, x3 + y3) AS lo FROM t),
 p AS (SELECT *, CASE WHEN x0 + y0 = lo THEN 0 WHEN x1 + y1 = lo THEN 1 WHEN x2 + y2 = lo THEN 2 ELSE 3 END AS s FROM m)
SELECT quad_id, """ + ", ".join(
    f"CASE s " + " ".join(f"WHEN {s} THEN {k}{(i + s) % 4}" for s in range(4)) + f" END AS {k}{i}" for i in range(4) for k in "xy") + " FROM p")
def p13_roll_to_origin(spark, sf):
    shift = (F.col("quad_id") % 4).cast("int")
    turned = F.concat(F.slice(_pts(), shift + 1, F.lit(4)), F.slice(_pts(), F.lit(1), shift))
    df = slanted(spark, sf).withColumn("pts", turned)
    return _flat(df.withColumn("pts", G.roll_to_origin(_pts())), "quad_id")


@query("p14_unclip", sql=ctes("textlines") + """
, u AS (SELECT quad_id, x, y, w, h, (w * h * 1.8::DOUBLE) / (2 * (w + h)) AS d FROM textlines)
SELECT quad_id, round(x - d, 6) AS x, round(y - d, 6) AS y, round(w + 2 * d, 6) AS w, round(h + 2 * d, 6) AS h FROM u""")
def p14_unclip(spark, sf):
    x, y, x2, y2 = G.bounds(_pts())
    df = textlines(spark, sf).select("quad_id", x.alias("x"), y.alias("y"), (x2 - x).alias("w"), (y2 - y).alias("h"))
    d = G.unclip_offset(F.col("w"), F.col("h"), 1.8)
    return df.select("quad_id", _r6(F.col("x") - d).alias("x"), _r6(F.col("y") - d).alias("y"),
                     _r6(F.col("w") + d * 2).alias("w"), _r6(F.col("h") + d * 2).alias("h"))


_BLOCK_SQL = SLANTED_GEO + """
, b AS (SELECT page_id, (quad_id % 20) // 5 AS block_no, min(bx) AS x0, min(by_) AS y0, max(ex) AS x1, max(ey) AS y1,
   CAST(min(quad_id) % 7 * 10 AS DOUBLE) AS angle FROM geo GROUP BY ALL)"""


def _slanted_blocks(spark, sf):
    return (
        slanted(spark, sf)
        .groupBy("page_id", ((F.col("quad_id") % 20) / F.lit(5)).cast("bigint").alias("block_no"))
        .agg(F.collect_list("pts").alias("lines"), (F.min("quad_id") % 7 * 10).cast("double").alias("angle"))
    )


@query("p15_block_bounds", sql=_BLOCK_SQL + """
SELECT page_id, block_no, x0, y0, x1, y1, (x0 + x1) // 2 AS mid_x, (y0 + y1) // 2 AS mid_y FROM b""")
def p15_block_bounds(spark, sf):
    return G.with_block_min_rect(_slanted_blocks(spark, sf)).select(
        "page_id", "block_no", "x0", "y0", "x1", "y1", "mid_x", "mid_y")


_TURN = lambda x, y, c, s: (f"round(({x}) * {c} - ({y}) * {s} + mx)", f"round(({x}) * {s} + ({y}) * {c} + my)")
_UP = _TURN("px - mx", "py - my", "cos(-a)", "sin(-a)")


def _back(px, py):
    x, y = _TURN(f"{px} - mx", f"{py} - my", "cos(a)", "sin(a)")
    return (f"CAST(greatest(0, CASE WHEN a = 0 THEN {px} ELSE {x} END) AS BIGINT)",
            f"CAST(greatest(0, CASE WHEN a = 0 THEN {py} ELSE {y} END) AS BIGINT)")


@query("p16_p17_block_min_rect", sql=_BLOCK_SQL + f"""
, c AS (SELECT page_id, block_no, radians(angle) AS a, (x0 + x1) // 2 AS mx, (y0 + y1) // 2 AS my FROM b),
 p AS (SELECT page_id, (quad_id % 20) // 5 AS block_no, unnest([x0, x1, x2, x3]) AS px, unnest([y0, y1, y2, y3]) AS py FROM slanted),
 t AS (SELECT c.*, CASE WHEN a = 0 THEN px ELSE {_UP[0]} END AS ux, CASE WHEN a = 0 THEN py ELSE {_UP[1]} END AS uy FROM p JOIN c USING (page_id, block_no)),
 u AS (SELECT page_id, block_no, a, mx, my, min(ux) AS lx, min(uy) AS ly, max(ux) AS hx, max(uy) AS hy FROM t GROUP BY ALL)
SELECT page_id, block_no, {", ".join(f"{v} AS {k}{i}" for i, (px, py) in enumerate((("lx", "ly"), ("hx", "ly"), ("hx", "hy"), ("lx", "hy"))) for v, k in zip(_back(px, py), "xy"))} FROM u""")
def p16_p17_block_min_rect(spark, sf):
    df = G.with_block_min_rect(_slanted_blocks(spark, sf)).withColumn("pts", F.col("min_rect"))
    return _flat(df, "page_id", "block_no")


# every corner-pair direction is tried; the narrowest box over them is the hull's
@query("p18_obb", sql=ctes("slanted") + """
, p AS (SELECT page_id, (quad_id % 20) // 5 AS block_no, unnest([x0, x1, x2, x3]) AS px, unnest([y0, y1, y2, y3]) AS py FROM slanted),
 dir AS (SELECT DISTINCT a.page_id, a.block_no, b.px - a.px AS dx, b.py - a.py AS dy FROM p a JOIN p b USING (page_id, block_no)
   WHERE b.px - a.px > 0 OR (b.px = a.px AND b.py > a.py)),
 box AS (SELECT page_id, block_no, dx, dy, (max(px * dx + py * dy) - min(px * dx + py * dy)) / sqrt(dx * dx + dy * dy) AS along,
   (max(py * dx - px * dy) - min(py * dx - px * dy)) / sqrt(dx * dx + dy * dy) AS across FROM dir JOIN p USING (page_id, block_no) GROUP BY page_id, block_no, dx, dy)
SELECT page_id, block_no, round(min(along * across), 3) AS area FROM box GROUP BY page_id, block_no""")
def p18_obb(spark, sf):
    df = B.with_obb(_slanted_blocks(spark, sf))
    return df.select("page_id", "block_no", F.round(F.col("obb.w") * F.col("obb.h"), 3).alias("area"))


@query("p19_p24_obb_corners", sql=ctes("textlines") + """
, t AS (SELECT quad_id, x + w / 2.0 AS cx, y + h / 2.0 AS cy, w, h, radians((quad_id % 36) * 10) AS th FROM textlines)
SELECT quad_id, round(degrees(th), 4) AS degrees, round(cx - w / 2.0 * cos(th) + h / 2.0 * sin(th), 4) AS left_x,
 round(cy - w / 2.0 * sin(th) - h / 2.0 * cos(th), 4) AS top_y,
 round(cx - (w / 2.0 * abs(cos(th)) + h / 2.0 * abs(sin(th))), 4) AS x1, round(cy - (w / 2.0 * abs(sin(th)) + h / 2.0 * abs(cos(th))), 4) AS y1,
 round(cx + (w / 2.0 * abs(cos(th)) + h / 2.0 * abs(sin(th))), 4) AS x2, round(cy + (w / 2.0 * abs(sin(th)) + h / 2.0 * abs(cos(th))), 4) AS y2 FROM t""")
def p19_p24_obb_corners(spark, sf):
    x, y, x2, y2 = G.bounds(_pts())
    df = textlines(spark, sf).select(
        "quad_id", ((x + x2) / 2.0).alias("cx"), ((y + y2) / 2.0).alias("cy"), (x2 - x).alias("w"), (y2 - y).alias("h"),
        F.radians((F.col("quad_id") % 36) * 10).alias("th"))
    args = [F.col(c) for c in ("cx", "cy", "w", "h", "th")]
    lx, ty = G.obb_top_left(*args)
    b = G.rotated_bounds(args[2], args[3], args[0], args[1], args[4])
    return df.select("quad_id", F.round(F.degrees("th"), 4).alias("degrees"), F.round(lx, 4).alias("left_x"), F.round(ty, 4).alias("top_y"),
                     *[F.round(v, 4).alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"))])


@query("p21_p22_grow_boxes", sql=ctes("textlines") + """
, r AS (SELECT *, (-(w + h) + sqrt((w + h) * (w + h) + 4.0::DOUBLE * 1.5 * w * h)) / 2.0::DOUBLE AS root FROM textlines),
 d AS (SELECT *, CAST(round(root / 2.0) AS BIGINT) AS delta FROM r),
 e AS (SELECT *, least(x, 2000 - (x + w), delta) AS dx, least(y, 2000 - (y + h), delta) AS dy FROM d)
SELECT quad_id, x - dx AS wx1, y - dy AS wy1, x + w + dx AS wx2, y + h + dy AS wy2,
 greatest(x - 50, 0) AS rx, greatest(y - 70, 0) AS ry, least(w + 100, 2000 - greatest(x - 50, 0) - 1) AS rw, least(h + 140, 600 - greatest(y - 70, 0) - 1) AS rh FROM e""")
def p21_p22_grow_boxes(spark, sf):
    a, b, c, d = G.bounds(_pts())
    df = textlines(spark, sf).select("quad_id", a.alias("x"), b.alias("y"), c.alias("x2"), d.alias("y2"))
    x, y, x2, y2 = (F.col(n) for n in ("x", "y", "x2", "y2"))
    win = G.enlarge_window(x, y, x2, y2, F.lit(2000), F.lit(2000), 2.5, 1.0)
    ex = G.extend_rect(x, y, x2 - x, y2 - y, F.lit(2000), F.lit(0) + 0, F.lit(50))
    ey = G.extend_rect(x, y, x2 - x, y2 - y, F.lit(0), F.lit(600), F.lit(70))
    return df.select("quad_id", *[v.alias(n) for v, n in zip(win, ("wx1", "wy1", "wx2", "wy2"))],
                     ex[0].alias("rx"), ey[1].alias("ry"), ex[2].alias("rw"), ey[3].alias("rh"))


@query("p23_p25_render_box", sql=ctes("textlines") + """
SELECT quad_id, CASE WHEN quad_id % 3 = 0 THEN w ELSE greatest(w, h) END AS rw, CASE WHEN quad_id % 3 = 0 THEN h ELSE least(w, h) END AS rh,
 CAST(greatest(1, round(least(greatest(least(greatest(w / 4.0, greatest(h - 5.0, 1)), h + 5.0), 12), 26))) AS DOUBLE) AS font_size FROM textlines""")
def p23_p25_render_box(spark, sf):
    x, y, x2, y2 = G.bounds(_pts())
    df = textlines(spark, sf).select("quad_id", (x2 - x).alias("w"), (y2 - y).alias("h"))
    w, h = F.col("w"), F.col("h")
    rw, rh = G.render_size(w, h, F.col("quad_id") % 3 == 0)
    return df.select("quad_id", rw.alias("rw"), rh.alias("rh"), G.final_font_size(w / 4.0, h, 5.0, 12.0, 26.0).cast("double").alias("font_size"))


@query("p26_resize_plans", sql=ctes("panels") + """
, p AS (SELECT panel_id, r AS w, b AS h FROM panels),
 q AS (SELECT *, greatest(w, h) * 1.5::DOUBLE AS goal FROM p),
 k AS (SELECT *, 512.0::DOUBLE / greatest(w, h) AS ratio FROM q),
 s AS (SELECT *, CAST(round(w * ratio) AS BIGINT) AS aw, CAST(round(h * ratio) AS BIGINT) AS ah, least(1024.0::DOUBLE / w, 1024.0::DOUBLE / h) AS lr FROM k)
SELECT panel_id, round(ratio, 6) AS ratio, ((aw + 255) // 256) * 256 AS aspect_w, ((ah + 255) // 256) * 256 AS aspect_h,
 ((w + 7) // 8) * 8 AS mult_w, ((h + 7) // 8) * 8 AS mult_h,
 CAST(round(w * lr) AS BIGINT) AS letter_w, CAST(round(h * lr) AS BIGINT) AS letter_h, 1024 - CAST(round(w * lr) AS BIGINT) AS pad_w, 1024 - CAST(round(h * lr) AS BIGINT) AS pad_h,
 greatest(0, h - w) AS square_pad_w, greatest(0, w - h) AS square_pad_h, least(960, greatest(w, h)) AS limit_side, round(least(greatest((h - h / 3.0::DOUBLE) / h, 0.5), 1.0), 6) AS fit_scale FROM s""")
def p26_resize_plans(spark, sf):
    from folioframe.plans.views import view

    df = view(spark, sf, "panels").select("panel_id", F.col("r").alias("w"), F.col("b").alias("h"))
    return PT.resize_plans(df, square=512, mag=1.5, letterbox=1024, limit=960)


@query("p27_crop_plan", sql=ctes("textlines") + """
, c AS (SELECT quad_id, least(x, 1200) AS x1, least(y, 900) AS y1, least(x + w, 1200) AS x2, least(y + h, 900) AS y2, w, h, h >= w AS vertical FROM textlines)
SELECT quad_id, x1, y1, x2, y2, CASE WHEN vertical THEN 48 ELSE greatest(2, CAST(round(48 * (w::DOUBLE / h)) AS BIGINT)) END AS out_w,
 CASE WHEN vertical THEN greatest(2, CAST(round(48 * (h::DOUBLE / w)) AS BIGINT)) ELSE 48 END AS out_h FROM c""")
def p27_crop_plan(spark, sf):
    df = G.with_corner_order(textlines(spark, sf))
    return PT.crop_plan(df, page_w=F.lit(1200), page_h=F.lit(900), text_height=48)
