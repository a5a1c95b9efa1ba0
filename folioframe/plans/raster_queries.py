"""Pixel statistics, masks, tiles and blending over embeddings read as pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioframe.operators import mask as M
from folioframe.operators import raster as R
from folioframe.plans.registry import query
from folioframe.plans.views import ctes, view
from folioframe.session import cut_lineage

RGB = ctes("rgb")
RAS = ctes("raster")
SIZE = ", sz AS (SELECT page_id, max(x) + 1 AS width, max(y) + 1 AS height FROM {t} GROUP BY page_id)"
LUMA = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"
BYTE = "CAST(least(greatest(round({}), 0), 255) AS BIGINT)"
MASK = RAS + ", mk AS (SELECT page_id, y, x FROM raster WHERE v > 140)" + SIZE.format(t="raster")


def _rgb(spark, sf):
    return view(spark, sf, "rgb")


def _raster(spark, sf):
    return view(spark, sf, "raster")


def _mask(spark, sf, low=140):
    """The mask of bright pixels as runs, and the page sizes."""
    px = _raster(spark, sf)
    return M.to_runs(R.in_range(px, low + 1, 255)), R.page_sizes(px)


@query("r1_luma", sql=RGB + f" SELECT page_id, y, x, round({LUMA}, 6) AS l, round(0.114 * r + 0.587 * g + 0.299 * b, 6) AS l_bgr FROM rgb")
def r1_luma(spark, sf):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return _rgb(spark, sf).select("page_id", "y", "x", F.round(R.luma(r, g, b), 6).alias("l"), F.round(R.luma(b, g, r), 6).alias("l_bgr"))


@query("r2_gamma", sql=RGB + f""", m AS (SELECT page_id, ln(127.5::DOUBLE) / ln(avg({LUMA})) AS k FROM rgb GROUP BY page_id)
SELECT page_id, y, x, {BYTE.format('pow(r / 255.0::DOUBLE, k) * 255')} AS r, {BYTE.format('pow(g / 255.0::DOUBLE, k) * 255')} AS g, {BYTE.format('pow(b / 255.0::DOUBLE, k) * 255')} AS b FROM rgb JOIN m USING (page_id)""")
def r2_gamma(spark, sf):
    return R.gamma_correct(_rgb(spark, sf))


@query("r3_w8_equalize", sql=RGB + f""", q AS (SELECT page_id, y, x, {BYTE.format(LUMA)} AS l, {BYTE.format('-0.169::DOUBLE * r - 0.331::DOUBLE * g + 0.5::DOUBLE * b + 128')} AS u,
  {BYTE.format('0.5::DOUBLE * r - 0.419::DOUBLE * g - 0.081::DOUBLE * b + 128')} AS v FROM rgb),
 c AS (SELECT page_id, l, sum(n) OVER (PARTITION BY page_id ORDER BY l) AS cdf FROM (SELECT page_id, l, count(*) AS n FROM q GROUP BY ALL)),
 e AS (SELECT page_id, l, {BYTE.format('(cdf - lo) * (255.0::DOUBLE / greatest(tot - lo, 1))')} AS e FROM c JOIN (SELECT page_id, min(cdf) AS lo, max(cdf) AS tot FROM c GROUP BY page_id) USING (page_id))
SELECT page_id, y, x, {BYTE.format('e + 1.402::DOUBLE * (v - 128)')} AS r, {BYTE.format('e - 0.344136::DOUBLE * (u - 128) - 0.714136::DOUBLE * (v - 128)')} AS g, {BYTE.format('e + 1.772::DOUBLE * (u - 128)')} AS b
FROM q JOIN e USING (page_id, l)""")
def r3_w8_equalize(spark, sf):
    return R.equalize(_rgb(spark, sf))


@query("r4_r8_invert_swap", sql=RGB + " SELECT page_id, y, x, 255 - b AS r, 255 - g AS g, 255 - r AS b FROM rgb")
def r4_r8_invert_swap(spark, sf):
    return R.invert(R.swap_channels(_rgb(spark, sf)), "r", "g", "b").select("page_id", "y", "x", "r", "g", "b")


@query("r8_split_channels", sql=RGB + " SELECT page_id, y, x, 'r' AS channel, r AS v FROM rgb UNION ALL SELECT page_id, y, x, 'g', g FROM rgb UNION ALL SELECT page_id, y, x, 'b', b FROM rgb")
def r8_split_channels(spark, sf):
    return R.split_channels(_rgb(spark, sf))


@query("r5_pad_crop", sql=RAS + SIZE.format(t="raster") + """
SELECT page_id, y + (greatest(width, height, 40) - height) // 2 - 6 AS y, x + (greatest(width, height, 40) - width) // 2 - 8 AS x, v FROM raster JOIN sz USING (page_id)
WHERE x + (greatest(width, height, 40) - width) // 2 BETWEEN 8 AND 27 AND y + (greatest(width, height, 40) - height) // 2 BETWEEN 6 AND 29""")
def r5_pad_crop(spark, sf):
    px = _raster(spark, sf)
    return R.crop(R.pad_center(px, R.page_sizes(px), 40), 8, 6, 20, 24).select("page_id", "y", "x", "v")


@query("r5_padded_size", sql=RAS + SIZE.format(t="raster") + """
SELECT page_id, CASE WHEN width > 20 AND height > 31 THEN width ELSE greatest(width, 20) END AS w, CASE WHEN width > 20 AND height > 31 THEN height ELSE greatest(height, 31) END AS h FROM sz""")
def r5_padded_size(spark, sf):
    w, h = R.padded_size(F.col("width"), F.col("height"), 20, 31)
    return R.page_sizes(_raster(spark, sf)).select("page_id", w.alias("w"), h.alias("h"))


@query("r6_rotate", sql=RAS + SIZE.format(t="raster") + """
SELECT page_id, 'right' AS turn, x AS y, height - 1 - y AS x, v FROM raster JOIN sz USING (page_id) UNION ALL
SELECT page_id, 'left', width - 1 - x, y, v FROM raster JOIN sz USING (page_id) UNION ALL SELECT page_id, 'swap', x, y, v FROM raster""")
def r6_rotate(spark, sf):
    px = _raster(spark, sf)
    pages = R.page_sizes(px)
    out = [(R.rotate_right(px, pages), "right"), (R.rotate_left(px, pages), "left"), (R.transpose(px), "swap")]
    parts = [df.select("page_id", F.lit(n).alias("turn"), "y", "x", "v") for df, n in out]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("r7_resize", sql=RAS + SIZE.format(t="raster") + """, n AS (SELECT page_id, ty, tx, v FROM (SELECT page_id, width, height, ty, unnest(range(20)) AS tx FROM (SELECT *, unnest(range(48)) AS ty FROM sz)) t
  JOIN raster r USING (page_id) WHERE r.y = ty * height // 48 AND r.x = tx * width // 20)
SELECT page_id, 'nearest' AS kind, ty AS y, tx AS x, CAST(v AS DOUBLE) AS v FROM n UNION ALL SELECT page_id, 'box', y // 4, x // 4, round(avg(v), 6) FROM raster GROUP BY page_id, y // 4, x // 4""")
def r7_resize(spark, sf):
    px = _raster(spark, sf)
    near = R.resize_nearest(px, R.page_sizes(px), 20, 48).select("page_id", F.lit("nearest").alias("kind"), "y", "x", F.col("v").cast("double").alias("v"))
    box = R.resize_box(px, 4).select("page_id", F.lit("box").alias("kind"), "y", "x", F.round("v", 6).alias("v"))
    return near.unionByName(box)


@query("r9_r10_f14_bubble_test", sql=RGB + f""", c AS (SELECT page_id, y // 16 AS cy, x // 16 AS cx, y % 16 AS y, x % 16 AS x, r, g, b, {BYTE.format(LUMA)} AS v FROM rgb),
 f AS (SELECT page_id, cy, cx, round(count(*) FILTER (v <= 127) / count(*)::DOUBLE, 6) * 100 AS black FROM c WHERE x < 2 OR y < 2 OR x >= 14 OR y >= 14 GROUP BY page_id, cy, cx),
 k AS (SELECT page_id, cy, cx, count(*) FILTER ((r - {LUMA}) ** 2 + (g - {LUMA}) ** 2 + (b - {LUMA}) ** 2 > 100) > 10 AS colored FROM c GROUP BY page_id, cy, cx)
SELECT page_id, cy, cx, round(black, 4) AS black, colored, black BETWEEN 30 AND 70 OR colored AS ignore FROM f JOIN k USING (page_id, cy, cx)""")
def r9_r10_f14_bubble_test(spark, sf):
    cut = lambda c: F.floor(F.col(c) / F.lit(16)).cast("bigint")
    crops = _rgb(spark, sf).select("page_id", cut("y").alias("cy"), cut("x").alias("cx"), (F.col("y") % 16).alias("y"), (F.col("x") % 16).alias("x"),
                                   "r", "g", "b", F.lit(16).alias("width"), F.lit(16).alias("height"))
    return R.ignore_region(crops, ["page_id", "cy", "cx"], 30).withColumn("black", F.round("black", 4))


# --- masks ------------------------------------------------------------------


def _px(runs):
    return M.to_pixels(runs).select("page_id", "y", "x")


@query("r16_f1_threshold", sql=RAS + " SELECT page_id, y, x FROM raster WHERE v BETWEEN 100 AND 160")
def r16_f1_threshold(spark, sf):
    return R.in_range(_raster(spark, sf), 100, 160).select("page_id", "y", "x")


@query("r11_box_fill", sql=ctes("textlines") + """, bx AS (SELECT page_id, x // 4 AS x, y // 4 AS y, w // 4 AS w, h // 4 AS h FROM textlines)
SELECT page_id, y, count(*) AS n, sum(x) AS sx FROM (SELECT DISTINCT page_id, yy AS y, unnest(range(greatest(x, 0), least(x + w, 400))) AS x FROM (SELECT *, unnest(range(y, least(y + h, 60))) AS yy FROM bx)) GROUP BY page_id, y""")
def r11_box_fill(spark, sf):
    q = lambda c: F.floor(F.col(c) / F.lit(4)).cast("bigint").alias(c)
    boxes = view(spark, sf, "textlines").select("page_id", q("x"), q("y"), q("w"), q("h"))
    pages = boxes.select("page_id").distinct().withColumns({"width": F.lit(400), "height": F.lit(60)})
    return _row_sums(M.fill_boxes(boxes, pages))


def _row_sums(runs):
    """Pixel count and sum of x per row, from the run ends alone."""
    n = F.col("x1") - F.col("x0") + 1
    return runs.groupBy("page_id", "y").agg(F.sum(n).alias("n"), F.sum(((F.col("x0") + F.col("x1")) * n / 2).cast("bigint")).alias("sx"))


_EDGE = "SELECT page_id, quad_id, x{i} AS ax, y{i} AS ay, x{j} AS bx, y{j} AS by_ FROM slanted"
_POLY = ctes("slanted") + ", e AS (" + " UNION ALL ".join(_EDGE.format(i=i, j=(i + 1) % 4) for i in range(4)) + """),
 c AS (SELECT page_id, quad_id, yy, CAST(trunc(ax + ((yy - ay)::DOUBLE / (by_ - ay)) * (bx - ax)) AS BIGINT) AS cx FROM (SELECT *, unnest(range(least(ay, by_), greatest(ay, by_))) AS yy FROM e WHERE ay <> by_)),
 s AS (SELECT page_id, quad_id, yy, min(cx) AS x0, max(cx) AS x1 FROM c GROUP BY ALL),
 f AS (SELECT page_id, quad_id, yy AS y, unnest(range(least(x0, 899), least(x1, 899) + 1)) AS x FROM s WHERE yy < 250)"""


@query("r12_polygon_fill", sql=_POLY + " SELECT page_id, y, count(*) AS n, sum(x) AS sx FROM (SELECT DISTINCT page_id, y, x FROM f) GROUP BY page_id, y")
def r12_polygon_fill(spark, sf):
    from folioframe.plans.views import slanted

    quads = slanted(spark, sf)
    pages = quads.select("page_id").distinct().withColumns({"width": F.lit(900), "height": F.lit(250)})
    return _row_sums(M.fill_polygons(quads, pages))


_TILE_Q = """q AS (SELECT quad_id, page_id, x0 % 20 AS ax, y0 % 20 AS ay, x0 % 20 + 9 AS bx, y0 % 20 + k AS by_, x0 % 20 + 9 - k // 2 AS cx, y0 % 20 + k + 8 AS cy, x0 % 20 - k // 2 + 2 AS dx, y0 % 20 + 8 AS dy FROM slanted)"""


def _small_quads(spark, sf):
    """Small quads that lie on the 32 x 32 pages."""
    return view(spark, sf, "slanted").selectExpr("quad_id", "page_id", """array(
      struct(x0 % 20 AS x, y0 % 20 AS y), struct(x0 % 20 + 9 AS x, y0 % 20 + k AS y),
      struct(x0 % 20 + 9 - k div 2 AS x, y0 % 20 + k + 8 AS y), struct(x0 % 20 - k div 2 + 2 AS x, y0 % 20 + 8 AS y)) AS pts""")


@query("r22_region_score", sql=RAS + SIZE.format(t="raster") + ", " + ctes("slanted")[5:] + ", " + _TILE_Q + """,
 e AS (SELECT quad_id, page_id, ax AS x0, ay AS y0, bx AS x1, by_ AS y1 FROM q UNION ALL SELECT quad_id, page_id, bx, by_, cx, cy FROM q UNION ALL SELECT quad_id, page_id, cx, cy, dx, dy FROM q UNION ALL SELECT quad_id, page_id, dx, dy, ax, ay FROM q),
 c AS (SELECT page_id, quad_id, yy, CAST(trunc(x0 + ((yy - y0)::DOUBLE / (y1 - y0)) * (x1 - x0)) AS BIGINT) AS cx FROM (SELECT *, unnest(range(least(y0, y1), greatest(y0, y1))) AS yy FROM e WHERE y0 <> y1)),
 s AS (SELECT page_id, quad_id, yy, least(greatest(min(cx), 0), width - 1) AS lo, least(greatest(max(cx), 0), width - 1) AS hi FROM c JOIN sz USING (page_id) WHERE yy >= 0 AND yy < height GROUP BY page_id, quad_id, yy, width)
SELECT s.quad_id, count(*) AS n, round(avg(v), 6) AS score FROM s JOIN raster r ON r.page_id = s.page_id AND r.y = s.yy AND r.x BETWEEN s.lo AND s.hi GROUP BY s.quad_id""")
def r22_region_score(spark, sf):
    from folioframe.operators.extraction import region_scores

    px = cut_lineage(_raster(spark, sf))
    return region_scores(_small_quads(spark, sf), px, R.page_sizes(px)).select("quad_id", "n", F.round("score", 6).alias("score"))


def _kernel_sql(kernel):
    return ", ".join(f"({dy}, {dx})" for dy, a, b in kernel for dx in range(a, b + 1))


def _dilate_sql(kernel):
    return MASK + f""", kn(dy, dx) AS (VALUES {_kernel_sql(kernel)})
SELECT DISTINCT page_id, y + dy AS y, x + dx AS x FROM mk JOIN sz USING (page_id), kn WHERE y + dy BETWEEN 0 AND height - 1 AND x + dx BETWEEN 0 AND width - 1"""


@query("r20_dilate_box", sql=_dilate_sql(M.box_kernel(3)))
def r20_dilate_box(spark, sf):
    runs, pages = _mask(spark, sf)
    return _px(M.dilate(runs, M.box_kernel(3), pages))


@query("r20_dilate_ellipse", sql=_dilate_sql([(-2, 0, 0), (-1, -2, 2), (0, -2, 2), (1, -2, 2), (2, 0, 0)]))
def r20_dilate_ellipse(spark, sf):
    runs, pages = _mask(spark, sf)
    return _px(M.dilate(runs, M.ellipse_kernel(5), pages))


@query("r20_erode_box", sql=RAS + f""", mk AS (SELECT page_id, y, x FROM raster WHERE v > 100), kn(dy, dx) AS (VALUES {_kernel_sql(M.box_kernel(3))})
SELECT page_id, y - dy AS y, x - dx AS x FROM mk, kn GROUP BY 1, 2, 3 HAVING count(*) = 9""")
def r20_erode_box(spark, sf):
    runs, _ = _mask(spark, sf, 100)
    return _px(M.erode(runs, M.box_kernel(3)))


@query("r20_kernel_sizes", sql=ctes("textlines") + """
SELECT quad_id, greatest(CAST(trunc((least(w, h) + 4) * 0.3) AS BIGINT) // 2 * 2 + 1, 3) AS line, 2 * CAST(ceil(h / 12.0) AS BIGINT) + 1 AS outline, CAST(trunc(greatest(w, h) * 0.025) AS BIGINT) AS page FROM textlines""")
def r20_kernel_sizes(spark, sf):
    cols = M.line_dilate_size(F.least("w", "h").cast("double"), 4.0), M.outline_size(F.col("h")), M.page_kernel_size(F.col("w"), F.col("h"))
    return view(spark, sf, "textlines").select("quad_id", *[c.alias(n) for c, n in zip(cols, ("line", "outline", "page"))])


_REACH = """ {m}, ng AS (SELECT a.page_id, a.y, a.x, b.y AS y2, b.x AS x2 FROM mk a JOIN mk b ON a.page_id = b.page_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
 rc AS (SELECT page_id, y AS ay, x AS ax, y, x FROM mk UNION SELECT rc.page_id, ay, ax, ng.y2, ng.x2 FROM rc JOIN ng ON ng.page_id = rc.page_id AND ng.y = rc.y AND ng.x = rc.x),
 cp AS (SELECT page_id, ay AS y, ax AS x, min(y * 4294967296 + x) AS c FROM rc GROUP BY ALL)"""


@query("r21_f18_components", sql=_REACH.format(m=MASK.replace("WITH", "WITH RECURSIVE", 1).replace("v > 140", "v > 165")) + """
SELECT page_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM cp GROUP BY page_id, c
HAVING count(*) > 3 AND (max(x) - min(x) + 1) * (max(y) - min(y) + 1) >= 3""")
def r21_f18_components(spark, sf):
    from folioframe.operators.filters import large_components

    runs, _ = _mask(spark, sf, 165)
    return large_components(M.component_stats(M.components(runs)), 3).drop("component")


@query("t4_second_largest", sql=_REACH.format(m=MASK.replace("WITH", "WITH RECURSIVE", 1).replace("v > 140", "v > 165")) + """
, ar AS (SELECT page_id, count(*) AS area FROM cp GROUP BY page_id, c)
SELECT page_id, coalesce(nth_value, one) AS threshold FROM (SELECT page_id, list_sort(list(area))[-2] AS nth_value, max(area) AS one FROM ar GROUP BY page_id)""")
def t4_second_largest(spark, sf):
    runs, _ = _mask(spark, sf, 165)
    return M.second_largest(M.component_stats(M.components(runs)))


_TWO = RAS + ", ma AS (SELECT page_id, y, x FROM raster WHERE v > 128), mb AS (SELECT page_id, y, x FROM raster WHERE (v * 7 + x * 13) % 256 > 128)"


def _two(spark, sf):
    px = _raster(spark, sf)
    other = (F.col("v") * 7 + F.col("x") * 13) % 256
    return M.to_runs(px.where("v > 128")), M.to_runs(px.where(other > 128))


@query("u1_mask_union", sql=_TWO + " SELECT * FROM ma UNION SELECT * FROM mb")
def u1_mask_union(spark, sf):
    return _px(M.union(*_two(spark, sf)))


@query("j19_u2_mask_intersect", sql=_TWO + " SELECT * FROM ma INTERSECT SELECT * FROM mb")
def j19_u2_mask_intersect(spark, sf):
    return _px(M.intersect(*_two(spark, sf)))


@query("u3_mask_xor", sql=_TWO + " SELECT page_id, count(*) AS differ FROM ((SELECT * FROM ma EXCEPT SELECT * FROM mb) UNION ALL (SELECT * FROM mb EXCEPT SELECT * FROM ma)) GROUP BY page_id")
def u3_mask_xor(spark, sf):
    return M.difference_size(*_two(spark, sf))


@query("u4_merge_gain", sql="WITH RECURSIVE " + _TWO[5:].replace("ma AS", "mk AS", 1).replace("v > 128)", "v > 165)", 1) + _REACH.format(m="") + """
SELECT page_id, c AS component, count(*) FILTER (b.y IS NOT NULL) - count(*) FILTER (b.y IS NULL) AS gain FROM cp LEFT JOIN mb b USING (page_id, y, x)
 WHERE NOT EXISTS (SELECT 1 FROM raster r WHERE r.page_id = cp.page_id AND r.y = cp.y AND r.x = cp.x AND r.v > 180) GROUP BY page_id, c""")
def u4_merge_gain(spark, sf):
    px = _raster(spark, sf)
    runs, _ = _mask(spark, sf, 165)
    return M.merge_gain(M.components(runs), _two(spark, sf)[1], M.to_runs(px.where("v > 180")))


# blobs of the rest of the page, the second largest of their areas and the mask's own, and what each adds to the prediction
@query("r23_hole_fill", sql=RAS.replace("WITH", "WITH RECURSIVE", 1) + SIZE.format(t="raster") + f""", ma AS (SELECT page_id, y, x FROM raster WHERE v > 128), mb AS (SELECT page_id, y, x FROM raster WHERE (v * 7 + x * 13) % 256 > 128),
 al AS (SELECT page_id, a.y, b.x FROM sz, range(64) a(y), range(64) b(x) WHERE a.y < height AND b.x < width),
 ho AS (SELECT * FROM al ANTI JOIN ma USING (page_id, y, x)),
 ng AS (SELECT a.page_id, a.y, a.x, b.y AS y2, b.x AS x2 FROM ho a JOIN ho b ON a.page_id = b.page_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
 rc AS (SELECT page_id, y AS ay, x AS ax, y, x FROM ho UNION SELECT rc.page_id, ay, ax, ng.y2, ng.x2 FROM rc JOIN ng ON ng.page_id = rc.page_id AND ng.y = rc.y AND ng.x = rc.x),
 cp AS (SELECT page_id, ay AS y, ax AS x, min(y * 4294967296 + x) AS c FROM rc GROUP BY page_id, ay, ax),
 hs AS (SELECT cp.page_id, c, count(*) AS area, 2 * count(mb.x) - count(*) AS gain FROM cp LEFT JOIN mb USING (page_id, y, x) GROUP BY cp.page_id, c),
 ar AS (SELECT page_id, area FROM hs UNION ALL SELECT page_id, count(*) FROM ma GROUP BY page_id),
 th AS (SELECT page_id, coalesce(list_sort(list(area))[-2], max(area)) AS threshold FROM ar GROUP BY page_id),
 ou AS (SELECT page_id, y, x FROM ma UNION SELECT cp.page_id, cp.y, cp.x FROM cp JOIN hs USING (page_id, c) JOIN th USING (page_id) WHERE area < threshold AND gain > 0)
SELECT page_id, y, count(*) AS n, sum(x) AS sx FROM ou GROUP BY page_id, y""")
def r23_hole_fill(spark, sf):
    a, b = _two(spark, sf)
    return _row_sums(M.fill_holes(a, b, R.page_sizes(_raster(spark, sf))))


def _corner_sql(cells):
    return "coalesce(bool_or(" + " OR ".join(f"(b.y = r.y + ({dy}) AND b.x = r.x + ({dx}))" for dy, dx in cells) + "), false)"


# a corner's flag: one of its three neighbours is in the ring before; known pixels are ring 0
@query("r24_ring_distance", sql=RAS + """, un AS (SELECT page_id, y, x FROM raster WHERE v > 90), kn AS (SELECT page_id, y, x FROM raster WHERE v <= 90),
 r AS (SELECT un.page_id, un.y, un.x, min(greatest(abs(un.y - kn.y), abs(un.x - kn.x))) AS ring FROM un JOIN kn USING (page_id) GROUP BY ALL),
 al AS (SELECT * FROM r UNION ALL SELECT page_id, y, x, 0 FROM kn)
SELECT r.page_id, r.y, r.x, r.ring, """ + ", ".join(f"{_corner_sql(cells)} AS {name}" for name, cells in (
    ("d1", ((-1, -1), (-1, 0), (0, -1))), ("d2", ((1, -1), (1, 0), (0, -1))), ("d3", ((-1, 1), (-1, 0), (0, 1))), ("d4", ((1, 1), (1, 0), (0, 1))))) + """
 FROM r LEFT JOIN al b ON b.page_id = r.page_id AND b.ring = r.ring - 1 AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1 GROUP BY r.page_id, r.y, r.x, r.ring""")
def r24_ring_distance(spark, sf):
    runs, pages = _mask(spark, sf, 90)
    return M.ring_distance(runs, pages)


_K = [[1.0, 2.0, 1.0], [0.0, 0.5, 0.0], [-1.0, -2.0, -1.0]]


@query("r25_weighted_sum", sql=RAS + ", kn(dy, dx, k) AS (VALUES " + ", ".join(f"({i - 1}, {j - 1}, {_K[i][j]}::DOUBLE)" for i in range(3) for j in range(3)) + """)
SELECT a.page_id, a.y, a.x, round(sum(b.v * k), 6) AS s FROM raster a JOIN kn ON true JOIN raster b ON b.page_id = a.page_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL""")
def r25_weighted_sum(spark, sf):
    return R.weighted_sum(_raster(spark, sf), _K).withColumn("s", F.round("s", 6))


# --- tiles, strips, blending ------------------------------------------------


@query("r13_tile_round_trip", sql=RAS + """
SELECT page_id, 'tiles' AS kind, y, x, v FROM raster UNION ALL
SELECT page_id, 'count', ty, tx, count(*) FROM (SELECT r.page_id, ty, tx FROM raster r, (SELECT unnest(range(5)) AS ty), (SELECT unnest(range(5)) AS tx), (SELECT page_id, max(x) + 1 AS w, max(y) + 1 AS h FROM raster GROUP BY page_id) s
 WHERE s.page_id = r.page_id AND ty * 7 < h AND tx * 7 < w AND r.y BETWEEN ty * 7 - 2 AND ty * 7 + 8 AND r.x BETWEEN tx * 7 - 2 AND tx * 7 + 8) GROUP BY page_id, ty, tx""")
def r13_tile_round_trip(spark, sf):
    px = _raster(spark, sf)
    tiles = R.split_tiles(px.join(R.page_sizes(px), "page_id"), 7, 2)
    back = R.merge_tiles(tiles, 7, 2).select("page_id", F.lit("tiles").alias("kind"), "y", "x", "v")
    n = tiles.groupBy("page_id", F.col("tile_y").alias("y"), F.col("tile_x").alias("x")).agg(F.count(F.lit(1)).alias("v"))
    return back.unionByName(n.select("page_id", F.lit("count").alias("kind"), "y", "x", "v"))


@query("r14_strip_merge", sql=RAS + """, st AS (SELECT page_id, t AS top, y - t AS sy, x, v + t AS v FROM raster, (SELECT unnest([0, 8, 16]) AS t) WHERE y BETWEEN t AND t + 15)
SELECT page_id, top + sy AS y, x, round(avg(v), 6) AS v FROM st GROUP BY page_id, top + sy, x""")
def r14_strip_merge(spark, sf):
    px = _raster(spark, sf).withColumn("top", F.explode(F.array(*[F.lit(t).cast("bigint") for t in (0, 8, 16)])))
    strips = px.where((F.col("y") >= F.col("top")) & (F.col("y") <= F.col("top") + 15)).withColumns(
        {"sy": F.col("y") - F.col("top"), "v": F.col("v") + F.col("top")})
    return R.merge_strips(strips).withColumn("v", F.round("v", 6))


_OVER = ", ov AS (SELECT page_id, y, x, g AS r, b AS g, r AS b, (v * 5) % 256 AS a FROM rgb WHERE x % 3 <> 0)"


def _over(spark, sf):
    return _rgb(spark, sf).where("x % 3 <> 0").select("page_id", "y", "x", F.col("g").alias("r"), F.col("b").alias("g"), F.col("r").alias("b"), (F.col("v") * 5 % 256).alias("a"))


def _mix(c):
    return f"CASE WHEN o.a IS NULL THEN p.{c} ELSE {BYTE.format(f'o.{c} * (o.a / 255.0::DOUBLE) + p.{c} * (1 - o.a / 255.0::DOUBLE)')} END AS {c}"


@query("r15_blend_rgb", sql=RGB + _OVER + f" SELECT page_id, y, x, {_mix('r')}, {_mix('g')}, {_mix('b')} FROM rgb p LEFT JOIN ov o USING (page_id, y, x)")
def r15_blend_rgb(spark, sf):
    return R.blend_over(_rgb(spark, sf), _over(spark, sf))


def _mix4(c):
    return (f"CASE WHEN o.a IS NULL THEN p.{c} WHEN o.a = 255 THEN o.{c} WHEN out = 0 THEN 0 ELSE "
            f"{BYTE.format(f'(o.{c} * oa + p.{c} * (sa * (1 - oa))) / out')} END AS {c}")


@query("r15_blend_rgba", sql=RGB + _OVER + f""", j AS (SELECT p, o, p.a / 255.0::DOUBLE AS sa, o.a / 255.0::DOUBLE AS oa, o.a / 255.0::DOUBLE + p.a / 255.0::DOUBLE * (1 - o.a / 255.0::DOUBLE) AS out
 FROM (SELECT page_id, y, x, r, g, b, (v * 3) % 256 AS a FROM rgb) p LEFT JOIN ov o ON p.page_id = o.page_id AND p.y = o.y AND p.x = o.x)
SELECT p.page_id AS page_id, p.y AS y, p.x AS x, {_mix4('r')}, {_mix4('g')}, {_mix4('b')}, CASE WHEN o.a IS NULL THEN p.a WHEN o.a = 255 THEN 255 ELSE {BYTE.format('out * 255')} END AS a FROM j""")
def r15_blend_rgba(spark, sf):
    base = _rgb(spark, sf).withColumn("a", F.col("v") * 3 % 256).drop("v")
    return R.blend_alpha(base, _over(spark, sf))


@query("r15_ud4_constant_fill", sql=RGB + """ SELECT page_id, y, x, CASE WHEN v > 127 THEN 200 ELSE r END AS r, CASE WHEN v > 127 THEN 100 ELSE g END AS g, CASE WHEN v > 127 THEN 50 ELSE b END AS b FROM rgb""")
def r15_ud4_constant_fill(spark, sf):
    px = _rgb(spark, sf)
    return R.blend_over(px, R.constant_fill(px.select("page_id", "y", "x", "v"), (200, 100, 50)))


@query("r15_attach_alpha", sql=RGB + " SELECT page_id, y, x, r, g, b, CASE WHEN v > 140 THEN v ELSE 0 END AS a FROM rgb")
def r15_attach_alpha(spark, sf):
    px = _rgb(spark, sf)
    return R.attach_alpha(px, px.where("v > 140").select("page_id", "y", "x", "v")).select("page_id", "y", "x", "r", "g", "b", "a")


@query("r26_cut_out", sql=RGB + _OVER + " SELECT page_id, y, x, CASE WHEN o.a > 128 THEN o.r ELSE p.r END AS r, CASE WHEN o.a > 128 THEN o.g ELSE p.g END AS g, CASE WHEN o.a > 128 THEN o.b ELSE p.b END AS b FROM rgb p LEFT JOIN ov o USING (page_id, y, x)")
def r26_cut_out(spark, sf):
    return R.cut_out(_rgb(spark, sf), _over(spark, sf))


# --- thresholds -------------------------------------------------------------


@query("r17_otsu", sql=RGB + """, ch AS (SELECT page_id, 'r' AS channel, r AS v FROM rgb UNION ALL SELECT page_id, 'g', g FROM rgb UNION ALL SELECT page_id, 'b', b FROM rgb),
 t AS (SELECT DISTINCT page_id, channel, v AS th FROM ch),
 s AS (SELECT t.page_id, t.channel, th, count(*) FILTER (v <= th) AS w0, count(*) FILTER (v > th) AS w1, avg(v) FILTER (v <= th) AS m0, avg(v) FILTER (v > th) AS m1 FROM t JOIN ch USING (page_id, channel) GROUP BY ALL)
SELECT page_id, channel, arg_min(th, (-coalesce(round(w0 * w1 * (m0 - m1) * (m0 - m1), 3), 0), th)) AS threshold FROM s GROUP BY page_id, channel""")
def r17_otsu(spark, sf):
    return R.otsu_threshold(R.split_channels(_rgb(spark, sf)), ["page_id", "channel"])


@query("r18_t3_t5_xor_scores", sql=RGB + """, pr AS (SELECT page_id, y, x, CASE WHEN v > 128 THEN 255 ELSE 0 END AS p, r, g, b FROM rgb),
 ch AS (SELECT page_id, 'r' AS channel, r AS v, p FROM pr UNION ALL SELECT page_id, 'g', g, p FROM pr UNION ALL SELECT page_id, 'b', b, p FROM pr),
 s AS (SELECT page_id, channel, sum(xor(CASE WHEN v > 100 THEN 255 ELSE 0 END, p)) AS a, sum(xor(CASE WHEN v > 100 THEN 0 ELSE 255 END, p)) AS i FROM ch GROUP BY page_id, channel)
SELECT page_id, channel, least(a, i) AS score, i < a AS inverted, row_number() OVER (PARTITION BY page_id ORDER BY least(a, i), channel) AS place FROM s""")
def r18_t3_t5_xor_scores(spark, sf):
    px = _rgb(spark, sf).withColumn("p", F.when(F.col("v") > 128, 255).otherwise(0))
    ch = R.split_channels(px).join(px.select("page_id", "y", "x", "p"), ["page_id", "y", "x"])
    scores = R.xor_score(ch, ["page_id", "channel"], F.when(F.col("v") > 100, 255).otherwise(0), F.col("p"))
    w = Window.partitionBy("page_id").orderBy("score", "channel")
    return scores.withColumn("place", F.row_number().over(w))


@query("r19_gray_histogram", sql=RAS + " SELECT page_id, v * 255 // 256 AS bin, count(*) AS n, (v * 255 // 256) * 256 // 255 AS color FROM raster GROUP BY page_id, v * 255 // 256")
def r19_gray_histogram(spark, sf):
    return R.gray_bins(_raster(spark, sf), ["page_id"])


@query("t2_top_colors", sql=RAS.replace("WITH", "WITH RECURSIVE", 1) + """, h AS (SELECT page_id, v * 255 // 256 AS bin, count(*) AS n, (v * 255 // 256) * 256 // 255 AS color FROM raster GROUP BY page_id, v * 255 // 256),
 k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, bin) AS i, sum(n) OVER (PARTITION BY page_id) * 0.001 AS low FROM h),
 f AS (SELECT page_id, i, [color] AS c, false AS stop FROM k WHERE i = 1
  UNION ALL SELECT f.page_id, k.i, CASE WHEN list_min(list_transform(f.c, lambda z: abs(z - k.color))) > 10 THEN list_append(f.c, k.color) ELSE f.c END AS c,
   len(CASE WHEN list_min(list_transform(f.c, lambda z: abs(z - k.color))) > 10 THEN list_append(f.c, k.color) ELSE f.c END) >= 3 OR k.n < low FROM f JOIN k ON k.page_id = f.page_id AND k.i = f.i + 1 WHERE NOT f.stop)
SELECT page_id, array_to_string(arg_max(c, i), ',') AS colors FROM f GROUP BY page_id""")
def t2_top_colors(spark, sf):
    out = R.top_colors(R.gray_bins(_raster(spark, sf), ["page_id"]), ["page_id"])
    return out.select("page_id", F.array_join(F.col("colors").cast("array<string>"), ",").alias("colors"))
