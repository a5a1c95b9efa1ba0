"""Composite jobs and the operators that only they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.operators import extraction, lines, placement
from folioframe.operators import mask as M
from folioframe.operators import raster as R
from folioframe.plans.raster_queries import RAS, SIZE, _row_sums
from folioframe.plans.registry import query
from folioframe.plans.views import ctes, slanted, textlines, view
from folioframe.session import cut_lineage


@query("t1_candidate_cap", sql=ctes("textlines") + " SELECT quad_id FROM (SELECT quad_id, row_number() OVER (PARTITION BY page_id ORDER BY quad_id) AS n FROM textlines) WHERE n <= 7")
def t1_candidate_cap(spark, sf):
    return extraction.candidate_cap(textlines(spark, sf), "quad_id", 7).select("quad_id")


# tilted quads drawn right to left; the next line lies 34 px higher in the same column
@query("p20_w7_expand_lines", sql=ctes("textlines") + """
, n AS (SELECT *, h >= w AS vertical, quad_id // 5 AS block_id, lead(y) OVER w AS ny, lead(x) OVER w AS nx, lead(h) OVER w AS nh FROM textlines WINDOW w AS (PARTITION BY quad_id // 5 ORDER BY quad_id DESC))
SELECT quad_id, CASE WHEN vertical AND nx IS NULL THEN x + 2 * w WHEN vertical THEN nx ELSE x + w END AS rx,
 CASE WHEN NOT vertical AND ny IS NULL THEN y - h WHEN NOT vertical THEN ny + nh ELSE y END AS ty FROM n""")
def p20_w7_expand_lines(spark, sf):
    df = G.with_corner_order(textlines(spark, sf)).withColumn("block_id", F.floor(F.col("quad_id") / 5))
    out = lines.expand_to_next(df, "quad_id")
    return out.select("quad_id", F.col("expanded")[1]["x"].alias("rx"), F.col("expanded")[0]["y"].alias("ty"))


_SQUARE = (RAS.replace("WITH", "WITH RECURSIVE", 1) + """, mk AS (SELECT page_id, y, x FROM raster WHERE v > 152),
 ng AS (SELECT a.page_id, a.y, a.x, b.y AS y2, b.x AS x2 FROM mk a JOIN mk b ON a.page_id = b.page_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
 rc AS (SELECT page_id, y AS ay, x AS ax, y, x FROM mk UNION SELECT rc.page_id, ay, ax, ng.y2, ng.x2 FROM rc JOIN ng ON ng.page_id = rc.page_id AND ng.y = rc.y AND ng.x = rc.x),
 cp AS (SELECT page_id, ay AS y, ax AS x, min(y * 4294967296 + x) AS c FROM rc GROUP BY ALL),
 cc AS (SELECT page_id, c, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM cp GROUP BY page_id, c HAVING count(*) > 9),
 bx AS (SELECT doc_id AS quad_id, doc_id // 20 AS page_id, (doc_id * 7) % 24 AS x, (doc_id * 5) % 26 AS y, 8 + n_chars % 9 AS w, 4 + doc_id % 5 AS h FROM documents)""")


def _grid_lines(spark, sf):
    """Upright lines that lie on the 32 x 32 pages."""
    from folioframe.plans.views import table

    k = F.col("doc_id")
    df = table(spark, sf, "documents").select(
        F.floor(k / 20).alias("page_id"), k.alias("quad_id"),
        G.box_quad(k * 7 % 24, k * 5 % 26, F.col("n_chars") % 9 + 8, k % 5 + 4).alias("pts"))
    return G.with_geometry(G.with_corner_order(df))


@query("j5_assign_components", sql=_SQUARE + """,
 pr AS (SELECT cc.page_id, c, cc.area, cc.w AS cw, cc.h AS ch, quad_id, b.w * b.h AS la, CAST(least(b.w, b.h) AS DOUBLE) AS fs,
  greatest(0, least(cc.x + cc.w, b.x + b.w) - greatest(cc.x, b.x)) * greatest(0, least(cc.y + cc.h, b.y + b.h) - greatest(cc.y, b.y)) / least(b.w * b.h, cc.area)::DOUBLE AS ratio,
  sqrt(greatest(b.x - (cc.x + cc.w / 2.0), cc.x + cc.w / 2.0 - b.x - b.w, 0) ** 2 + greatest(b.y - (cc.y + cc.h / 2.0), cc.y + cc.h / 2.0 - b.y - b.h, 0) ** 2) AS dist FROM cc JOIN bx b USING (page_id)),
 mo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, c ORDER BY round(ratio, 9) DESC, quad_id) AS k FROM pr) WHERE k = 1),
 ne AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, c ORDER BY round(dist, 9), quad_id DESC) AS k FROM pr) WHERE k = 1)
SELECT page_id, component, quad_id FROM (SELECT mo.page_id, mo.c AS component, CASE WHEN mo.ratio > 0 AND mo.area >= mo.la THEN NULL WHEN mo.ratio > 0.01 THEN mo.quad_id
  WHEN ne.dist < 0.5 * greatest(10, least(ne.fs, ne.cw, ne.ch)) AND ne.area < ne.la THEN ne.quad_id END AS quad_id FROM mo JOIN ne ON mo.page_id = ne.page_id AND mo.c = ne.c) WHERE quad_id IS NOT NULL""")
def j5_assign_components(spark, sf):
    runs = M.to_runs(view(spark, sf, "raster").where("v > 152"))
    return lines.assign_components(M.component_stats(M.components(runs)), _grid_lines(spark, sf))


_ROT = ctes("slanted") + """, bx AS (SELECT page_id, quad_id AS block_id, least(x0, x3) AS x1, y0 AS y1, least(x0, x3) + 150 AS x2, y0 + 50 + k AS y2 FROM slanted)"""


def _render_boxes(spark, sf):
    return view(spark, sf, "slanted").select(
        "page_id", F.col("quad_id").alias("block_id"), F.least("x0", "x3").alias("x1"), F.col("y0").alias("y1"),
        (F.least("x0", "x3") + 150).alias("x2"), (F.col("y0") + 50 + F.col("k")).alias("y2"))


@query("j18_collisions", sql=_ROT + """
SELECT a.page_id, a.block_id, count(*) AS hits, sum((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) AS overlap
FROM bx a JOIN bx b ON a.page_id = b.page_id AND b.block_id < a.block_id AND a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1 GROUP BY ALL""")
def j18_collisions(spark, sf):
    return placement.collisions(_render_boxes(spark, sf))


# every spot depends on the ones before it: one step per block, which carries the placed boxes; the steps out are 0.35 of the longer side and 10
_SHARED = "coalesce(list_sum(list_transform(placed, lambda p: greatest(0, least(p.x2, {x2}) - greatest(p.x1, {x1})) * greatest(0, least(p.y2, {y2}) - greatest(p.y1, {y1})))), 0)"
_MOVES = "[" + ", ".join(f"{{'x': {dx * ring}, 'y': {dy * ring}}}" for ring in range(1, 7)
                         for dx, dy in ((0, -1), (0, 1), (1, 0), (-1, 0), (1, -1), (-1, -1), (1, 1), (-1, 1))) + "]"


@query("r27_placement", sql=_ROT.replace("WITH", "WITH RECURSIVE", 1) + f""",
 o AS (SELECT page_id, block_id, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, greatest(x2 - x1, y2 - y1) * 0.35::DOUBLE + 10 AS step,
  row_number() OVER (PARTITION BY page_id ORDER BY block_id) AS k FROM bx),
 st AS (SELECT DISTINCT page_id, 0::BIGINT AS k, NULL::BIGINT AS block_id, 0::DOUBLE AS x, 0::DOUBLE AS y, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS placed FROM o
  UNION ALL SELECT page_id, k, block_id, (x1 + x2) / 2 + dx, (y1 + y2) / 2 + dy, list_append(placed, {{'x1': x1 + dx, 'y1': y1 + dy, 'x2': x2 + dx, 'y2': y2 + dy}}) FROM (
   SELECT *, CASE WHEN moved THEN spots[best].x ELSE 0 END AS dx, CASE WHEN moved THEN spots[best].y ELSE 0 END AS dy FROM (
    SELECT *, NOT (free AND cost <= 0) AND (prices[best] <= 2.3e-16 OR prices[best] < cost) AS moved FROM (
     SELECT *, list_position(prices, list_min(prices)) AS best FROM (
      SELECT *, list_transform(spots, lambda m: CASE WHEN x1 + m.x >= 0 AND y1 + m.y >= 0 AND x2 + m.x <= 1700 AND y2 + m.y <= 600
        THEN {_SHARED.format(x1="x1 + m.x", y1="y1 + m.y", x2="x2 + m.x", y2="y2 + m.y")} ELSE 'infinity'::DOUBLE END) AS prices FROM (
       SELECT o.*, st.placed, x1 >= 0 AND y1 >= 0 AND x2 <= 1700 AND y2 <= 600 AS free, {_SHARED.format(x1="o.x1", y1="o.y1", x2="o.x2", y2="o.y2")} AS cost,
        list_transform({_MOVES}, lambda m: {{'x': m.x * step, 'y': m.y * step}}) AS spots
       FROM st JOIN o ON o.page_id = st.page_id AND o.k = st.k + 1))))))
SELECT page_id, block_id, round(x, 6) AS x, round(y, 6) AS y FROM st WHERE k > 0""")
def r27_placement(spark, sf):
    b = _render_boxes(spark, sf)
    blocks = b.select(
        "page_id", "block_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
        (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.lit(0.0).alias("theta"),
        F.lit(1700).alias("page_w"), F.lit(600).alias("page_h"))
    out = placement.place_blocks(blocks)
    return out.select("page_id", "block_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("c1_box_extraction", sql=RAS + SIZE.format(t="raster") + """,
 bx AS (SELECT doc_id AS quad_id, doc_id // 20 AS page_id, (doc_id * 7) % 24 AS x, (doc_id * 5) % 26 AS y, 8 + n_chars % 9 AS w, 4 + doc_id % 5 AS h FROM documents),
 lt AS (SELECT page_id FROM raster GROUP BY page_id HAVING max(v) > 160),
 cp AS (SELECT * FROM (SELECT bx.*, row_number() OVER (PARTITION BY page_id ORDER BY quad_id) AS n FROM bx JOIN lt USING (page_id)) WHERE n <= 15 AND least(w, h) >= 5),
 sc AS (SELECT c.quad_id, avg(r.v) AS score FROM cp c JOIN sz USING (page_id) JOIN raster r ON r.page_id = c.page_id AND r.y >= c.y AND r.y < c.y + c.h AND r.x BETWEEN least(c.x, width - 1) AND least(c.x + c.w, width - 1) AND r.y < height GROUP BY c.quad_id),
 s2 AS (SELECT c.*, coalesce(score, 0) AS score, (w * h * 1.8::DOUBLE) / (2 * (w + h)) AS d FROM cp c LEFT JOIN sc USING (quad_id)),
 s3 AS (SELECT s2.*, round((x - d) / width::DOUBLE * 640) AS a, round((y - d) / height::DOUBLE * 480) AS b, round((x - d + (w + d * 2)) / width::DOUBLE * 640) AS c, round((y - d + (h + d * 2)) / height::DOUBLE * 480) AS e FROM s2 JOIN sz USING (page_id) WHERE score >= 125 AND least(w + d * 2, h + d * 2) >= 7),
 s4 AS (SELECT quad_id, page_id, score, CAST(least(greatest(a, 0), 640) AS BIGINT) AS x0, CAST(least(greatest(b, 0), 480) AS BIGINT) AS y0, CAST(least(greatest(c, 0), 640) AS BIGINT) AS x1, CAST(least(greatest(e, 0), 480) AS BIGINT) AS y1 FROM s3)
SELECT page_id, quad_id, round(score, 6) AS score, x0, y0, x1, y1, x1 - x0 <= y1 - y0 AS vertical FROM s4 WHERE (x1 - x0) * (y1 - y0) >= 16""")
def c1_box_extraction(spark, sf):
    px = cut_lineage(view(spark, sf, "raster"))
    pages = cut_lineage(R.page_sizes(px))
    k = F.col("quad_id")
    from folioframe.plans.views import table

    boxes = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 20).alias("page_id"), F.col("doc_id").alias("quad_id"), "n_chars").select(
        "page_id", "quad_id", (k * 7 % 24).alias("x"), (k * 5 % 26).alias("y"), (F.col("n_chars") % 9 + 8).alias("w"), (k % 5 + 4).alias("h"))
    dest = pages.select("page_id", F.lit(640).alias("dest_w"), F.lit(480).alias("dest_h"))
    out = extraction.extract_boxes(boxes, px, pages, dest, threshold=160, box_threshold=125, unclip=1.8, min_size=5, limit=15)
    p = F.col("pts")
    return out.select("page_id", "quad_id", F.round("score", 6).alias("score"), p[0]["x"].alias("x0"), p[0]["y"].alias("y0"),
                      p[2]["x"].alias("x1"), p[2]["y"].alias("y1"), "vertical")


# pages are worked on at two thirds of their size; kernels are ellipses with reach rint(sqrt(h^2 - d^2))
_FIT = RAS.replace("WITH", "WITH RECURSIVE", 1) + SIZE.format(t="raster") + """,
 ws AS (SELECT *, CAST(trunc(width * f) AS BIGINT) AS tw, CAST(trunc(height * f) AS BIGINT) AS th FROM (SELECT *, (height - height / 3.0::DOUBLE) / height AS f FROM sz)),
 mk AS (SELECT ws.page_id, a.y, b.x FROM ws, range(64) a(y), range(64) b(x), raster r WHERE a.y < th AND b.x < tw AND r.page_id = ws.page_id
  AND r.y = (a.y * height) // th AND r.x = (b.x * width) // tw AND r.v > 152),
 b0 AS (SELECT doc_id AS quad_id, doc_id // 20 AS page_id, (doc_id * 7) % 24 AS x0, (doc_id * 5) % 26 AS y0, (doc_id * 7) % 24 + 8 + n_chars % 9 AS x1, (doc_id * 5) % 26 + 4 + doc_id % 5 AS y1 FROM documents),
 bx AS (SELECT quad_id, page_id, CAST(trunc(x0 * f) AS BIGINT) AS x, CAST(trunc(y0 * f) AS BIGINT) AS y, CAST(trunc(x1 * f) AS BIGINT) - CAST(trunc(x0 * f) AS BIGINT) AS w,
  CAST(trunc(y1 * f) AS BIGINT) - CAST(trunc(y0 * f) AS BIGINT) AS h FROM b0 JOIN ws USING (page_id)),
 ct AS (SELECT * FROM mk WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.page_id = mk.page_id AND mk.x BETWEEN bx.x AND bx.x + w - 1 AND mk.y BETWEEN bx.y AND bx.y + h - 1
  AND (mk.x IN (bx.x, bx.x + w - 1) OR mk.y IN (bx.y, bx.y + h - 1)))),
 ng AS (SELECT a.page_id, a.y, a.x, b.y AS y2, b.x AS x2 FROM ct a JOIN ct b ON a.page_id = b.page_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
 rc AS (SELECT page_id, y AS ay, x AS ax, y, x FROM ct UNION SELECT rc.page_id, ay, ax, ng.y2, ng.x2 FROM rc JOIN ng ON ng.page_id = rc.page_id AND ng.y = rc.y AND ng.x = rc.x),
 cp AS (SELECT page_id, ay AS y, ax AS x, min(y * 4294967296 + x) AS c FROM rc GROUP BY ALL),
 cc AS (SELECT page_id, c, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM cp GROUP BY page_id, c HAVING count(*) > 9),
 pr AS (SELECT cc.page_id, c, cc.area, cc.x, cc.y, cc.w AS cw, cc.h AS ch, quad_id, b.w * b.h AS la, CAST(least(b.w, b.h) AS DOUBLE) AS fs,
  greatest(0, least(cc.x + cc.w, b.x + b.w) - greatest(cc.x, b.x)) * greatest(0, least(cc.y + cc.h, b.y + b.h) - greatest(cc.y, b.y)) / least(b.w * b.h, cc.area)::DOUBLE AS ratio,
  sqrt(greatest(b.x - (cc.x + cc.w / 2.0), cc.x + cc.w / 2.0 - b.x - b.w, 0) ** 2 + greatest(b.y - (cc.y + cc.h / 2.0), cc.y + cc.h / 2.0 - b.y - b.h, 0) ** 2) AS dist FROM cc JOIN bx b USING (page_id)),
 mo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, c ORDER BY round(ratio, 9) DESC, quad_id) AS k FROM pr) WHERE k = 1),
 ne AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, c ORDER BY round(dist, 9), quad_id DESC) AS k FROM pr) WHERE k = 1),
 ow AS (SELECT mo.page_id, mo.c, mo.x, mo.y, mo.cw, mo.ch, CASE WHEN mo.ratio > 0 AND mo.area >= mo.la THEN NULL WHEN mo.ratio > 0.01 THEN mo.quad_id
  WHEN ne.dist < 0.5 * greatest(10, least(ne.fs, ne.cw, ne.ch)) AND ne.area < ne.la THEN ne.quad_id END AS quad_id FROM mo JOIN ne ON mo.page_id = ne.page_id AND mo.c = ne.c),
 kz AS (SELECT o.quad_id, greatest(3, CAST(trunc((least(min(least(b.w, b.h)), max(o.x + cw) - min(o.x), max(o.y + ch) - min(o.y)) + 20) * 0.3::DOUBLE) AS BIGINT) // 2 * 2 + 1) // 2 AS half
  FROM ow o JOIN bx b ON b.quad_id = o.quad_id GROUP BY o.quad_id),
 g1 AS (SELECT DISTINCT cp.page_id, cp.y + dy AS y, cp.x + dx AS x FROM cp JOIN ow ON ow.page_id = cp.page_id AND ow.c = cp.c JOIN kz USING (quad_id) JOIN ws ON ws.page_id = cp.page_id, range(-20, 21) a(dy), range(-20, 21) b(dx)
  WHERE abs(dy) <= half AND abs(dx) <= round_even(sqrt((half * half - least(dy * dy, half * half))::DOUBLE), 0) AND cp.y + dy BETWEEN 0 AND th - 1 AND cp.x + dx BETWEEN 0 AND tw - 1),
 g2 AS (SELECT DISTINCT page_id, y + dy AS y, x + dx AS x FROM g1 JOIN ws USING (page_id), (VALUES (-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)) k(dy, dx) WHERE y + dy BETWEEN 0 AND th - 1 AND x + dx BETWEEN 0 AND tw - 1),
 px AS (SELECT page_id, a.y, b.x FROM g2 JOIN ws USING (page_id), range(64) a(y), range(64) b(x) WHERE a.y < height AND b.x < width AND g2.y = (a.y * th) // height AND g2.x = (b.x * tw) // width)"""


@query("c5_text_mask", sql=_FIT + " SELECT page_id, y, count(*) AS n, sum(x) AS sx FROM px GROUP BY page_id, y")
def c5_text_mask(spark, sf):
    px = view(spark, sf, "raster")
    return _row_sums(lines.text_mask(_grid_lines(spark, sf), M.to_runs(px.where("v > 152").select("page_id", "y", "x")), R.page_sizes(px)))


@query("c5_fill_mask", sql=RAS + SIZE.format(t="raster") + """, b AS (SELECT doc_id // 20 AS page_id, (doc_id * 7) % 24 AS x0, (doc_id * 5) % 26 AS y0, (doc_id * 7) % 24 + 8 + n_chars % 9 AS x1, (doc_id * 5) % 26 + 4 + doc_id % 5 AS y1 FROM documents),
px AS (SELECT DISTINCT b.page_id, a.y, c.x FROM b JOIN sz USING (page_id), range(64) a(y), range(64) c(x) WHERE y >= y0 AND y < least(y1, height) AND x >= x0 AND x < least(x1, width))
SELECT page_id, y, count(*) AS n, sum(x) AS sx FROM px GROUP BY page_id, y""")
def c5_fill_mask(spark, sf):
    px = view(spark, sf, "raster")
    return _row_sums(lines.text_mask(_grid_lines(spark, sf), M.to_runs(px.limit(0)), R.page_sizes(px), method="fill"))


# the lines reach to the next one of their block, or twice as far: horizontal ones upward, upright ones to the right
@query("c5_fill_mask_expanded", sql=RAS + SIZE.format(t="raster") + """, b AS (SELECT doc_id AS quad_id, doc_id // 20 AS page_id, (doc_id * 7) % 24 AS x, (doc_id * 5) % 26 AS y, 8 + n_chars % 9 AS w, 4 + doc_id % 5 AS h FROM documents),
n AS (SELECT *, h >= w AS vertical, lead(x) OVER k AS nx, lead(y) OVER k AS ny, lead(h) OVER k AS nh FROM b WINDOW k AS (PARTITION BY quad_id // 5 ORDER BY quad_id DESC)),
e AS (SELECT page_id, x, y, x + w AS r, y + h AS b, vertical, CASE WHEN nx IS NULL THEN x + 2 * w ELSE nx END AS rx, CASE WHEN ny IS NULL THEN y - h ELSE ny + nh END AS ty FROM n),
f AS (SELECT page_id, CASE WHEN vertical THEN least(x, rx) ELSE x END AS x0, CASE WHEN vertical THEN greatest(x, rx) ELSE r END AS x1,
 CASE WHEN vertical THEN y ELSE least(b, ty) END AS y0, CASE WHEN vertical THEN b ELSE greatest(b, ty) END AS y1 FROM e),
px AS (SELECT DISTINCT f.page_id, a.y, c.x FROM f JOIN sz USING (page_id), range(64) a(y), range(64) c(x) WHERE y >= y0 AND y < least(y1, height) AND x >= x0 AND x < least(x1, width))
SELECT page_id, y, count(*) AS n, sum(x) AS sx FROM px GROUP BY page_id, y""")
def c5_fill_mask_expanded(spark, sf):
    px = view(spark, sf, "raster")
    blocked = _grid_lines(spark, sf).withColumns({"block_id": F.floor(F.col("quad_id") / 5), "line_no": F.col("quad_id")})
    return _row_sums(lines.text_mask(blocked, M.to_runs(px.limit(0)), R.page_sizes(px), method="fill", expand=True))


# dark lettering on white pages: a blob stays if its frame is nearly all dark or all white; these pages are too small to grow blobs
_BUBBLE = _FIT.replace("r.v > 152", "r.v > 125") + """,
 nb AS (SELECT a.page_id, a.y, a.x, b.y AS y2, b.x AS x2 FROM px a JOIN px b ON a.page_id = b.page_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
 rb AS (SELECT page_id, y AS ay, x AS ax, y, x FROM px UNION SELECT rb.page_id, ay, ax, nb.y2, nb.x2 FROM rb JOIN nb ON nb.page_id = rb.page_id AND nb.y = rb.y AND nb.x = rb.x),
 cb AS (SELECT page_id, ay AS y, ax AS x, min(y * 4294967296 + x) AS c FROM rb GROUP BY page_id, ay, ax),
 bb AS (SELECT page_id, c, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cb GROUP BY page_id, c),
 fr AS (SELECT bb.page_id, c, round(count(*) FILTER (r.v > 125) / count(*)::DOUBLE, 6) * 100 AS black FROM bb JOIN raster r ON r.page_id = bb.page_id AND r.x BETWEEN x0 AND x1 AND r.y BETWEEN y0 AND y1
  WHERE r.x < x0 + 2 OR r.y < y0 + 2 OR r.x > x1 - 2 OR r.y > y1 - 2 GROUP BY bb.page_id, c)"""


@query("c5_text_mask_in_bubbles", sql=_BUBBLE + """
SELECT cb.page_id, cb.y, count(*) AS n, sum(cb.x) AS sx FROM cb JOIN fr USING (page_id, c) WHERE black NOT BETWEEN 47 AND 53 GROUP BY cb.page_id, cb.y""")
def c5_text_mask_in_bubbles(spark, sf):
    px = cut_lineage(view(spark, sf, "raster"))
    mask = M.to_runs(px.where("v > 125").select("page_id", "y", "x"))
    page = px.select("page_id", "y", "x", *[F.when(F.col("v") > 125, 0).otherwise(255).alias(c) for c in "rgb"])
    return _row_sums(lines.text_mask(_grid_lines(spark, sf), mask, R.page_sizes(px), page, bubble=47))


@query("c6_mask_refine")
def c6_mask_refine(spark, sf):
    rgb = cut_lineage(view(spark, sf, "rgb"))
    pages = R.page_sizes(rgb)
    q = cut_lineage(_grid_lines(spark, sf)).groupBy("page_id", (F.floor((F.col("quad_id") % 20) / 5)).alias("block_id")).agg(
        F.min("bx").alias("x1"), F.min("by").alias("y1"), F.max(F.col("bx") + F.col("bw")).alias("x2"), F.max(F.col("by") + F.col("bh")).alias("y2"))
    q = q.join(pages, "page_id").withColumns({"x2": F.least("x2", "width"), "y2": F.least("y2", "height")}).where("x1 < x2 AND y1 < y2")
    q = cut_lineage(q)
    w = G.enlarge_window(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("width"), F.col("height"), 2.5, 1.0)
    windows = q.select("page_id", "block_id", *[c.alias(n) for c, n in zip(w, ("x1", "y1", "x2", "y2"))])
    return _row_sums(lines.refine_masks(rgb, windows))
