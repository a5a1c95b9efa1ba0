"""Filters on lines, spatial joins, components, spanning trees and the region merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.operators import filters, order, regions, spatial
from folioframe.operators import graph as graph_ops
from folioframe.plans import sqltext as S
from folioframe.plans.registry import query
from folioframe.plans.views import ctes, slanted, table, textlines
from folioframe.session import cut_lineage


def upright_geo(spark, sf):
    return cut_lineage(G.with_geometry(G.with_corner_order(textlines(spark, sf))))


def slanted_geo(spark, sf):
    return G.with_geometry(slanted(spark, sf))


def _pairs_sql(rule, geo):
    return geo[0] + f"""
SELECT page_id, u, v, round(dist, 6) AS dist FROM (
 SELECT a.page_id, a.quad_id AS u, b.quad_id AS v, dist, {S.can_merge('a', 'b', rule)} AS ok
 FROM (SELECT a, b, {S.quad_distance('a', 'b')} AS dist FROM {geo[1]} a JOIN {geo[1]} b ON a.page_id = b.page_id AND a.quad_id < b.quad_id))
WHERE ok"""


def _pairs(df, rule):
    return spatial.mergeable_pairs(df, rule).select("page_id", "u", "v", F.round("dist", 6).alias("dist"))


@query("j1_mergeable_pairs", sql=_pairs_sql(S.MERGE, (S.SLANTED_GEO, "geo")))
def j1_mergeable_pairs(spark, sf):
    return _pairs(slanted_geo(spark, sf), spatial.MERGE_RULE)


@query("j1_mergeable_pairs_upright", sql=_pairs_sql(S.MERGE, (S.BOX_LINES, "bgeo")))
def j1_mergeable_pairs_upright(spark, sf):
    return _pairs(upright_geo(spark, sf), spatial.MERGE_RULE)


@query("j2_direction_pairs", sql=_pairs_sql(S.DIRECTION, (S.SLANTED_GEO, "geo")))
def j2_direction_pairs(spark, sf):
    return _pairs(slanted_geo(spark, sf), spatial.DIRECTION_RULE)


@query("j3_j4_line_distances", sql=S.SLANTED_GEO + f"""
SELECT a.quad_id AS u, b.quad_id AS v, round({S.quad_distance('a', 'b')}, 6) AS hull_dist,
 round(sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2), 6) AS start_dist
FROM geo a JOIN geo b ON a.page_id = b.page_id AND b.quad_id IN (a.quad_id + 1, a.quad_id + 2)""")
def j3_j4_line_distances(spark, sf):
    df = slanted(spark, sf).select("page_id", "quad_id", "pts")
    nxt = df.select("page_id", F.col("quad_id").alias("v"), F.col("pts").alias("q"))
    left = df.withColumn("v", F.explode(F.array(F.col("quad_id") + 1, F.col("quad_id") + 2)))
    return left.join(nxt, ["page_id", "v"]).select(
        F.col("quad_id").alias("u"), "v", F.round(G.quad_distance("pts", "q"), 6).alias("hull_dist"),
        F.round(G.line_start_distance(F.col("pts"), F.col("q")), 6).alias("start_dist"))


@query("a1_components", sql=S.BOX_LINES_R + "," + S.region_ctes(S.MERGE, 0.0) + """
SELECT ln.page_id, ln.quad_id, c.component FROM ln JOIN cmp c USING (quad_id)""")
def a1_components(spark, sf):
    geo = upright_geo(spark, sf)
    return graph_ops.connected_components(
        geo.select("page_id", "quad_id"), spatial.grouping_edges(geo))


# the rank makes the order total; an edge is in the tree when no path of smaller
# ranks joins its ends (at most four steps among five points)
@query("a2_spanning_tree", sql=ctes("textlines") + """
, p AS (SELECT page_id, quad_id // 5 AS component, quad_id AS id, x, y FROM textlines),
 e AS (SELECT a.page_id, a.component, a.id AS u, b.id AS v, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS w FROM p a JOIN p b ON a.component = b.component AND a.id < b.id),
 k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY w, u, v) AS rk FROM e),
 m1 AS (SELECT component, u, v, rk FROM k UNION ALL SELECT component, v, u, rk FROM k),
 m2 AS (SELECT component, u, v, min(rk) AS rk FROM (SELECT * FROM m1 UNION ALL SELECT a.component, a.u, b.v, greatest(a.rk, b.rk) FROM m1 a JOIN m1 b ON a.component = b.component AND a.v = b.u WHERE a.u <> b.v) GROUP BY ALL),
 m4 AS (SELECT component, u, v, min(rk) AS rk FROM (SELECT * FROM m2 UNION ALL SELECT a.component, a.u, b.v, greatest(a.rk, b.rk) FROM m2 a JOIN m2 b ON a.component = b.component AND a.v = b.u WHERE a.u <> b.v) GROUP BY ALL)
SELECT k.page_id, k.component, k.u, k.v, round(k.w, 6) AS w FROM k JOIN m4 USING (component, u, v) WHERE k.rk <= m4.rk""")
def a2_spanning_tree(spark, sf):
    x, y = G.corner(F.col("pts"), 0)
    points = textlines(spark, sf).select(
        "page_id", (F.col("quad_id") / 5).cast("bigint").alias("component"), F.col("quad_id").alias("id"), x.alias("x"), y.alias("y"))
    return graph_ops.spanning_forest(points).select("page_id", "component", "u", "v", F.round("w", 6).alias("w"))


@query("a3_region_split", sql=S.BOX_LINES_R + "," + S.region_ctes(S.MERGE, 0.0) + """
SELECT page_id, quad_id, region FROM lab""")
def a3_region_split(spark, sf):
    return regions.regions(upright_geo(spark, sf)).select("page_id", "quad_id", "region")


@query("a3_region_split_by_rounds", sql=S.BOX_LINES_R + "," + S.region_ctes(S.MERGE, 0.0) + """
SELECT page_id, quad_id, region FROM lab""")
def a3_region_split_by_rounds(spark, sf):
    """Every component takes the way of the large ones."""
    return regions.regions(upright_geo(spark, sf), limit=1).select("page_id", "quad_id", "region")


@query("a4_a8_region_measures", sql=S.BLOCKS_SQL + """
SELECT page_id, region AS block_id, vert AS vertical, n_lines, font_size, round(angle, 6) AS angle, round(prob, 6) AS prob, fg_r, bg_b FROM blk""")
def a4_a8_region_measures(spark, sf):
    geo = cut_lineage(G.with_geometry(G.with_corner_order(filters.min_probability(textlines(spark, sf)))))
    b = regions.text_blocks(regions.regions(geo))
    return b.select("page_id", "block_id", "vertical", "n_lines", "font_size", F.round("angle", 6).alias("angle"),
                    F.round("prob", 6).alias("prob"), F.col("fg")[0].cast("bigint").alias("fg_r"), F.col("bg")[2].cast("bigint").alias("bg_b"))


@query("a10_line_count", sql=ctes("textlines") + """
SELECT page_id, count(*) AS lines_in, count(*) AS lines_out, true AS same FROM textlines GROUP BY page_id""")
def a10_line_count(spark, sf):
    lines = textlines(spark, sf)
    return regions.line_count_check(lines, regions.line_merge(lines))


@query("w1_reading_order", sql=S.BLOCKS_SQL + """
SELECT region AS block_id, quad_id, row_number() OVER (PARTITION BY region ORDER BY CASE WHEN vert THEN -cx ELSE cy END, quad_id) AS line_no
FROM rl JOIN rd USING (region)""")
def w1_reading_order(spark, sf):
    geo = cut_lineage(G.with_geometry(G.with_corner_order(filters.min_probability(textlines(spark, sf)))))
    return order.reading_order(regions.regions(geo)).select(F.col("region").alias("block_id"), "quad_id", F.col("line_no").cast("bigint"))


@query("w13_page_area_share", sql=S.BOX_LINES + """
SELECT quad_id, round(area / sum(area) OVER (PARTITION BY page_id), 6) AS share FROM bgeo""")
def w13_page_area_share(spark, sf):
    return order.page_share(upright_geo(spark, sf), "area").select("quad_id", F.round("share", 6).alias("share"))


_C3 = S.BLOCKS_SQL + """,
tx AS (SELECT *, regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS stripped FROM blk),""" + S.repair_ctes("tx", "region", "stripped") + """
SELECT page_id, region AS block_id, vert AS vertical, n_lines, fixed AS text, font_size, round(angle, 6) AS angle, round(prob, 6) AS prob
FROM tx JOIN repaired ON rk = region"""


@query("c3_region_merge", sql=_C3 + " WHERE octet_length(encode(fixed)) >= 1 AND regexp_matches(fixed, '\\p{L}')")
def c3_region_merge(spark, sf):
    b = regions.merge_regions(textlines(spark, sf))
    return b.select("page_id", "block_id", "vertical", "n_lines", "text", "font_size",
                    F.round("angle", 6).alias("angle"), F.round("prob", 6).alias("prob"))


@query("ud7_line_merge", sql=S.BLOCKS_SQL.replace("prob >= 0.2", "prob >= 0.0") + """
SELECT page_id, region AS block_id, text, n_lines, round(angle, 6) AS angle FROM blk""")
def ud7_line_merge(spark, sf):
    b = regions.line_merge(textlines(spark, sf))
    return b.select("page_id", "block_id", "text", F.size("lines").cast("bigint").alias("n_lines"), F.round("angle", 6).alias("angle"))


# --- direction groups and OCR batches ---------------------------------------

_DIR = (S.BOX_LINES_R + "," + S.region_ctes(S.DIRECTION, 0.0) + """,
g AS (SELECT component, count(*) FILTER (vertical) > count(*) // 2 AS dir FROM mem GROUP BY component),
o AS (SELECT m.*, dir, row_number() OVER (PARTITION BY m.component ORDER BY CASE WHEN dir THEN -(bx + bw) ELSE by_ + bh // 2 END, quad_id) AS pos FROM mem m JOIN g USING (component))""")


@query("a11_w2_direction_order", sql=_DIR + """
SELECT page_id, component, quad_id, dir AS vertical_group, pos FROM o""")
def a11_w2_direction_order(spark, sf):
    return order.direction_order(upright_geo(spark, sf)).select(
        "page_id", "component", "quad_id", "vertical_group", F.col("pos").cast("bigint").alias("pos"))


_STRIP = "CAST(trunc(CASE WHEN {v} THEN bh * 48::DOUBLE / bw ELSE bw * 48::DOUBLE / bh END) AS BIGINT)"


@query("w6_width_batches", sql=S.BOX_LINES + f"""
, s AS (SELECT page_id, quad_id, {_STRIP.format(v="vertical")} AS strip FROM bgeo),
 r AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY strip, quad_id) - 1) // 16 AS batch FROM s)
SELECT page_id, quad_id, strip, batch, max(strip) OVER (PARTITION BY page_id, batch) + 7 AS pad_width FROM r""")
def w6_width_batches(spark, sf):
    return order.width_batches(upright_geo(spark, sf), F.col("vertical"), text_height=48, size=16)


@query("c2_ocr_order", sql=_DIR + f"""
, s AS (SELECT page_id, quad_id, component, dir, pos, {_STRIP.format(v="dir")} AS strip FROM o),
 r AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY strip, quad_id) - 1) // 16 AS batch FROM s)
SELECT page_id, quad_id, component, dir AS vertical_group, pos, strip, batch, max(strip) OVER (PARTITION BY page_id, batch) + 7 AS pad_width FROM r""")
def c2_ocr_order(spark, sf):
    df = order.direction_order(upright_geo(spark, sf))
    return order.width_batches(df, F.col("vertical_group"), text_height=48, size=16,
                               keep=["component", "vertical_group", F.col("pos").cast("bigint").alias("pos")])


@query("a12_running_mean", sql="SELECT event_type, coalesce(round(avg(value), 6), 0) AS mean FROM events GROUP BY event_type")
def a12_running_mean(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(order.meter("value").alias("mean"))


@query("a13_rotation_vote", sql=S.BOX_LINES + """
SELECT p.page_id, count(g.quad_id) = 0 OR count(*) FILTER (g.aspect > 1) * 2 >= count(*) AS rotate
FROM pages p LEFT JOIN bgeo g ON g.page_id = p.page_id GROUP BY p.page_id""")
def a13_rotation_vote(spark, sf):
    return order.rotation_vote(table(spark, sf, "pages").select("page_id"), upright_geo(spark, sf))


# --- filters ----------------------------------------------------------------


@query("f1_f6_detector_filters", sql=S.BOX_LINES + """
SELECT quad_id, round(score, 6) AS score FROM bgeo
WHERE score > 0.55 AND least(bw, bh) >= 21 AND NOT 0.6 > score AND score < 'inf'::DOUBLE AND x0 + x1 + x2 + x3 + y0 + y1 + y2 + y3 > 0 AND area >= 1600""")
def f1_f6_detector_filters(spark, sf):
    df = filters.above(textlines(spark, sf), "score", 0.55)
    df = filters.finite_score(filters.box_threshold(df, 0.6))
    x, y, x2, y2 = G.bounds(F.col("pts"))
    df = filters.min_side(df.withColumns({"w": x2 - x, "h": y2 - y}), "w", "h", 21)
    return filters.min_area(filters.non_zero(df), 1600.0).select("quad_id", F.round("score", 6).alias("score"))


@query("f3_strict_threshold", sql="SELECT quad_id FROM (" + ctes("textlines") + " SELECT * FROM textlines) WHERE score > 0.6")
def f3_strict_threshold(spark, sf):
    return filters.box_threshold(textlines(spark, sf), 0.6, strict=True).select("quad_id")


@query("f7_min_probability", sql=ctes("textlines") + " SELECT quad_id, round(prob, 6) AS prob FROM textlines WHERE prob >= 0.2")
def f7_min_probability(spark, sf):
    return filters.min_probability(textlines(spark, sf)).select("quad_id", F.round("prob", 6).alias("prob"))


_UNWANTED = ["user", "page view"]


@query("f8_f10_text_filters", sql="""
SELECT conv_id, turn FROM conversations WHERE octet_length(encode(text)) >= 200 AND regexp_matches(text, '\\p{L}') AND text NOT IN ('user', 'page view')""")
def f8_f10_text_filters(spark, sf):
    df = table(spark, sf, "conversations")
    return df.where(filters.drop_reason(F.col("text"), 200, _UNWANTED).isNull()).select("conv_id", "turn")


@query("f10_remove_regex", sql="SELECT conv_id, turn FROM conversations WHERE NOT regexp_matches(text, '(?:tion\\.)|(?:^The )')")
def f10_remove_regex(spark, sf):
    df = table(spark, sf, "conversations")
    return df.where(~filters.unwanted(F.col("text"), [r"tion\.", "^The "], "regex")).select("conv_id", "turn")


@query("x26_filter_audit", sql="""
SELECT reason, skipped, count(*) AS n FROM (SELECT CASE WHEN octet_length(encode(text)) < 900 THEN 'too short'
 WHEN NOT regexp_matches(text, '\\p{L}') THEN 'not valuable' WHEN lang IN ('de', 'fr') THEN 'skip language' END AS reason, lang IN ('de', 'fr') AS skipped FROM documents) GROUP BY ALL""")
def x26_filter_audit(spark, sf):
    df = filters.flag_skip_language(table(spark, sf, "documents").withColumnRenamed("lang", "language"), ["de", "fr"])
    reason = F.coalesce(filters.drop_reason(F.col("text"), 900), F.when(F.col("skip_translate"), F.lit("skip language")))
    return df.groupBy(reason.alias("reason"), F.col("skip_translate").alias("skipped")).agg(F.count(F.lit(1)).alias("n"))


@query("f11_f12_u5_skip_and_keep", sql="""
SELECT doc_id, lang IN ('de', 'fr') AS skip_translate, CASE WHEN lang IN ('de', 'fr') THEN text ELSE '<' || text END AS text FROM documents""")
def f11_f12_u5_skip_and_keep(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), "text")
    todo, rest = filters.split_translatable(filters.flag_skip_language(df, ["de", "fr"]))
    done = todo.withColumn("text", F.concat(F.lit("<"), "text"))
    return done.unionByName(rest).select("doc_id", "skip_translate", "text")


@query("f15_r14_strip_plan", sql="""
, """.join([ctes("textlines"), """q AS (SELECT quad_id, greatest(w, h) * 4 AS l, least(w, h) AS s FROM textlines),
 n AS (SELECT *, l / 200.0 > 2.5 AND l::DOUBLE / s > 3 AS need, greatest(2, CAST(floor(400.0 / s) AS BIGINT)) * s AS ph FROM q),
 c AS (SELECT *, CAST(ceil(l::DOUBLE / ph) AS BIGINT) AS strips FROM n WHERE need),
 t AS (SELECT *, CASE WHEN strips > 1 THEN (l - ph) // (strips - 1) ELSE 0 END AS step, unnest(range(strips)) AS strip FROM c)
SELECT quad_id, strip, strip * step AS top, least(strip * step + ph, l) AS bottom FROM t"""]))
def f15_r14_strip_plan(spark, sf):
    from folioframe.operators.plans_table import strip_plan

    x, y, x2, y2 = G.bounds(F.col("pts"))
    df = textlines(spark, sf).select("quad_id", (F.greatest(x2 - x, y2 - y) * 4).alias("h"), F.least(x2 - x, y2 - y).alias("w"))
    return strip_plan(df, 200).select("quad_id", "strip", "top", "bottom")


@query("f16_safe_names", sql="""
SELECT page_id, regexp_matches(url, '^[^/\\\\]+$') AS safe, regexp_matches(u, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$') AS uuid
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE replace(url, '/', '_') END AS url,
 CASE WHEN page_id % 3 = 0 THEN md5(url) ELSE regexp_replace(md5(url), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS u FROM pages)""")
def f16_safe_names(spark, sf):
    df = table(spark, sf, "pages")
    url = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.replace("url", F.lit("/"), F.lit("_")))
    code = F.md5("url")
    dashed = F.regexp_replace(code, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    u = F.when(F.col("page_id") % 3 == 0, code).otherwise(dashed)
    return df.select("page_id", T.safe_file_name(url).alias("safe"), T.is_uuid(u).alias("uuid"))


@query("f17_short_circuit", sql=ctes("textlines") + """
SELECT page_id, 'detect' AS stage, 'skipped' AS status FROM pages WHERE page_id NOT IN (SELECT page_id FROM textlines WHERE prob >= 0.2)""")
def f17_short_circuit(spark, sf):
    return filters.short_circuit(table(spark, sf, "pages"), filters.min_probability(textlines(spark, sf)), "detect")
