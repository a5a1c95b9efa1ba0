"""Panel relations, grouping, merging, segments and reading order."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import filters
from folioframe.operators import panels as P
from folioframe.plans.registry import query
from folioframe.plans.views import ctes, view

PAGE_W, PAGE_H = 1100, 1300


def _o(p, q):
    """Overlap sizes of two boxes."""
    return f"(least({p}.r, {q}.r) - greatest({p}.x, {q}.x))", f"(least({p}.b, {q}.b) - greatest({p}.y, {q}.y))"


def _meets(p, q):
    return f"NOT ({p}.x > {q}.r OR {q}.x > {p}.r OR {p}.y > {q}.b OR {q}.y > {p}.b)"


def _area(p):
    return f"(({p}.r - {p}.x) * ({p}.b - {p}.y))"


def _overlaps(p, q):
    w, h = _o(p, q)
    return f"({_meets(p, q)} AND (least({_area(p)}, {_area(q)}) = 0 OR {w} * {h} > 0.1 * least({_area(p)}, {_area(q)})))"


def _contains(p, q):
    w, h = _o(p, q)
    return f"({_meets(p, q)} AND {w} * {h} > 0.5 * {_area(q)})"


def _close(p, q):
    return (f"(abs(({p}.x + {p}.r) / 2.0 - ({q}.x + {q}.r) / 2.0) <= ({p}.r - {p}.x + {q}.r - {q}.x) * 0.75 AND "
            f"abs(({p}.y + {p}.b) / 2.0 - ({q}.y + {q}.b) / 2.0) <= ({p}.b - {p}.y + {q}.b - {q}.y) * 0.75)")


def _band(p, q, lo, hi):
    a0, a1, b0, b1 = (f"CASE WHEN {p}.{lo} < {q}.{lo} THEN {s}.{e} ELSE {t}.{e} END" for s, t, e in (
        (p, q, lo), (p, q, hi), (q, p, lo), (q, p, hi)))
    short = f"least(({a1}) - ({a0}), ({b1}) - ({b0}))"
    return (f"(CASE WHEN ({b0}) > ({a1}) THEN false WHEN ({b1}) < ({a1}) THEN true WHEN {short} = 0 THEN true "
            f"ELSE (least(({a1}), ({b1})) - ({b0})) * 3 >= {short} END)")


def _equal(p, q):
    return (f"(abs({p}.x - {q}.x) < ({p}.r - {p}.x) / 10.0 AND abs({p}.y - {q}.y) < ({p}.b - {p}.y) / 10.0 AND "
            f"abs({p}.r - {q}.r) < ({p}.r - {p}.x) / 10.0 AND abs({p}.b - {q}.b) < ({p}.b - {p}.y) / 10.0)")


_PAIR = "SELECT p.page_id, p.panel_id AS a, q.panel_id AS b{extra} FROM boxes p JOIN boxes q ON p.page_id = q.page_id AND {on}"


def _pairs(df, *extra):
    return df.select(F.col("l_page_id").alias("page_id"), F.col("l_panel_id").alias("a"), F.col("r_panel_id").alias("b"), *extra)


def _boxes(spark, sf):
    return view(spark, sf, "boxes")


_SMALL = "(r - x < 1100 * 0.1 OR b - y < 1300 * 0.1)"


@query("f13_small_panels", sql=ctes("panels") + f"""
SELECT panel_id, {_SMALL} AS small, (r - x < 1100 * 0.01 OR b - y < 1300 * 0.01) AS very_small, (r - x < 1100 * 0.2 OR b - y < 1300 * 0.2) AS small2 FROM panels""")
def f13_small_panels(spark, sf):
    w, h = F.col("r") - F.col("x"), F.col("b") - F.col("y")
    s = lambda k: filters.is_small(w, h, PAGE_W, PAGE_H, 0.1, k)
    return view(spark, sf, "panels").select("panel_id", s(1.0).alias("small"), s(0.1).alias("very_small"), s(2.0).alias("small2"))


@query("j6_close_panels", sql=ctes("boxes") + " " + _PAIR.format(extra="", on="p.panel_id < q.panel_id AND " + _close("p", "q")))
def j6_close_panels(spark, sf):
    return _pairs(P.close_pairs(_boxes(spark, sf)))


@query("j7_panel_overlap", sql=ctes("boxes") + " " + _PAIR.format(
    extra=", {} * {} AS area, {} AS strong".format(*_o("p", "q"), _overlaps("p", "q")), on="p.panel_id < q.panel_id AND " + _meets("p", "q")))
def j7_panel_overlap(spark, sf):
    b = _boxes(spark, sf)
    df = P.relation(b, b, lambda p, q: P.meets(p, q)).where("l_panel_id < r_panel_id")
    p, q = P._Side(lambda c: F.col(f"l_{c}")), P._Side(lambda c: F.col(f"r_{c}"))
    return _pairs(df, P.overlap_box(p, q).area.alias("area"), P.overlaps(p, q).alias("strong"))


@query("j8_panel_containment", sql=ctes("boxes") + " " + _PAIR.format(extra="", on="p.panel_id <> q.panel_id AND " + _contains("p", "q")))
def j8_panel_containment(spark, sf):
    b = _boxes(spark, sf)
    return _pairs(P.relation(b, b, P.contains).where("l_panel_id <> r_panel_id"))


@query("j9_same_row", sql=ctes("boxes") + " " + _PAIR.format(extra="", on="p.panel_id <> q.panel_id AND " + _band("p", "q", "y", "b")))
def j9_same_row(spark, sf):
    return _pairs(P.band_pairs(_boxes(spark, sf), "y", lambda p, q: F.lit(True)))


@query("j9_same_column", sql=ctes("boxes") + " " + _PAIR.format(extra="", on="p.panel_id <> q.panel_id AND " + _band("p", "q", "x", "r")))
def j9_same_column(spark, sf):
    return _pairs(P.band_pairs(_boxes(spark, sf), "x", lambda p, q: F.lit(True)))


_NEAR = f"""nb AS (SELECT p.page_id, p.panel_id, p.x, p.y,
  arg_max(q.panel_id, (q.b, q.panel_id)) FILTER (q.b < p.y AND {_band('p', 'q', 'x', 'r')}) AS top, max(q.b) FILTER (q.b < p.y AND {_band('p', 'q', 'x', 'r')}) AS top_b,
  arg_max(q.panel_id, (q.r, q.panel_id)) FILTER (q.r <= p.x AND {_band('p', 'q', 'y', 'b')}) AS lft, max(q.r) FILTER (q.r <= p.x AND {_band('p', 'q', 'y', 'b')}) AS lft_r,
  arg_min(q.panel_id, (q.x, q.panel_id)) FILTER (q.x >= p.r AND {_band('p', 'q', 'y', 'b')}) AS rgt,
  arg_min(q.panel_id, (q.y, q.panel_id)) FILTER (q.y >= p.b AND {_band('p', 'q', 'x', 'r')}) AS bot
 FROM {{t}} p LEFT JOIN {{t}} q ON p.page_id = q.page_id AND p.panel_id <> q.panel_id GROUP BY p.page_id, p.panel_id, p.x, p.y)"""


@query("j10_neighbours", sql=ctes("boxes") + ", " + _NEAR.format(t="boxes") + " SELECT page_id, panel_id, top, lft, rgt, bot FROM nb")
def j10_neighbours(spark, sf):
    return P.neighbours(_boxes(spark, sf)).select(
        "page_id", "panel_id", F.col("top.panel_id").alias("top"), F.col("left.panel_id").alias("lft"),
        F.col("right.panel_id").alias("rgt"), F.col("bottom.panel_id").alias("bot"))


@query("j11_rough_equality", sql=ctes("boxes") + " " + _PAIR.format(extra="", on="p.panel_id <> q.panel_id AND " + _equal("p", "q")))
def j11_rough_equality(spark, sf):
    b = _boxes(spark, sf)
    return _pairs(P.relation(b, b, P.roughly_equal).where("l_panel_id <> r_panel_id"))


@query("a21_gutters", sql=ctes("boxes") + ", " + _NEAR.format(t="boxes") + """
SELECT page_id, coalesce(min(x - lft_r), 1) AS gap_x, coalesce(min(y - top_b), 1) AS gap_y FROM nb GROUP BY page_id""")
def a21_gutters(spark, sf):
    return P.gutters(P.neighbours(_boxes(spark, sf)))


@query("a18_small_panel_groups", sql=ctes("boxes").replace("WITH", "WITH RECURSIVE", 1) + f""",
 sm AS (SELECT * FROM boxes WHERE {_SMALL}),
 e AS (SELECT p.page_id, p.panel_id AS u, q.panel_id AS v FROM sm p JOIN sm q ON p.page_id = q.page_id AND p.panel_id <> q.panel_id AND {_close('p', 'q')}),
 rc AS (SELECT page_id, panel_id AS a, panel_id AS b FROM sm UNION SELECT rc.page_id, rc.a, e.v FROM rc JOIN e ON e.page_id = rc.page_id AND e.u = rc.b),
 cp AS (SELECT page_id, a AS panel_id, min(b) AS c FROM rc GROUP BY page_id, a)
SELECT page_id, panel_id, x, y, r, b FROM boxes WHERE NOT {_SMALL} UNION ALL
SELECT sm.page_id, c, min(x), min(y), max(r), max(b) FROM sm JOIN cp USING (page_id, panel_id) GROUP BY sm.page_id, c""")
def a18_small_panel_groups(spark, sf):
    return P.group_small(_boxes(spark, sf), PAGE_W, PAGE_H, 0.1)


def _alike(p, q):
    """Edges differ by less than a tenth of the first box."""
    return (f"(10 * abs({p}.x - {q}.x) < {p}.r - {p}.x AND 10 * abs({p}.r - {q}.r) < {p}.r - {p}.x AND "
            f"10 * abs({p}.y - {q}.y) < {p}.b - {p}.y AND 10 * abs({p}.b - {q}.b) < {p}.b - {p}.y)")


def _covers(p, q):
    w, h = _o(p, q)
    return f"({w} >= 0 AND {h} >= 0 AND {w} * {h} * 2 > {_area(q)})"


def _bumps(o, g):
    w, h = _o(o, g)
    return f"(NOT {_alike(o, g)} AND {w} >= 0 AND {h} >= 0 AND (least({_area(o)}, {_area(g)}) = 0 OR {w} * {h} * 10 > least({_area(o)}, {_area(g)})))"


# one step per pair, first to last, which carries the boxes of the page: of the 16 ways to take edges of the inner box, those that bump into no
# third one, the largest and of these the last
@query("a19_merge_contained", sql=ctes("boxes").replace("WITH", "WITH RECURSIVE", 1) + f""",
 li AS (SELECT page_id, list({{'x': x::BIGINT, 'y': y::BIGINT, 'r': r::BIGINT, 'b': b::BIGINT}} ORDER BY panel_id) AS boxes, list(panel_id ORDER BY panel_id) AS ids FROM boxes GROUP BY page_id),
 ij AS (SELECT page_id, i, j, row_number() OVER (PARTITION BY page_id ORDER BY i, j) AS k FROM (SELECT page_id, i, unnest(range(i + 1, len(boxes) + 1)) AS j FROM (SELECT page_id, boxes, unnest(range(1, len(boxes))) AS i FROM li))),
 st AS (SELECT page_id, 0::BIGINT AS k, boxes, []::BIGINT[] AS gone FROM li
  UNION ALL SELECT page_id, k, CASE WHEN outer_ IS NULL THEN boxes ELSE list_concat(list_concat(boxes[:outer_ - 1], [best]), boxes[outer_ + 1:]) END,
   CASE WHEN outer_ IS NULL THEN gone ELSE list_append(gone, inner_) END FROM (
    SELECT *, coalesce(list_sort(list_transform(list_filter(ways, lambda g: len(list_filter(others, lambda o: {_bumps('o', 'g')})) = 0),
      lambda g: {{'size': {_area('g')}, 'm': g.m, 'box': {{'x': g.x, 'y': g.y, 'r': g.r, 'b': g.b}}}}))[-1].box, p) AS best FROM (
     SELECT *, list_filter(boxes, lambda o: NOT {_alike('o', 'p')} AND NOT {_alike('o', 'q')}) AS others,
      list_transform(list_filter(range(16), lambda m: (m % 2 = 0 OR q.x < p.x) AND (m // 2 % 2 = 0 OR q.r > p.r) AND (m // 4 % 2 = 0 OR q.y < p.y) AND (m // 8 = 0 OR q.b > p.b)),
       lambda m: {{'m': m, 'x': CASE WHEN m % 2 = 1 THEN q.x ELSE p.x END, 'r': CASE WHEN m // 2 % 2 = 1 THEN q.r ELSE p.r END, 'y': CASE WHEN m // 4 % 2 = 1 THEN q.y ELSE p.y END, 'b': CASE WHEN m // 8 = 1 THEN q.b ELSE p.b END}}) AS ways FROM (
      SELECT *, boxes[coalesce(outer_, i)] AS p, boxes[coalesce(inner_, j)] AS q FROM (
       SELECT *, CASE WHEN {_covers('u', 'v')} THEN i WHEN {_covers('v', 'u')} THEN j END AS outer_, CASE WHEN {_covers('u', 'v')} THEN j WHEN {_covers('v', 'u')} THEN i END AS inner_ FROM (
        SELECT ij.*, st.boxes, st.gone, st.boxes[ij.i] AS u, st.boxes[ij.j] AS v FROM st JOIN ij ON ij.page_id = st.page_id AND ij.k = st.k + 1)))))),
 en AS (SELECT page_id, arg_max(boxes, k) AS boxes, arg_max(gone, k) AS gone FROM st GROUP BY page_id)
SELECT page_id, ids[n] AS panel_id, boxes[n].x AS x, boxes[n].y AS y, boxes[n].r AS r, boxes[n].b AS b FROM (SELECT en.*, ids, unnest(range(1, len(ids) + 1)) AS n FROM en JOIN li USING (page_id)) WHERE NOT list_contains(gone, n)""")
def a19_merge_contained(spark, sf):
    return P.merge_contained(_boxes(spark, sf))


_UNION_OF = "{{'x': least({p}.x, {q}.x), 'y': least({p}.y, {q}.y), 'r': greatest({p}.r, {q}.r), 'b': greatest({p}.b, {q}.b)}}"


# one step per merge, which carries the panels of the page in their order: the first pair of them whose common box bumps into no third panel and
# holds no long segment
@query("a20_group_big_panels", sql=ctes("panels", "segments").replace("WITH", "WITH RECURSIVE", 1) + f""",
 sl AS (SELECT page_id, list({{'x': least(ax, bx), 'y': least(ay, "by"), 'r': greatest(ax, bx), 'b': greatest(ay, "by")}}) AS segs FROM segments GROUP BY page_id),
 li AS (SELECT page_id, list({{'id': panel_id, 'x': x, 'y': y, 'r': r, 'b': b}} ORDER BY panel_id) AS boxes FROM panels GROUP BY page_id),
 st AS (SELECT page_id, 0 AS k, boxes, coalesce(segs, []) AS segs FROM li LEFT JOIN sl USING (page_id)
  UNION ALL SELECT page_id, k + 1, list_append(list_filter(boxes, lambda o: o.id <> boxes[ij.i].id AND o.id <> boxes[ij.j].id),
    {{'id': least(boxes[ij.i].id, boxes[ij.j].id), 'x': u.x, 'y': u.y, 'r': u.r, 'b': u.b}}), segs FROM (
   SELECT *, {_UNION_OF.format(p='boxes[ij.i]', q='boxes[ij.j]')} AS u FROM (
    SELECT *, list_filter(list_transform(list_filter([{', '.join(f"{{'i': {i}, 'j': {j}}}" for i in range(1, 7) for j in range(i + 1, 7))}], lambda m: m.j <= len(boxes)),
      lambda m: {{'i': m.i, 'j': m.j, 'p': boxes[m.i], 'q': boxes[m.j], 'u': {_UNION_OF.format(p='boxes[m.i]', q='boxes[m.j]')}}}), lambda c:
      len(list_filter(boxes, lambda o: {_overlaps('c.u', 'o')} AND NOT {_equal('o', 'c.p')} AND NOT {_equal('o', 'c.q')} AND NOT {_equal('o', 'c.u')})) = 0
      AND len(list_filter(segs, lambda o: {_overlaps('c.u', 'o')} AND sqrt((o.r - o.x) ** 2 + (o.b - o.y) ** 2) > sqrt((c.u.r - c.u.x) ** 2 + (c.u.b - c.u.y) ** 2) / 5)) = 0)[1] AS ij
    FROM st) WHERE ij IS NOT NULL)),
 en AS (SELECT page_id, arg_max(boxes, k) AS boxes FROM st GROUP BY page_id)
SELECT page_id, o.id AS panel_id, o.x AS x, o.y AS y, o.r AS r, o.b AS b FROM (SELECT page_id, unnest(boxes) AS o FROM en)""")
def a20_group_big_panels(spark, sf):
    return P.group_big(view(spark, sf, "panels"), view(spark, sf, "segments")).drop("pos")


@query("t7_largest_panel_first", sql=ctes("panels") + """
SELECT page_id, panel_id, row_number() OVER (PARTITION BY page_id ORDER BY (r - x) * (b - y) DESC, panel_id) AS place FROM panels""")
def t7_largest_panel_first(spark, sf):
    return P.largest_first(view(spark, sf, "panels")).select("page_id", "panel_id", "place")


@query("j13_segments_in_panels", sql=ctes("panels", "segments") + f""",
 s AS (SELECT page_id, seg_id, least(ax, bx) AS x, least(ay, "by") AS y, greatest(ax, bx) AS r, greatest(ay, "by") AS b FROM segments)
SELECT p.page_id, p.panel_id, s.seg_id FROM panels p JOIN s ON p.page_id = s.page_id AND {_overlaps('p', 's')}
 AND sqrt((s.r - s.x) ** 2 + (s.b - s.y) ** 2) > sqrt((p.r - p.x) ** 2 + (p.b - p.y) ** 2) / 5""")
def j13_segments_in_panels(spark, sf):
    return P.long_segments(view(spark, sf, "panels"), view(spark, sf, "segments")).select("page_id", "panel_id", "seg_id")


def _off(s, px, py):
    return (f"CASE WHEN {s}.len = 0 THEN sqrt(({px} - {s}.ax) ** 2 + ({py} - {s}.ay) ** 2) ELSE "
            f"abs(({s}.bx - {s}.ax) * ({py} - {s}.ay) - ({s}.by_ - {s}.ay) * ({px} - {s}.ax)) / {s}.len END")


_COLLINEAR = ctes("segments").replace("WITH", "WITH RECURSIVE", 1) + f""",
 sg AS (SELECT page_id, seg_id, ax, ay, bx, "by" AS by_, least(ax, bx) AS x, least(ay, "by") AS y, greatest(ax, bx) AS r, greatest(ay, "by") AS b,
   sqrt((ax - bx) ** 2 + (ay - "by") ** 2) AS len, atan2("by" - ay, bx - ax) AS dir FROM segments),
 pr AS (SELECT p.page_id, p.seg_id AS u, q.seg_id AS v FROM sg p JOIN sg q ON p.page_id = q.page_id AND p.seg_id < q.seg_id
  AND (abs(p.dir - q.dir) < radians(10) OR abs(abs(p.dir - q.dir) - pi()) < radians(10))
  AND greatest(p.x - q.r, q.x - p.r, 0) <= greatest(p.len, q.len) * 0.05 AND greatest(p.y - q.b, q.y - p.b, 0) <= greatest(p.len, q.len) * 0.05
  AND ({_off('p', 'q.ax', 'q.ay')} + {_off('p', 'q.bx', 'q.by_')} + {_off('q', 'p.ax', 'p.ay')} + {_off('q', 'p.bx', 'p.by_')}) / 4 <= 6)"""


@query("j12_collinear_segments", sql=_COLLINEAR + " SELECT page_id, u, v FROM pr")
def j12_collinear_segments(spark, sf):
    return P.collinear_pairs(view(spark, sf, "segments"), 6.0)


@query("a22_segment_union", sql=_COLLINEAR + """,
 e2 AS (SELECT page_id, u, v FROM pr UNION ALL SELECT page_id, v, u FROM pr),
 rc AS (SELECT page_id, seg_id AS a, seg_id AS z FROM sg UNION SELECT rc.page_id, rc.a, e2.v FROM rc JOIN e2 ON e2.page_id = rc.page_id AND e2.u = rc.z),
 cp AS (SELECT page_id, a AS seg_id, min(z) AS c FROM rc GROUP BY page_id, a),
 e3 AS (SELECT sg.page_id, c AS seg_id, cp.seg_id AS part, abs(bx - ax) >= abs(by_ - ay) AS wide, unnest([{'x': ax, 'y': ay}, {'x': bx, 'y': by_}]) AS e FROM sg JOIN cp USING (page_id, seg_id)),
 g3 AS (SELECT page_id, seg_id, count(DISTINCT part) AS parts, count(*) FILTER (wide) * 2 >= count(*) AS wide, min({'a': e.x, 'b': e.y}) AS x0, max({'a': e.x, 'b': e.y}) AS x1,
  min({'a': e.y, 'b': e.x}) AS y0, max({'a': e.y, 'b': e.x}) AS y1 FROM e3 GROUP BY page_id, seg_id)
SELECT page_id, seg_id, parts, CASE WHEN wide THEN x0.a ELSE y0.b END AS ax, CASE WHEN wide THEN x0.b ELSE y0.a END AS ay, CASE WHEN wide THEN x1.a ELSE y1.b END AS bx, CASE WHEN wide THEN x1.b ELSE y1.a END AS "by" FROM g3""")
def a22_segment_union(spark, sf):
    return P.union_segments(view(spark, sf, "segments"), 6.0)


@query("w9_panel_order", sql=ctes("panels").replace("WITH", "WITH RECURSIVE", 1) + ", " + _NEAR.format(t="panels") + f""",
 ed AS (SELECT page_id, top AS u, panel_id AS v FROM nb WHERE top IS NOT NULL UNION
  SELECT p.page_id, q.panel_id, p.panel_id FROM panels p JOIN panels q ON p.page_id = q.page_id AND p.panel_id <> q.panel_id AND q.x >= p.r AND {_band('p', 'q', 'y', 'b')}),
 dp AS (SELECT page_id, panel_id, 0 AS d FROM panels UNION SELECT dp.page_id, ed.v, d + 1 FROM dp JOIN ed ON ed.page_id = dp.page_id AND ed.u = dp.panel_id),
 mx AS (SELECT page_id, panel_id, max(d) AS d FROM dp GROUP BY ALL)
SELECT page_id, panel_id, row_number() OVER (PARTITION BY page_id ORDER BY d, y, -x, panel_id) AS number FROM panels JOIN mx USING (page_id, panel_id)""")
def w9_panel_order(spark, sf):
    return P.reading_order(view(spark, sf, "panels")).select("page_id", "panel_id", "number")


@query("c7_panel_layout")
def c7_panel_layout(spark, sf):
    out = P.layout(view(spark, sf, "panels"), view(spark, sf, "segments"), PAGE_W, PAGE_H)
    return out.select("page_id", "panel_id", "x", "y", "r", "b", "number")
