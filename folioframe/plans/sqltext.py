"""Shared SQL fragments of the twins (the second, independent formulation)."""

from folioframe.plans.views import ctes

_C = [(f"x{i}", f"y{i}") for i in range(4)]


def geo_cte(source: str, name: str = "geo") -> str:
    """Quad measures over corner columns ``x0..y3`` of ``source``."""
    lst = lambda f, k: f"{f}({', '.join(c[k] for c in _C)})"
    mid = lambda i, j, k: f"({k}{i} + {k}{j}) // 2"
    tri = lambda a, b, c: (
        f"abs((x{b} - x{a}) * (y{c} - y{a}) - (x{c} - x{a}) * (y{b} - y{a}))")
    ring = lambda a, b, c, d: (
        f"abs((x{c} - x{a}) * (y{d} - y{b}) - (x{d} - x{b}) * (y{c} - y{a}))")
    area = ", ".join([ring(0, 1, 2, 3), ring(0, 2, 1, 3), ring(0, 1, 3, 2),
                      tri(0, 1, 2), tri(0, 1, 3), tri(0, 2, 3), tri(1, 2, 3)])
    return f"""
{name}_m AS (SELECT *, {lst('least', 0)} AS bx, {lst('least', 1)} AS by_, {lst('greatest', 0)} AS ex, {lst('greatest', 1)} AS ey,
  (x0 + x1 + x2 + x3) / 4.0::DOUBLE AS cx, (y0 + y1 + y2 + y3) / 4.0::DOUBLE AS cy,
  {mid(2, 3, 'x')} - {mid(0, 1, 'x')} AS v1x, {mid(2, 3, 'y')} - {mid(0, 1, 'y')} AS v1y,
  {mid(3, 0, 'x')} - {mid(1, 2, 'x')} AS v2x, {mid(3, 0, 'y')} - {mid(1, 2, 'y')} AS v2y,
  greatest({area}) / 2.0::DOUBLE AS area FROM {source}),
{name}_n AS (SELECT *, ex - bx AS bw, ey - by_ AS bh, sqrt(v1x * v1x + v1y * v1y) AS n1, sqrt(v2x * v2x + v2y * v2y) AS n2 FROM {name}_m),
{name} AS (SELECT *, n2 / n1 AS aspect, least(n1, n2) AS fs,
  (acos(CASE WHEN n1 = 0 THEN 1 ELSE v1x / n1 END) + pi()) % pi() AS angle,
  abs(v1x / n1) < 0.05 OR abs(v1y / n1) < 0.05 OR abs(v1x / n2) < 0.05 OR abs(v1y / n2) < 0.05 AS aligned,
  abs(x1 - x0) + abs(x2 - x3) > abs(y1 - y0) + abs(y2 - y3) AS wide FROM {name}_n)"""


SLANTED_GEO = ctes("slanted") + "," + geo_cte("slanted")

#: upright lines with corner columns
BOX_LINES = (
    ctes("textlines")
    + """, boxes AS (SELECT page_id, quad_id, text, lang, score, prob, x AS x0, y AS y0, x + w AS x1, y AS y1,
 x + w AS x2, y + h AS y2, x AS x3, y + h AS y3, h >= w AS vertical FROM textlines),"""
    + geo_cte("boxes", "bgeo")
)


def quad_distance(a: str, b: str) -> str:
    """Hull distance of two convex quads given as corner columns of a and b."""
    def seg(p, s, i, j, k):
        px, py = f"({p}.x{k} - {s}.x{i})", f"({p}.y{k} - {s}.y{i})"
        dx, dy = f"({s}.x{j} - {s}.x{i})", f"({s}.y{j} - {s}.y{i})"
        t = f"least(1.0, greatest(0.0, ({px} * {dx} + {py} * {dy})::DOUBLE / nullif({dx} * {dx} + {dy} * {dy}, 0)))"
        return (f"sqrt(({px} - {t} * {dx}) * ({px} - {t} * {dx}) + ({py} - {t} * {dy}) * ({py} - {t} * {dy}))")

    sides = ((0, 1), (1, 2), (2, 3), (3, 0))
    terms = [seg(p, s, i, j, k) for p, s in ((a, b), (b, a)) for i, j in sides for k in range(4)]

    def cross(p, i, j, q, k):
        return (f"(({p}.x{j} - {p}.x{i}) * ({q}.y{k} - {p}.y{i}) - ({p}.y{j} - {p}.y{i}) * ({q}.x{k} - {p}.x{i}))")

    # convex quads are apart when all corners of one lie strictly outside a side of the other
    apart = " OR ".join(
        "(" + " AND ".join(f"{cross(p, i, j, q, k)} < 0" for k in range(4)) + ")"
        for p, q in ((a, b), (b, a)) for i, j in sides
    )
    return f"CASE WHEN {apart} THEN least({', '.join(terms)}) ELSE 0.0 END"


def can_merge(a: str, b: str, p: tuple) -> str:
    """The mergeable-pair rule over two rows of a ``geo_cte`` that also hold ``dist``."""
    ratio, discard, gap1, gap2, fs_tol, ar_tol = p
    cs = f"least({a}.fs, {b}.fs)"
    wide = lambda q: f"{q}.bw > {q}.bh * {ratio}"
    tall = lambda q: f"{q}.bh > {q}.bw * {ratio}"
    return f"""(CASE
 WHEN dist > {discard} * {cs} THEN false
 WHEN greatest({a}.fs, {b}.fs) / {cs} > {fs_tol} THEN false
 WHEN {a}.aspect > {ar_tol} AND {b}.aspect < 1.0 / {ar_tol} THEN false
 WHEN {b}.aspect > {ar_tol} AND {a}.aspect < 1.0 / {ar_tol} THEN false
 WHEN {a}.aligned AND {b}.aligned THEN
  CASE WHEN NOT dist < {cs} * {gap1} THEN false
   WHEN abs(({a}.bx + {a}.bw // 2) - ({b}.bx + {b}.bw // 2)) < {gap2} THEN true
   WHEN {wide(a)} AND {tall(b)} THEN false
   WHEN {wide(b)} AND {tall(a)} THEN false
   WHEN {wide(a)} OR {wide(b)} THEN abs({a}.bx - {b}.bx) < {cs} * {gap2} OR abs({a}.bx + {a}.bw - {b}.bx - {b}.bw) < {cs} * {gap2}
   WHEN {tall(a)} OR {tall(b)} THEN abs({a}.by_ - {b}.by_) < {cs} * {gap2} OR abs({a}.by_ + {a}.bh - {b}.by_ - {b}.bh) < {cs} * {gap2}
   ELSE false END
 WHEN abs({a}.angle - {b}.angle) < 15.0 * pi() / 180.0 THEN NOT (dist > {cs} * {gap2}) AND NOT (abs({a}.fs - {b}.fs) / {cs} > 0.25)
 ELSE false END)"""


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def repair_ctes(source: str, key: str, text: str, keep_quotes: bool = False) -> str:
    """``repaired(key, fixed)``: bracket repair as recursion over the brackets.

    Needs ``WITH RECURSIVE``.
    """
    from folioframe.functions.text import BRACKETS, bracket_class

    cls = sql_str(bracket_class(keep_quotes))
    openers = "[" + ", ".join(sql_str(p[0]) for p in BRACKETS) + "]"
    closers = "[" + ", ".join(sql_str(p[1]) for p in BRACKETS) + "]"
    return f"""
br_m AS (SELECT {key} AS rk, unnest(regexp_extract_all({text}, {cls})) AS c, generate_subscripts(regexp_extract_all({text}, {cls}), 1) AS k FROM {source}),
br_w AS (SELECT rk, 0::BIGINT AS k, []::BIGINT[] AS sk, []::VARCHAR[] AS sc, NULL::BIGINT AS jk, NULL::VARCHAR AS jc FROM (SELECT DISTINCT rk FROM br_m)
 UNION ALL SELECT w.rk, m.k,
  CASE WHEN list_contains({openers}, m.c) THEN list_append(w.sk, m.k) ELSE w.sk[:-2] END,
  CASE WHEN list_contains({openers}, m.c) THEN list_append(w.sc, m.c) ELSE w.sc[:-2] END,
  CASE WHEN list_contains({openers}, m.c) THEN NULL ELSE w.sk[-1] END,
  CASE WHEN list_contains({openers}, m.c) THEN NULL ELSE w.sc[-1] END
 FROM br_w w JOIN br_m m ON m.rk = w.rk AND m.k = w.k + 1),
br_f AS (SELECT rk, k, {closers}[list_position({openers}, jc)] AS c FROM br_w WHERE jk IS NOT NULL
 UNION ALL SELECT rk, jk, jc FROM br_w WHERE jk IS NOT NULL),
br_p AS (SELECT {key} AS rk, unnest(string_split_regex({text}, {cls})) AS piece, generate_subscripts(string_split_regex({text}, {cls}), 1) AS k FROM {source}),
repaired AS (SELECT p.rk, string_agg(p.piece || coalesce(f.c, ''), '' ORDER BY p.k) AS fixed FROM br_p p LEFT JOIN br_f f USING (rk, k) GROUP BY p.rk)"""


def region_ctes(rule: tuple, prob: float) -> str:
    """Lines of at most three per component to regions, by explicit cases.

    Ends in ``lab(page_id, quad_id, region)``.  Needs ``WITH RECURSIVE``.
    """
    return f"""
ln AS (SELECT * FROM bgeo WHERE prob >= {prob}),
pr AS (SELECT a.page_id, a.quad_id AS u, b.quad_id AS v FROM (SELECT a, b,
    sqrt(greatest(b.bx - a.ex, a.bx - b.ex, 0) ** 2 + greatest(b.by_ - a.ey, a.by_ - b.ey, 0) ** 2) AS dist
    FROM ln a JOIN ln b ON a.page_id = b.page_id AND a.quad_id < b.quad_id) WHERE {can_merge('a', 'b', rule)}),
both_ AS (SELECT u, v FROM pr UNION ALL SELECT v, u FROM pr),
reach AS (SELECT quad_id AS a, quad_id AS b FROM ln UNION SELECT r.a, e.v FROM reach r JOIN both_ e ON r.b = e.u),
cmp AS (SELECT a AS quad_id, min(b) AS component, count(*) AS n FROM reach GROUP BY a),
mem AS (SELECT ln.*, component, n FROM ln JOIN cmp USING (quad_id)),
ed AS (SELECT a.component, a.n, a.quad_id AS u, b.quad_id AS v, sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2) AS w,
    greatest(a.fs, b.fs) AS fmax, abs(a.angle - b.angle) AS turn,
    greatest(abs(a.cx - b.cx), abs(a.cy - b.cy)) AS shift,
    greatest(b.bx - a.ex, a.bx - b.ex, 0) = 0 AND greatest(b.by_ - a.ey, a.by_ - b.ey, 0) = 0 AS touch
  FROM mem a JOIN mem b ON a.component = b.component AND a.quad_id < b.quad_id),
tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY w, u, v) AS rk FROM ed) WHERE rk < n),
fo AS (SELECT component, avg(fs) AS font FROM mem GROUP BY component),
st AS (SELECT component, any_value(n) AS n, avg(w) AS mean, stddev_pop(w) AS spread FROM tr GROUP BY component),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY w DESC, u, v) AS o FROM tr)),
kp AS (SELECT st.component, st.n, CASE WHEN st.n = 2 THEN t.w < 1.5 * t.fmax AND t.turn < 0.2 * pi()
   ELSE (t.w <= mean + 2 * spread OR t.w <= 1.5 * font) AND (spread < greatest(0.3 * font + 5, 5) OR (t.touch AND t.shift < 5)) END AS keep,
   z.u AS ru, z.v AS rv, z.w < 1.5 * z.fmax AND z.turn < 0.2 * pi() AS pair_keep
  FROM st JOIN fo USING (component) JOIN tp t ON t.component = st.component AND t.o = 1
  LEFT JOIN tp z ON z.component = st.component AND z.o = 2),
lab AS (SELECT m.page_id, m.quad_id, CASE WHEN m.n = 1 THEN m.quad_id WHEN k.keep THEN m.component
   WHEN m.n = 3 AND k.pair_keep AND m.quad_id IN (k.ru, k.rv) THEN least(k.ru, k.rv) ELSE m.quad_id END AS region
  FROM mem m LEFT JOIN kp k USING (component))"""


MERGE = (1.9, 2.0, 1.0, 3.0, 2.0, 1.3)
DIRECTION = (1.9, 2.0, 0.6, 1.5, 1.5, 1.0)
BOX_LINES_R = BOX_LINES.replace("WITH ", "WITH RECURSIVE ", 1)

#: regions with their aggregates, ``blk`` ends with the joined, untrimmed text
BLOCKS_SQL = (
    BOX_LINES_R + "," + region_ctes(MERGE, 0.2) + """,
rl AS (SELECT ln.*, lab.region FROM ln JOIN lab USING (quad_id)),
rd AS (SELECT region, CASE WHEN count(*) FILTER (vertical) * 2 = count(*) THEN arg_max(vertical, (greatest(aspect, 1 / aspect), -quad_id))
   ELSE count(*) FILTER (vertical) * 2 > count(*) END AS vert FROM rl GROUP BY region),
pa AS (SELECT page_id, sum(area) AS pa FROM ln GROUP BY page_id),
blk AS (SELECT page_id, region, vert, count(*) AS n_lines, CAST(min(CAST(floor(fs) AS BIGINT)) AS BIGINT) AS font_size,
   CASE WHEN abs(degrees(avg(angle)) - 90) < 3 THEN 0 ELSE degrees(avg(angle)) - 90 END AS angle,
   exp(sum(ln(score) * area) / any_value(pa)) AS prob,
   CAST(floor(avg(CASE WHEN quad_id % 3 <> 0 THEN (quad_id * 7) % 256 END)) AS BIGINT) AS fg_r, CAST(floor(avg(CASE WHEN quad_id % 6 <> 0 THEN (quad_id * 23) % 256 END)) AS BIGINT) AS bg_b,
   replace(regexp_replace(regexp_replace(string_agg(text, chr(1) ORDER BY CASE WHEN vert THEN -cx ELSE cy END, quad_id),
     '([　-鿿])' || chr(1) || '+', '\\1', 'g'), chr(1) || '([　-鿿])', '\\1', 'g'), chr(1), ' ') AS text
  FROM rl JOIN rd USING (region) JOIN pa USING (page_id) GROUP BY page_id, region, vert)"""
)
