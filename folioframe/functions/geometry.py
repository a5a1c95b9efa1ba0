"""Quad geometry as native Column expressions.

A quad is ``ARRAY<STRUCT<x: BIGINT, y: BIGINT>>`` with four corners.  All
expressions unroll the four corners, so they stay inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: smallest unit component that still counts as axis aligned.
AXIS_TOLERANCE = 0.05


def point(x, y) -> Column:
    return F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))


def box_quad(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corners of an upright box, clockwise from the top left."""
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def corner(pts: Column, i: int) -> tuple[Column, Column]:
    return pts.getItem(i).getField("x"), pts.getItem(i).getField("y")


def corners(pts: Column) -> list[tuple[Column, Column]]:
    return [corner(pts, i) for i in range(4)]


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def int_half(total: Column) -> Column:
    """Half of an integer, truncated toward zero."""
    return (total / F.lit(2)).cast("bigint")


# --- corner order -----------------------------------------------------------


def with_corner_order(df: DataFrame, pts: str = "pts") -> DataFrame:
    """Replace ``pts`` by its canonical corner order and add ``vertical``.

    The direction comes from the two mid-length pairwise vectors, the corners
    are then ordered top-left, top-right, bottom-right, bottom-left.
    """
    pairs = []
    for i in range(4):
        for j in range(4):
            dx, dy = f"({pts}[{i}].x - {pts}[{j}].x)", f"({pts}[{i}].y - {pts}[{j}].y)"
            pairs.append(f"struct({dx} * {dx} + {dy} * {dy} AS n, {4 * i + j} AS k, {dx} AS dx, {dy} AS dy)")
    ranked = f"sort_array(array({', '.join(pairs)}))"
    df = df.withColumn("_r", F.expr(f"slice({ranked}, 9, 3)"))
    sign = "IF(_r[0].dx * _r[2].dx + _r[0].dy * _r[2].dy < 0, -1, 1)"
    df = df.withColumn("vertical", F.expr(
        f"abs(_r[0].dx * {sign} + _r[2].dx) <= abs(_r[0].dy * {sign} + _r[2].dy)"))

    def ordered(first, second):
        return "sort_array(array(" + ", ".join(
            f"struct({pts}[{i}].{first} AS k, {i} AS i, {pts}[{i}].{second} AS o)" for i in range(4)) + "))"

    df = df.withColumn("_s", F.expr(f"IF(vertical, {ordered('y', 'x')}, {ordered('x', 'y')})"))
    tall = lambda c: f"struct(_s[{c}].o AS x, _s[{c}].k AS y)"
    wide = lambda c: f"struct(_s[{c}].k AS x, _s[{c}].o AS y)"
    pick = lambda test, a, b, f: f"IF({test}, {f(a)}, {f(b)})"
    # ties keep the earlier corner first, except where the order is descending
    first, low, right = "_s[0].o > _s[1].o", "_s[2].o < _s[3].o", "_s[2].o > _s[3].o"
    up = ", ".join([pick(first, 1, 0, tall), pick(first, 0, 1, tall), pick(low, 3, 2, tall), pick(low, 2, 3, tall)])
    flat = ", ".join([pick(first, 1, 0, wide), pick(right, 3, 2, wide), pick(right, 2, 3, wide), pick(first, 0, 1, wide)])
    return df.withColumn(pts, F.expr(f"IF(vertical, array({up}), array({flat}))")).drop("_r", "_s")


# --- measures ---------------------------------------------------------------


def bounds(pts: Column) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y)."""
    xs, ys = zip(*corners(pts))
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def centroid(pts: Column) -> tuple[Column, Column]:
    xs, ys = zip(*corners(pts))
    total = lambda v: (v[0] + v[1] + v[2] + v[3]) / F.lit(4.0)
    return total(xs), total(ys)


def midpoints(pts: Column) -> list[tuple[Column, Column]]:
    """Truncated midpoints of edges (0,1), (2,3), (1,2), (3,0)."""
    c = corners(pts)
    return [
        (int_half(c[i][0] + c[j][0]), int_half(c[i][1] + c[j][1]))
        for i, j in ((0, 1), (2, 3), (1, 2), (3, 0))
    ]


def axes(pts: Column) -> tuple[Column, Column, Column, Column]:
    """The vertical and horizontal midpoint vectors (v1x, v1y, v2x, v2y)."""
    m = midpoints(pts)
    return m[1][0] - m[0][0], m[1][1] - m[0][1], m[3][0] - m[2][0], m[3][1] - m[2][1]


def hull_area_sql(pts: str) -> str:
    """Area of the convex hull of the four corners.

    In convex position the hull is the largest of the three cyclic orderings;
    otherwise it is the largest of the four triangles.
    """
    def shoelace(order):
        return "abs(" + " + ".join(
            f"({pts}[{i}].x * {pts}[{j}].y - {pts}[{j}].x * {pts}[{i}].y)"
            for i, j in zip(order, order[1:] + order[:1])) + ")"

    rings = [[0, 1, 2, 3], [0, 2, 1, 3], [0, 1, 3, 2]]
    triangles = [[0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3]]
    return f"greatest({', '.join(shoelace(o) for o in rings + triangles)}) / 2.0D"


def hull_area(pts: str = "pts") -> Column:
    return F.expr(hull_area_sql(pts))


def upright_sql(pts: str) -> str:
    """True when the corners are exactly those of an upright box in order."""
    p = [f"{pts}[{i}]" for i in range(4)]
    return (f"({p[0]}.x = {p[3]}.x AND {p[1]}.x = {p[2]}.x AND {p[0]}.y = {p[1]}.y AND {p[2]}.y = {p[3]}.y"
            f" AND {p[0]}.x <= {p[1]}.x AND {p[0]}.y <= {p[2]}.y)")


def with_geometry(df: DataFrame, pts: str = "pts") -> DataFrame:
    """Add every derived measure the later operators read."""
    def over(f, k):
        return f"{f}({', '.join(f'{pts}[{i}].{k}' for i in range(4))})"

    def mid(i, j, k):
        return f"(({pts}[{i}].{k} + {pts}[{j}].{k}) div 2)"

    mean = lambda k: f"({' + '.join(f'{pts}[{i}].{k}' for i in range(4))}) / 4.0D"
    sql = lambda **cols: {n: F.expr(e) for n, e in cols.items()}
    df = df.withColumns(sql(
        bx=over("least", "x"), by=over("least", "y"), _ex=over("greatest", "x"), _ey=over("greatest", "y"),
        cx=mean("x"), cy=mean("y"), area=hull_area_sql(pts),
        _v1x=f"{mid(2, 3, 'x')} - {mid(0, 1, 'x')}", _v1y=f"{mid(2, 3, 'y')} - {mid(0, 1, 'y')}",
        _v2x=f"{mid(3, 0, 'x')} - {mid(1, 2, 'x')}", _v2y=f"{mid(3, 0, 'y')} - {mid(1, 2, 'y')}"))
    df = df.withColumns(sql(
        bw="_ex - bx", bh="_ey - by", _n1="sqrt(CAST(_v1x * _v1x + _v1y * _v1y AS DOUBLE))",
        _n2="sqrt(CAST(_v2x * _v2x + _v2y * _v2y AS DOUBLE))"))
    flat = " OR ".join(
        f"coalesce(abs(try_divide(CAST({v} AS DOUBLE), {n})) < {AXIS_TOLERANCE}D, false)" for n in ("_n1", "_n2") for v in ("_v1x", "_v1y"))
    return df.withColumns(sql(
        aspect="CASE WHEN _n1 = 0 AND _n2 = 0 THEN double('NaN') WHEN _n1 = 0 THEN double('Infinity') ELSE _n2 / _n1 END",
        font_size="least(_n1, _n2)",
        angle="pmod(acos(CASE WHEN _n1 = 0 THEN 1.0D ELSE _v1x / _n1 END) + pi(), pi())",
        aligned=flat)).drop("_ex", "_ey", "_v1x", "_v1y", "_v2x", "_v2y", "_n1", "_n2")


# --- rewrites of quads ------------------------------------------------------


def scale(pts: Column, factor: Column) -> Column:
    """Corners times ``factor``, truncated."""
    return F.array(*[point((x * factor), (y * factor)) for x, y in corners(pts)])


def rotate_back(pts: Column, page_height: Column) -> Column:
    """Undo a quarter turn: (x, y) -> (y, height - x)."""
    return F.array(*[point(y, page_height - x) for x, y in corners(pts)])


def rescale(pts: Column, net_w, net_h, dest_w, dest_h, ratio_w, ratio_h) -> Column:
    """Network coordinates to page pixels, clamped to the destination first."""
    def one(v, net, dest, ratio):
        placed = F.least(F.greatest(F.round(v / net * dest), F.lit(0.0)), dest.cast("double"))
        return (placed * ratio).cast("bigint")

    return F.array(*[
        point(one(x, net_w, dest_w, ratio_w), one(y, net_h, dest_h, ratio_h))
        for x, y in corners(pts)
    ])


def roll_to_origin(pts: Column) -> Column:
    """Rotate the corner list so the smallest x+y comes first."""
    sums = F.array(*[x + y for x, y in corners(pts)])
    start = F.array_position(sums, F.array_min(sums)).cast("int")
    return F.concat(
        F.slice(pts, start, F.lit(4)), F.slice(pts, F.lit(1), start - F.lit(1))
    )


def unclip_offset(w: Column, h: Column, ratio) -> Column:
    """How far a w x h box moves outward: area * ratio / perimeter."""
    return F.try_divide(w * h * F.lit(float(ratio)), (w + h) * F.lit(2.0))


def enlarge_window(x1, y1, x2, y2, im_w, im_h, ratio, aspect):
    """Grow a window to ``ratio`` times its area, kept inside the page.

    Solves a*d^2 + (w + h*a)*d + (1 - ratio)*w*h = 0 for the growth d.
    """
    w, h = x2 - x1, y2 - y1
    a = F.lit(float(aspect))
    b = w + h * a
    c = (F.lit(1.0) - F.lit(float(ratio))) * w * h
    root = (-b + F.sqrt(b * b - F.lit(4.0) * a * c)) / (a * F.lit(2.0))
    delta = F.round(root / F.lit(2.0))
    dx = F.least(x1, im_w - x2, F.round(delta * a).cast("bigint"))
    dy = F.least(y1, im_h - y2, delta.cast("bigint"))
    return x1 - dx, y1 - dy, x2 + dx, y2 + dy


def extend_rect(x, y, w, h, max_x, max_y, grow):
    """Grow a box by ``grow`` on every side, clipped to the page."""
    x1, y1 = F.greatest(x - grow, F.lit(0)), F.greatest(y - grow, F.lit(0))
    w1 = F.least(w + grow * 2, max_x - x1 - F.lit(1))
    h1 = F.least(h + grow * 2, max_y - y1 - F.lit(1))
    return x1, y1, w1, h1


def render_size(w: Column, h: Column, vertical: Column) -> tuple[Column, Column]:
    """Vertical boxes keep their size; horizontal ones become (long, short)."""
    return (
        F.when(vertical, w).otherwise(F.greatest(w, h, F.lit(1))),
        F.when(vertical, h).otherwise(F.greatest(F.least(w, h), F.lit(1))),
    )


def rotated_bounds(w: Column, h: Column, cx: Column, cy: Column, theta: Column):
    """Upright bounds of a w x h box turned by theta about its centre."""
    c, s = F.cos(theta), F.sin(theta)
    hw, hh = w / F.lit(2.0), h / F.lit(2.0)
    xs, ys = [], []
    for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        dx, dy = hw * sx, hh * sy
        xs.append(cx + dx * c - dy * s)
        ys.append(cy + dx * s + dy * c)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def final_font_size(fit: Column, detected: Column, offset, low, high) -> Column:
    """Clamp the fitted size to the detected one, then to the allowed range."""
    off = F.lit(float(offset))
    near = F.least(F.greatest(fit, F.greatest(detected - off, F.lit(1.0))), detected + off)
    chosen = F.when(detected > 0, near).otherwise(fit)
    return F.greatest(F.round(F.least(F.greatest(chosen, F.lit(float(low))), F.lit(float(high)))), F.lit(1.0))


# --- blocks (several lines of four corners) ---------------------------------


def round_away(v: Column) -> Column:
    """Round half away from zero, as a whole number."""
    return F.when(v < 0, -F.floor(-v + F.lit(0.5))).otherwise(F.floor(v + F.lit(0.5)))


def block_bounds(lines: Column):
    """Bounds over every corner of ``lines ARRAY<ARRAY<STRUCT>>``."""
    xs = F.transform(F.flatten(lines), lambda p: p["x"])
    ys = F.transform(F.flatten(lines), lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def rotate_lines(lines: Column, cx: Column, cy: Column, degrees: Column) -> Column:
    """Turn every corner by ``degrees`` about (cx, cy), rounded to pixels."""
    rad = degrees * F.lit(math.pi) / F.lit(180.0)
    c, s = F.cos(rad), F.sin(rad)

    def turn(p):
        dx, dy = p["x"] - cx, p["y"] - cy
        return point(round_away(dx * c - dy * s + cx), round_away(dx * s + dy * c + cy))

    turned = F.transform(lines, lambda line: F.transform(line, turn))
    return F.when(degrees == 0, lines).otherwise(turned)


def with_block_min_rect(df: DataFrame, lines: str = "lines", angle: str = "angle") -> DataFrame:
    """Add ``x0,y0,x1,y1``, the integer centre and the tilted ``min_rect``.

    The block is turned upright, bounded, and the box is turned back.
    """
    x0, y0, x1, y1 = block_bounds(F.col(lines))
    df = df.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1})
    df = df.withColumns({"mid_x": int_half(F.col("x0") + F.col("x1")),
                         "mid_y": int_half(F.col("y0") + F.col("y1"))})
    cx, cy = F.col("mid_x"), F.col("mid_y")
    df = df.withColumn("_up", rotate_lines(F.col(lines), cx, cy, -F.col(angle)))
    a, b, c, d = block_bounds(F.col("_up"))
    df = df.withColumns({"_a": a, "_b": b, "_c": c, "_d": d})
    a, b, c, d = (F.col(n) for n in ("_a", "_b", "_c", "_d"))
    upright = F.array(F.array(point(a, b), point(c, b), point(c, d), point(a, d)))
    back = rotate_lines(upright, cx, cy, F.col(angle)).getItem(0)
    clipped = F.transform(
        back, lambda p: point(F.greatest(p["x"], F.lit(0)), F.greatest(p["y"], F.lit(0)))
    )
    return df.withColumn("min_rect", clipped).drop("_up", "_a", "_b", "_c", "_d")


def obb_top_left(cx, cy, w, h, theta) -> tuple[Column, Column]:
    c, s = F.cos(theta), F.sin(theta)
    dx, dy = -w / F.lit(2.0), -h / F.lit(2.0)
    return cx + dx * c - dy * s, cy + dx * s + dy * c


# --- distance between quads -------------------------------------------------

_SIDES = ((0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3))


def segments_sql(pts: str) -> str:
    """The sides and diagonals of a quad."""
    return "array(" + ", ".join(
        f"struct({pts}[{i}].x AS ax, {pts}[{i}].y AS ay, {pts}[{j}].x AS bx, {pts}[{j}].y AS by)" for i, j in _SIDES) + ")"


def point_segment_sql(p: str, s: str) -> str:
    """Squared distance from a point to a segment."""
    dx, dy, px, py = f"({s}.bx - {s}.ax)", f"({s}.by - {s}.ay)", f"({p}.x - {s}.ax)", f"({p}.y - {s}.ay)"
    t = (f"least(greatest(coalesce(try_divide(CAST({px} * {dx} + {py} * {dy} AS DOUBLE), {dx} * {dx} + {dy} * {dy}), 0.0D), 0.0D), 1.0D)")
    return (f"transform(array({t}), t -> ({px} - t * {dx}) * ({px} - t * {dx}) + ({py} - t * {dy}) * ({py} - t * {dy}))[0]")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def quad_distance_sql(a: str, b: str) -> str:
    """Distance between the hulls of two quads, 0 when they touch or overlap.

    Upright boxes have a closed form.  Otherwise the quads are apart when some
    side, diagonal or their normals separate them (exact in integers), and the
    distance is the smallest from a corner of one to a segment of the other.
    """
    gap = lambda k: f"greatest({b}[0].{k} - {a}[2].{k}, {a}[0].{k} - {b}[2].{k}, 0)"
    boxes = f"sqrt(CAST({gap('x')} * {gap('x')} + {gap('y')} * {gap('y')} AS DOUBLE))"
    span = lambda q, u, v: f"transform({q}, p -> p.x * {u} + p.y * {v})"

    def apart(u, v):
        return (f"exists(array(struct({span('q.a', u, v)} AS m, {span('q.b', u, v)} AS n)), "
                "z -> array_min(z.m) > array_max(z.n) OR array_min(z.n) > array_max(z.m))")

    dx, dy = "(s.bx - s.ax)", "(s.by - s.ay)"
    join = f"array(struct({a}[0].x AS ax, {a}[0].y AS ay, {b}[0].x AS bx, {b}[0].y AS by))"
    split = f"exists(concat(q.sa, q.sb, q.sj), s -> {apart(dx, dy)} OR {apart(f'(-{dy})', dx)})"
    near = lambda pts, segs: f"array_min(transform({pts}, p -> array_min(transform({segs}, s -> {point_segment_sql('p', 's')}))))"
    general = (
        f"transform(array(struct({a} AS a, {b} AS b, {segments_sql(a)} AS sa, {segments_sql(b)} AS sb, {join} AS sj)), "
        f"q -> CASE WHEN {split} THEN sqrt(least({near('q.a', 'q.sb')}, {near('q.b', 'q.sa')})) ELSE 0.0D END)[0]")
    return f"CASE WHEN {upright_sql(a)} AND {upright_sql(b)} THEN {boxes} ELSE {general} END"


def quad_distance(a: str, b: str) -> Column:
    """Hull distance of two quad columns, by name."""
    return F.expr(quad_distance_sql(a, b))


def line_start_distance(a: Column, b: Column) -> Column:
    """Distance between the first corners, the weight of the region tree."""
    (ax, ay), (bx, by) = corner(a, 0), corner(b, 0)
    return hypot(ax - bx, ay - by)
