"""Iterative operators against direct computation on small random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.operators import lines as LN
from folioframe.operators import mask as M
from folioframe.operators import panels as P
from folioframe.operators import placement
from folioframe.operators import regions
from folioframe.operators.graph import connected_components, spanning_forest
from folioframe.operators.ranking import ranked
from folioframe.sources import pages as PG


def test_components_of_long_paths_and_stars(spark):
    edges = [(1, i, i + 1) for i in range(0, 60)] + [(1, 100, 100 + i) for i in range(1, 60)] + [(2, 5, 3), (2, 3, 9)]
    nodes = sorted({(p, n) for p, u, v in edges for n in (u, v)} | {(2, 50)})
    out = connected_components(spark.createDataFrame(nodes, "page_id long, quad_id long"), spark.createDataFrame(edges, "page_id long, u long, v long"))
    got = {(r.page_id, r.quad_id): r.component for r in out.collect()}
    assert all(got[1, i] == 0 for i in range(61)) and all(got[1, 100 + i] == 100 for i in range(60))
    assert got[2, 9] == got[2, 5] == 3 and got[2, 50] == 50


def test_spanning_forest(spark):
    rng = random.Random(3)
    pts = [(1, c, c * 100 + i, rng.randrange(0, 3000), rng.randrange(0, 40)) for c in range(2) for i in range(20)]
    pts += [(1, 0, 900 + i, pts[0][3], pts[0][4]) for i in range(4)]
    got = {(r.u, r.v) for r in spanning_forest(spark.createDataFrame(pts, "page_id long, component long, id long, x long, y long"), 100.0).collect()}
    want = set()
    for c in range(2):
        mine = [p for p in pts if p[1] == c]
        pairs = sorted((((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2), *sorted((a[2], b[2]))) for i, a in enumerate(mine) for b in mine[i + 1:])
        root = {p[2]: p[2] for p in mine}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for _, u, v in pairs:
            if find(u) != find(v):
                root[find(u)] = find(v)
                want.add((u, v))
    assert got == want


def test_spanning_tree_of_a_crowded_cell(spark):
    """2,000 points of one component in 150 pixels, and a few far from them."""
    rng = random.Random(6)
    spots = sorted({(rng.randrange(150), rng.randrange(150)) for _ in range(2_000)}) + [(900, 40), (905, 45), (40, 3000)]
    pts = [(1, 0, i, x, y) for i, (x, y) in enumerate(spots)]
    got = spanning_forest(spark.createDataFrame(pts, "page_id long, component long, id long, x long, y long"), 64.0).collect()
    import numpy as np

    # Prim's tree has the same weights, whatever the ties
    xy = np.array(spots, dtype="float64")
    best = np.full(len(xy), np.inf)
    done = np.zeros(len(xy), dtype=bool)
    at, total = 0, 0.0
    for _ in range(len(xy) - 1):
        done[at] = True
        best = np.minimum(best, ((xy - xy[at]) ** 2).sum(axis=1))
        at = int(np.where(done, np.inf, best).argmin())
        total += best[at] ** 0.5
    assert len(got) == len(spots) - 1 and sum(r.w for r in got) == pytest.approx(total)
    assert len({n for r in got for n in (r.u, r.v)}) == len(spots)


def test_large_regions_split_like_small_ones(spark):
    rng = random.Random(5)
    rows = []
    for page in range(2):
        x, y = 100, 100
        for i in range(24):
            x, y = x + rng.choice([0, 0, 3, 40, 90]), y + rng.choice([18, 22, 30, 45])
            w, h = rng.choice([60, 90, 200]), rng.choice([18, 20, 26])
            rows.append((page, page * 100 + i, [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + h}, {"x": x, "y": y + h}]))
    df = G.with_geometry(G.with_corner_order(spark.createDataFrame(rows, "page_id long, quad_id long, pts array<struct<x:bigint,y:bigint>>")))
    label = lambda limit: {(r.quad_id): r.region for r in regions.regions(df, limit=limit).collect()}
    small = label(512)
    assert label(6) == small and len(set(small.values())) > 4


def test_ranked(spark):
    rows = [("hot", (i * 37) % 500) for i in range(500)] + [("b", i) for i in range(5)]
    out = ranked(spark.createDataFrame(rows, "k string, v long"), ["k"], ["v"], "n")
    assert all(r.n == r.v + 1 for r in out.collect()) and out.count() == 505


def test_unique_names(spark):
    paths = ["a/x.png", "b/x.png", "c/x.png", "d/x.png", "a/x_2.png", "a/y", "b/y", "z/.h"]
    have = ["x.png", "x_3.png", "q.png"]
    out = PG.unique_names(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(n,) for n in have], "name string"))
    got = {r.path: r.target for r in out.collect()}
    assert got["a/x.png"] == "x_1.png" and got["b/x.png"] == "x_4.png" and got["c/x.png"] == "x_5.png"
    assert got["a/x_2.png"] == "x_2.png" and got["a/y"] == "y" and got["b/y"] == "y_1"
    assert len(set(got.values()) | set(have)) == len(got) + len(have)


# --- panels -----------------------------------------------------------------


def _meets(p, q):
    return not (p[0] > q[2] or q[0] > p[2] or p[1] > q[3] or q[1] > p[3])


def _shared(p, q):
    return (min(p[2], q[2]) - max(p[0], q[0])) * (min(p[3], q[3]) - max(p[1], q[1]))


def _area(p):
    return (p[2] - p[0]) * (p[3] - p[1])


def _strong(p, q):
    low = min(_area(p), _area(q))
    return _meets(p, q) and (low == 0 or _shared(p, q) > 0.1 * low)


def _like(p, q):
    w, h = (p[2] - p[0]) / 10, (p[3] - p[1]) / 10
    return abs(p[0] - q[0]) < w and abs(p[1] - q[1]) < h and abs(p[2] - q[2]) < w and abs(p[3] - q[3]) < h


def _near_sides(boxes):
    """Neighbours by trying all; boxes are (id, x, y, r, b)."""
    def band(a0, a1, b0, b1):
        if a0 >= b0:
            a0, a1, b0, b1 = b0, b1, a0, a1
        if b0 > a1:
            return False
        short = min(a1 - a0, b1 - b0)
        return b1 < a1 or short == 0 or (min(a1, b1) - b0) / short >= 1 / 3

    out = {}
    for i, x, y, r, b in boxes:
        col = [q for q in boxes if q[0] != i and band(x, r, q[1], q[3])]
        row = [q for q in boxes if q[0] != i and band(y, b, q[2], q[4])]
        top = max(((q[4], q[0]) for q in col if q[4] < y), default=(0, None))[1]
        left = max(((q[3], q[0]) for q in row if q[3] <= x), default=(0, None))[1]
        right = min(((q[1], q[0]) for q in row if q[1] >= r), default=(0, None))[1]
        bottom = min(((q[2], q[0]) for q in col if q[2] >= b), default=(0, None))[1]
        out[i] = (top, left, right, bottom)
    return out


def test_folds_of_a_page_of_many_panels(spark):
    """20,000 panels in pairs, one inside the other; the pairs are far from each other."""
    rows = spark.range(10_000).selectExpr("id * 2 AS k", "id % 100 * 200 AS x", "id div 100 * 200 AS y")
    boxes = rows.selectExpr("1L AS page_id", "explode(array(named_struct('panel_id', k, 'x', x, 'y', y, 'r', x + 100, 'b', y + 100), named_struct('panel_id', k + 1, 'x', x + 10, 'y', y + 10, 'r', x + 120, 'b', y + 90))) AS p")
    boxes = boxes.selectExpr("page_id", "p.*")
    got = P.merge_contained(boxes)
    assert got.count() == 10_000 and got.where("panel_id % 2 = 1 OR r - x <> 120 OR b - y <> 100").count() == 0
    assert P.deoverlap(boxes).count() == 20_000


def _panel_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, panel_id long, x long, y long, r long, b long")


def _found_sides(df):
    pick = [F.col(f"{s}.panel_id").alias(s) for s in ("top", "left", "right", "bottom")]
    return {(r.page_id, r.panel_id): (r.top, r.left, r.right, r.bottom) for r in P.neighbours(df).select("page_id", "panel_id", *pick).collect()}


def test_neighbours_equal_all_pairs(spark):
    rng = random.Random(12)
    pages = {}
    for page in range(12):
        size = rng.choice([60, 500, 5000])
        boxes = []
        for i in range(rng.randint(1, 40)):
            x, y = rng.randint(-20, size), rng.randint(-20, size)
            boxes.append((i, x, y, x + rng.randint(0, size // 3), y + rng.randint(0, size // 4)))
        pages[page] = boxes
    got = _found_sides(_panel_frame(spark, [(p, *b) for p, boxes in pages.items() for b in boxes]))
    assert got == {(p, i): near for p, boxes in pages.items() for i, near in _near_sides(boxes).items()}
    assert P.neighbours(_panel_frame(spark, [])).count() == 0


def test_neighbours_of_a_full_page(spark):
    """50,000 panels on one page, in a grid with known neighbours."""
    n = 224
    boxes = spark.range(n * n).selectExpr("1L AS page_id", "id AS panel_id", f"id % {n} * 40 AS x", f"id div {n} * 30 AS y",
                                          f"id % {n} * 40 + 30 AS r", f"id div {n} * 30 + 25 AS b")
    near = P.neighbours(boxes)
    wrong = near.where(f"""NOT (top.panel_id <=> IF(panel_id < {n}, NULL, panel_id - {n}) AND bottom.panel_id <=> IF(panel_id >= {n * n - n}, NULL, panel_id + {n})
      AND left.panel_id <=> IF(panel_id % {n} = 0, NULL, panel_id - 1) AND right.panel_id <=> IF(panel_id % {n} = {n - 1}, NULL, panel_id + 1))""")
    assert near.count() == n * n and wrong.count() == 0


def _boxes(rng, n, size=400):
    out = []
    for _ in range(n):
        x, y = rng.randrange(0, size), rng.randrange(0, size)
        out.append((x, y, x + rng.randrange(20, 200), y + rng.randrange(20, 200)))
    return out


SCHEMA = "page_id long, panel_id long, x long, y long, r long, b long"


def _frame(spark, pages):
    return spark.createDataFrame([(p, i, *box) for p, boxes in enumerate(pages) for i, box in enumerate(boxes)], SCHEMA)


def test_group_big_panels(spark):
    rng = random.Random(11)
    pages = [[(20 + 110 * i, 20 + 110 * j, 120 + 110 * i, 120 + 110 * j) for i in range(2) for j in range(2) if rng.random() < 0.8] for _ in range(6)]
    pages += [_boxes(rng, 4, 900) for _ in range(6)]
    segs = [(2, 1, 30, 60, 200, 60)]
    segments = spark.createDataFrame(segs, "page_id long, seg_id long, ax long, ay long, bx long, by long")
    rows = P.group_big(_frame(spark, [p or [(0, 0, 9, 9)] for p in pages]), segments).collect()
    got = {}
    for r in rows:
        got.setdefault(r.page_id, set()).add((r.x, r.y, r.r, r.b))
    for page, boxes in enumerate(pages):
        state = list(boxes or [(0, 0, 9, 9)])
        moved = True
        while moved:
            moved = False
            for i in range(len(state)):
                for j in range(i + 1, len(state)):
                    a, b = state[i], state[j]
                    u = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                    if any(_strong(u, o) and not _like(o, u) for o in state if not _like(o, a) and not _like(o, b)):
                        continue
                    diagonal = ((u[2] - u[0]) ** 2 + (u[3] - u[1]) ** 2) ** 0.5
                    if any(p == page and _strong(u, (min(ax, bx), min(ay, by), max(ax, bx), max(ay, by)))
                           and ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5 > diagonal / 5 for p, _, ax, ay, bx, by in segs):
                        continue
                    state = [s for k, s in enumerate(state) if k not in (i, j)] + [u]
                    moved = True
                    break
                if moved:
                    break
        assert got[page] == set(state), page


def test_merge_contained(spark):
    pages = [[(0, 0, 100, 100), (60, 10, 130, 60)], [(0, 0, 100, 100), (60, 10, 130, 60), (115, 0, 200, 90)],
             [(0, 0, 50, 50), (300, 0, 350, 50)], [(10, 10, 20, 20), (0, 0, 100, 100), (75, 75, 110, 110)]]
    got = {}
    for r in P.merge_contained(_frame(spark, pages)).collect():
        got.setdefault(r.page_id, set()).add((r.x, r.y, r.r, r.b))
    assert got[0] == {(0, 0, 130, 100)}
    assert got[1] == {(0, 0, 100, 100), (115, 0, 200, 90)}
    assert got[2] == set(pages[2])
    assert got[3] == {(0, 0, 100, 100)}  # the removed first panel still blocks


def _pages_after(spark, fold, pages):
    got = {}
    for r in fold(_frame(spark, pages)).collect():
        got.setdefault(r.page_id, {})[r.panel_id] = (r.x, r.y, r.r, r.b)
    return [got.get(p, {}) for p in range(len(pages))]


def test_merge_is_one_pass_over_the_pairs(spark):
    """Against the rule read literally: pair by pair, removed panels block and merge until the end."""
    rng = random.Random(2)
    pages = [_boxes(rng, 6, 250) for _ in range(200)]
    for boxes, got in zip(pages, _pages_after(spark, P.merge_contained, pages)):
        state, removed = list(boxes), set()
        for i, j in [(i, j) for i in range(6) for j in range(i + 1, 6)]:
            holds = lambda a, b: _meets(state[a], state[b]) and _shared(state[a], state[b]) > 0.5 * _area(state[b])
            a, b = (i, j) if holds(i, j) else (j, i)
            if not holds(a, b):
                continue
            p, q = state[a], state[b]
            rest = [o for o in state if not _like(o, p) and not _like(o, q)]
            forms = []
            for bits in range(16):  # left is the lowest bit, then right, top, bottom
                use = [bool(bits & 1), bool(bits & 4), bool(bits & 2), bool(bits & 8)]
                if all(not u or (q[k] < p[k] if k < 2 else q[k] > p[k]) for k, u in enumerate(use)):
                    forms.append(tuple(q[k] if u else p[k] for k, u in enumerate(use)))
            free = [f for f in forms if not any(_strong(f, o) and not _like(o, f) for o in rest)]
            top = max((_area(f) for f in free), default=None)
            state[a] = p if top is None else [f for f in free if _area(f) == top][-1]
            removed.add(b)
        assert got == {k: b for k, b in enumerate(state) if k not in removed}


def test_trims_follow_the_order_of_pairs(spark):
    rng = random.Random(5)
    pages = [_boxes(rng, 5) for _ in range(200)]
    for boxes, got in zip(pages, _pages_after(spark, P.deoverlap, pages)):
        state = [list(b) for b in boxes]
        for p in state:
            for q in state:
                if p is q or _like(p, q) or not _meets(p, q):
                    continue
                x, y, r, b = max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3])
                if r - x < b - y and p[2] == r:
                    p[2], q[0] = x, r
                elif r - x > b - y and p[3] == b:
                    p[3], q[1] = y, b
        assert [got[k] for k in range(5)] == [tuple(s) for s in state]
        assert all(x <= r and y <= b for x, y, r, b in got.values())


def test_deoverlap(spark):
    out = P.deoverlap(_frame(spark, [[(0, 0, 120, 100), (100, 0, 300, 100)], [(0, 0, 100, 120), (0, 100, 100, 300)]])).collect()
    got = {(r.page_id, r.panel_id): (r.x, r.y, r.r, r.b) for r in out}
    assert got[0, 0] == (0, 0, 100, 100) and got[0, 1] == (120, 0, 300, 100)
    assert got[1, 0] == (0, 0, 100, 100) and got[1, 1] == (0, 120, 100, 300)


def test_expand(spark):
    out = P.expand(_frame(spark, [[(10, 10, 100, 100), (130, 12, 200, 90), (15, 120, 190, 200)]])).collect()
    got = {r.panel_id: (r.x, r.y, r.r, r.b) for r in out}
    assert got[0][0] == 10 and got[0][1] == 10 and got[1][2] == 200 and got[2][0] == 10 and got[2][2] == 200
    assert got[0][2] <= got[1][0] and got[0][3] <= got[2][1] and got[1][3] <= got[2][1]


def test_layout_numbers_every_panel(spark):
    pages = [[(20, 20, 500, 400), (520, 20, 1000, 400), (20, 420, 1000, 800)], [(0, 0, 5, 5)]]
    segments = spark.createDataFrame([(0, 1, 20, 410, 1000, 410), (0, 2, 510, 20, 510, 400)], "page_id long, seg_id long, ax long, ay long, bx long, by long")
    rows = P.layout(_frame(spark, pages), segments, 1100, 1300).collect()
    first = sorted((r.number, r.panel_id) for r in rows if r.page_id == 0)
    assert first == [(1, 1), (2, 0), (3, 2)]
    assert [(r.r, r.b) for r in rows if r.page_id == 1] == [(1100, 1300)]


def test_placement(spark):
    boxes = [(1, i, 50.0, 50.0, 40, 20, 0.0, 400, 400) for i in range(6)] + [(2, 0, 5.0, 5.0, 40, 20, 0.0, 400, 400)]
    df = spark.createDataFrame(boxes, "page_id long, block_id long, cx double, cy double, w long, h long, theta double, page_w long, page_h long")
    rows = placement.place_blocks(df).collect()
    one = [(r.x1, r.y1, r.x2, r.y2) for r in sorted(rows, key=lambda r: r.block_id) if r.page_id == 1]
    assert one[0] == (30.0, 40.0, 70.0, 60.0)
    assert one[1] == (30.0, 16.0, 70.0, 36.0)
    for i, a in enumerate(one):
        assert all(not (a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]) for b in one[:i])


# --- masks ------------------------------------------------------------------


def _mask_frame(spark, pixels):
    return M.to_runs(spark.createDataFrame([(1, y, x) for y, x in pixels], "page_id long, y long, x long"))


def _pixels(runs):
    return {(r.y, r.x) for r in M.to_pixels(runs).collect()}


def _blobs(pixels):
    todo, out = set(pixels), []
    while todo:
        blob, edge = set(), [todo.pop()]
        while edge:
            y, x = edge.pop()
            blob.add((y, x))
            for n in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in todo:
                    todo.remove(n)
                    edge.append(n)
        out.append(blob)
    return out


def test_hole_fill(spark):
    rng = random.Random(7)
    ring = {(y, x) for y in range(2, 9) for x in range(2, 9) if y in (2, 8) or x in (2, 8)}
    merged = ring | {(12, x) for x in range(3, 9)} | {(rng.randrange(20), rng.randrange(20)) for _ in range(30)}
    pred = {(y, x) for y in range(2, 9) for x in range(2, 9)} | {(rng.randrange(20), rng.randrange(20)) for _ in range(60)}
    pages = spark.createDataFrame([(1, 20, 20)], "page_id long, width long, height long")
    got = _pixels(M.fill_holes(_mask_frame(spark, merged), _mask_frame(spark, pred), pages))
    holes = _blobs({(y, x) for y in range(20) for x in range(20)} - merged)
    limit = sorted([len(h) for h in holes] + [len(merged)])[-2]
    want = set(merged)
    for h in holes:
        if len(h) < limit and len(h & pred) > len(h - pred):
            want |= h
    assert got == want and got != merged


def test_ring_flags(spark):
    hole = {(y, x) for y in range(1, 6) for x in range(1, 6)}
    pages = spark.createDataFrame([(1, 7, 7)], "page_id long, width long, height long")
    rows = {(r.y, r.x): r for r in M.ring_distance(_mask_frame(spark, hole), pages).collect()}
    assert {k: r.ring for k, r in rows.items()} == {(y, x): min(y, x, 6 - y, 6 - x) for y, x in hole}
    corner = rows[1, 1]
    assert corner.d1 and corner.d2 and corner.d3 and not corner.d4
    assert not rows[1, 3].d2 and rows[1, 3].d1 and rows[1, 3].d3


def test_rings_of_any_shape(spark):
    """Several pages, strips narrower than a page, unknown pixels at all borders, a page that is all unknown."""
    rng = random.Random(4)
    sizes = {1: (150, 30), 2: (3, 40), 3: (64, 5), 4: (10, 10), 5: (131, 9)}
    unknown = {p: {(y, x) for y in range(h) for x in range(w) if rng.random() < 0.97} for p, (w, h) in sizes.items()}
    unknown[4] = {(y, x) for y in range(10) for x in range(10)}
    rows = [(p, y, x, x) for p, px in unknown.items() for y, x in px]
    pages = spark.createDataFrame([(p, w, h) for p, (w, h) in sizes.items()], "page_id long, width long, height long")
    got = {(r.page_id, r.y, r.x): (r.ring, r.d1, r.d2, r.d3, r.d4) for r in M.ring_distance(spark.createDataFrame(rows, "page_id long, y long, x long, x1 long").select(
        "page_id", "y", F.col("x").alias("x0"), "x1"), pages).collect()}
    want = {}
    for p, (w, h) in sizes.items():
        known = {(y, x) for y in range(h) for x in range(w)} - unknown[p]
        ring = {q: 0 for q in known}
        ring |= {(y, x): min(max(abs(y - a), abs(x - b)) for a, b in known) for y, x in unknown[p] if known}
        for (y, x), n in ring.items():
            if n:
                hit = lambda *cells: any(ring.get((y + dy, x + dx)) == n - 1 for dy, dx in cells)
                want[p, y, x] = (n, hit((-1, -1), (-1, 0), (0, -1)), hit((1, -1), (1, 0), (0, -1)), hit((-1, 1), (-1, 0), (0, 1)), hit((1, 1), (1, 0), (0, 1)))
    assert got == want


def test_clipped_area(spark):
    df = spark.createDataFrame([([{"x": 0, "y": 0}, {"x": 10, "y": 10}, {"x": 0, "y": 20}, {"x": -10, "y": 10}],)], "pts array<struct<x:bigint,y:bigint>>")
    area = lambda *b: df.select(LN.clipped_area(F.col("pts"), *[F.lit(v) for v in b])).first()[0]
    assert area(-20, -20, 30, 30) == pytest.approx(200) and area(0, 0, 30, 30) == pytest.approx(100)
    assert area(0, 10, 30, 30) == pytest.approx(50) and area(40, 40, 50, 50) == 0


def test_text_mask_follows_the_lines(spark):
    text = {(y, x) for y in range(10, 14) for x in range(10, 30)}
    noise = {(y, x) for y in range(60, 64) for x in range(80, 84)}
    pages = spark.createDataFrame([(1, 100, 100)], "page_id long, width long, height long")
    quad = [(1, 1, [{"x": 5, "y": 5}, {"x": 50, "y": 5}, {"x": 50, "y": 20}, {"x": 5, "y": 20}])]
    lines = G.with_geometry(G.with_corner_order(spark.createDataFrame(quad, "page_id long, quad_id long, pts array<struct<x:bigint,y:bigint>>")))
    got = _pixels(LN.text_mask(lines, _mask_frame(spark, text | noise), pages, offset=0.0, scale=False))
    assert text < got and not got & noise
    assert min(y for y, _ in got) == 8 and max(x for _, x in got) == 31


def test_refined_mask_keeps_the_lettering(spark):
    letters = {(y, x) for y in range(12, 20) for x in range(10, 30)}
    rows = []
    for y in range(40):
        for x in range(50):
            on = (y, x) in letters
            v = 255 if 10 <= y < 22 and 8 <= x < 32 else 0
            c = 10 if on else 240
            rows.append((1, y, x, c, c, c, v))
    rgb = spark.createDataFrame(rows, "page_id long, y long, x long, r long, g long, b long, v long")
    win = spark.createDataFrame([(1, 1, 2, 4, 40, 30)], "page_id long, block_id long, x1 long, y1 long, x2 long, y2 long")
    got = _pixels(LN.refine_masks(rgb, win))
    assert letters <= got and all(4 <= y < 30 and 2 <= x < 40 for y, x in got)


def _odd_pages():
    """Pages of all sorts: noise, flat ones, lettering, some without a part of their pixels; windows that overlap, touch grid cells or are one pixel."""
    rng = random.Random(11)
    rows, windows = [], []
    for p, (w, h, kind) in enumerate([(40, 25, "noise"), (30, 30, "letters"), (12, 9, "flat"), (24, 40, "letters"), (33, 21, "sparse"), (9, 30, "two")]):
        left, top = (500, 505) if p == 3 else (0, 0)
        for y in range(h):
            for x in range(w):
                if kind == "sparse" and rng.random() < 0.3:
                    continue
                on = (y // 3 + x // 4) % 3 == 0
                r, g, b = ([rng.randrange(256) for _ in range(3)] if kind in ("noise", "sparse") else [90, 90, 90] if kind == "flat"
                           else [rng.choice((0, 255))] * 3 if kind == "two" else [(20 if on else 220) + rng.randrange(30) for _ in range(3)])
                v = rng.choice((0, 61, 128, 255)) if kind in ("noise", "sparse") else 255 if on or rng.random() < 0.6 else rng.randrange(256)
                rows.append((p, top + y, left + x, r, g, b, v))
        windows += [(p, 0, left, top, left + w, top + h), (p, 1, left + 2, top + 3, left + w - 1, top + h - 2), (p, 2, left + 5, top + 5, left + 6, top + 6), (p, 3, left, top + 4, left + 7, top + 8)]
    return rows, windows


def _odd_frames(spark):
    rows, windows = _odd_pages()
    rgb = spark.createDataFrame(rows, "page_id long, y long, x long, r long, g long, b long, v long")
    return rgb, spark.createDataFrame(windows, "page_id long, block_id long, x1 long, y1 long, x2 long, y2 long"), windows


def _sorted_runs(df):
    return sorted(map(tuple, df.select("page_id", "y", "x0", "x1").collect()))


def test_windows_of_few_pixels_are_refined_as_large_ones(spark, monkeypatch):
    rgb, win, _ = _odd_frames(spark)
    want = _sorted_runs(M.union(LN._refine_crowded(rgb, win, False)))

    def none(*_):
        raise AssertionError("rounds of joins for windows of few pixels")

    monkeypatch.setattr(LN, "_refine_crowded", none)
    assert _sorted_runs(LN.refine_masks(rgb, win)) == want and len(want) > 100


def test_large_and_odd_windows_go_through_the_rounds(spark, monkeypatch):
    rgb, win, windows = _odd_frames(spark)
    want = _sorted_runs(LN.refine_masks(rgb, win, inpaint=True))
    monkeypatch.setattr(LN.W, "FEW_PIXELS", 300)
    # a pixel that comes twice, and one without a value that lies beyond the windows but in their cell
    odd = rgb.unionByName(rgb.where("page_id = 2 AND y = 1 AND x = 1")).unionByName(spark.createDataFrame([(5, 50, 3, None, 1, 1, 1)], rgb.schema))
    packed = LN.W.pack(odd, win)
    assert {(r.page_id, r.block_id) for r in packed.where("NOT few").collect()} == {(p, b) for p, b, x1, y1, x2, y2 in windows if (x2 - x1) * (y2 - y1) > 300} | {(2, 0)}
    assert _sorted_runs(LN.refine_masks(rgb, win, inpaint=True)) == want


def test_otsu_and_top_colors_of_few_rows(spark):
    import numpy as np
    from folioframe.operators import raster as R

    rng = random.Random(2)
    values = [(k, rng.choice((0, 3, 128, 255)) if k % 3 else rng.randrange(256)) for k in range(40) for _ in range(1 + k * 3)] + [(40, 7)] * 5 + [(41, v) for v in (0, 255)]
    df = spark.createDataFrame(values, "k long, v long")
    counts = np.zeros((42, 256), dtype=np.int64)
    for k, v in values:
        counts[k, v] += 1
    assert LN.W._thresholds(counts).tolist() == [r.threshold for r in R.otsu_threshold(df, ["k"]).orderBy("k").collect()]
    bins = np.zeros((42, 256), dtype=np.int64)
    for k, v in values:
        bins[k, v * 255 // 256] += 1
    assert [LN.W._top_colors(b) for b in bins] == [r.colors for r in R.top_colors(R.gray_bins(df, ["k"]), ["k"]).orderBy("k").collect()]
