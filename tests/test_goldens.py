"""Known results on small inputs."""

import functools
import os

import pytest
from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.operators import blocks as B
from folioframe.operators import filters, regions
from folioframe.operators import raster as R
from folioframe.operators import translate as X
from folioframe.operators.graph import component_links
from folioframe.operators.plans_table import resize_plans
from folioframe.operators.spatial import grouping_edges
from folioframe.sources import tables as S
from folioframe.udf import contracts as U

REGION_QUADS = [
    [(412, 4634), (591, 4634), (591, 4707), (412, 4707)], [(585, 1987), (795, 1991), (794, 2067), (584, 2063)],
    [(219, 5258), (445, 5262), (444, 5338), (218, 5334)], [(204, 4492), (437, 4492), (437, 4568), (204, 4568)],
    [(236, 2976), (542, 2976), (542, 3050), (236, 3050)], [(670, 2263), (970, 2262), (971, 2333), (670, 2335)],
    [(670, 2121), (968, 2121), (968, 2186), (670, 2186)], [(434, 5499), (806, 5499), (806, 5564), (434, 5564)],
    [(173, 2908), (603, 2908), (603, 2973), (173, 2973)], [(277, 4708), (722, 4712), (722, 4777), (277, 4773)],
    [(583, 2194), (1063, 2194), (1063, 2258), (583, 2258)], [(136, 3052), (640, 3052), (640, 3117), (136, 3117)],
    [(201, 440), (728, 440), (728, 500), (201, 500)], [(334, 5424), (912, 5428), (912, 5493), (334, 5489)],
]
REGIONS = {(0,), (9,), (3,), (1, 5, 6, 10), (2,), (4, 8, 11), (7,), (13,), (12,)}
COMPONENTS = {(0, 3, 9), (1, 5, 6, 10), (2,), (4, 8, 11), (7, 13), (12,)}

LINE_SCHEMA = ("page_id bigint, quad_id bigint, pts array<struct<x:bigint,y:bigint>>, score double, text string, "
               "prob double, fg array<smallint>, bg array<smallint>")


def quads(spark, items):
    rows = [(1, i, [{"x": x, "y": y} for x, y in q], 1.0, "", 1.0, None, None) for i, q in enumerate(items)]
    return spark.createDataFrame(rows, LINE_SCHEMA)


def geo(spark, items):
    return G.with_geometry(G.with_corner_order(quads(spark, items)))


def grouped(df, label):
    rows = df.groupBy(label).agg(F.sort_array(F.collect_list("quad_id")).alias("m")).collect()
    return {tuple(r.m) for r in rows}


@pytest.mark.parametrize("limit", [512, 3, 2])
def test_region_merge(spark, limit):
    out = regions.regions(geo(spark, REGION_QUADS), limit=limit)
    assert grouped(out, "region") == REGIONS


@pytest.mark.parametrize("cell", [64, 4096])
def test_components_before_split(spark, cell):
    from folioframe.operators.graph import connected_components

    g = geo(spark, REGION_QUADS)
    out = connected_components(g.select("page_id", "quad_id"), grouping_edges(g, cell=cell))
    assert grouped(out, "component") == COMPONENTS


def test_copies_join_their_region(spark):
    copies = REGION_QUADS + [REGION_QUADS[1]] * 6
    links = component_links(grouping_edges(geo(spark, copies)))
    root = {r.u: r.v for r in links.collect()}
    assert {root.get(i, i) for i in [1, 5, 6, 10, *range(14, 20)]} == {1}


def test_merge_blocks_have_all_lines(spark):
    blocks = regions.line_merge(quads(spark, REGION_QUADS)).collect()
    assert len(blocks) == 9 and sum(len(b.lines) for b in blocks) == 14


@pytest.mark.parametrize("pts, want, vertical", [
    ([(0, 0), (10, 0), (0, 1), (10, 1)], [(0, 0), (10, 0), (10, 1), (0, 1)], False),
    ([(169, 6), (207, 6), (169, 164), (207, 164)], [(169, 6), (207, 6), (207, 164), (169, 164)], True),
])
def test_corner_order(spark, pts, want, vertical):
    row = G.with_corner_order(quads(spark, [pts])).first()
    assert [(p.x, p.y) for p in row.pts] == want and row.vertical is vertical


def test_measures(spark):
    rows = {r.quad_id: r for r in geo(spark, [
        [(0, 0), (4, 0), (4, 3), (0, 3)], [(0, 0), (10, 0), (10, 2), (0, 2)], [(0, 0), (2, 0), (2, 10), (0, 10)]]).collect()}
    assert rows[0].area == 12.0
    assert 4.5 < rows[1].aspect < 5.5
    assert rows[2].aspect < 0.3


def test_midpoints(spark):
    m = G.midpoints(F.col("pts"))
    row = quads(spark, [[(0, 0), (10, 0), (10, 4), (0, 4)]]).select(*[c.alias(f"m{i}") for i, c in enumerate(v for p in m for v in p)]).first()
    assert tuple(row) == (5, 0, 5, 4, 10, 2, 0, 2)


def test_hull_of_a_dart(spark):
    # the fourth corner lies inside the triangle of the others
    row = quads(spark, [[(0, 0), (10, 0), (5, 3), (5, 10)]]).select(G.hull_area("pts").alias("a")).first()
    assert row.a == 50.0


def test_distance_of_tilted_quads(spark):
    a = [(0, 0), (10, 10), (0, 20), (-10, 10)]
    cases = [([(20, 0), (30, 10), (20, 20), (10, 10)], 0.0), ([(24, 0), (34, 10), (24, 20), (14, 10)], 4.0),
             ([(-2, 9), (2, 9), (2, 11), (-2, 11)], 0.0), ([(20, 10), (20, 20), (30, 20), (30, 10)], 10.0)]
    for b, want in cases:
        df = quads(spark, [a, b])
        j = df.where("quad_id = 0").select(F.col("pts").alias("p")).join(df.where("quad_id = 1").select(F.col("pts").alias("q")))
        assert j.select(G.quad_distance("p", "q")).first()[0] == pytest.approx(want)


def test_oriented_box(spark):
    df = quads(spark, [[(10, 20), (50, 20), (50, 40), (10, 40)]]).select(F.array("pts").alias("lines"))
    o = B.with_obb(df).first().obb
    assert (o.x, o.y) == (30, 30) and sorted((o.w, o.h)) == [20, 40]


def test_numbered_reply(spark):
    cases = [(1, 2, "[1] Hello\n[2] World"), (2, 2, "[1] Hello"), (3, 1, "[1] a\n[1] b"), (4, 1, "plain\n[1] x"), (5, 1, "3. x\n1： y")]
    out = X.parse_numbered_reply(spark.createDataFrame(cases, "k int, expected int, content string"), ["k"])
    rows = {k: sorted((r.number or 0, r.text, r.error or "") for r in out.where(F.col("k") == k).collect()) for k in range(1, 6)}
    assert rows[1] == [(1, "Hello", ""), (2, "World", "")]
    assert (2, None, "missing") in rows[2]
    assert (1, "b", "duplicate") in rows[3]
    assert any(r[2] == "unnumbered" for r in rows[4])
    assert {r[2] for r in rows[5]} == {"out of range", ""}


def test_endpoint(spark):
    df = spark.createDataFrame([("OpenAI", ""), ("OpenAI", " https://example.test/v1/ "), ("Custom", " ")], "p string, u string")
    got = [r[0] for r in df.select(X.resolve_endpoint(F.col("p"), F.col("u"))).collect()]
    assert got == ["https://api.openai.com/v1/chat/completions", "https://example.test/v1/chat/completions", None]


def test_blend(spark):
    base = spark.createDataFrame([(1, 0, x, 255, 255, 255) for x in (0, 1)], "page_id int, y int, x int, r int, g int, b int")
    over = spark.createDataFrame([(1, 0, 0, 10, 20, 30, 255), (1, 0, 1, 200, 0, 0, 128)], "page_id int, y int, x int, r int, g int, b int, a int")
    rows = {r.x: (r.r, r.g, r.b) for r in R.blend_over(base, over).collect()}
    assert rows == {0: (10, 20, 30), 1: (227, 127, 127)}


def test_resize_plan(spark):
    row = resize_plans(spark.createDataFrame([(1, 300, 150)], "panel_id int, w int, h int"), 512, 1.5, 1024, 960).first()
    assert row.aspect_w % 256 == 0 and row.aspect_h % 256 == 0 and row.ratio > 0


def test_audit(spark):
    import hashlib

    files = spark.createDataFrame([("a/x", bytearray(b"test"))], "path string, content binary")
    good = hashlib.sha256(b"test").hexdigest()
    manifest = spark.createDataFrame([("a/x", good), ("a/y", good), ("b", "###")], "path string, expected string")
    got = {r.path: (r.status, r.failure) for r in S.audit(files, manifest).collect()}
    assert got == {"a/x": ("ok", False), "a/y": ("missing", True), "b": ("missing", True)}
    again = S.audit(files.limit(0), manifest, known=spark.createDataFrame([("a/x", good)], "path string, hash string"))
    assert {r.path for r in again.where("NOT failure").collect()} == {"a/x"}


@pytest.mark.parametrize("text, want", [
    ("(a]", "(a)"), ("a)", "a"), ("「x", "x"), ('say "hi"', "say hi"), ("([x)", "[x]"), ("plain", "plain"), ("", ""), ("((a)", "(a)"), ("(“a)", "“a”"),
])
def test_bracket_repair(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.repair_brackets(F.col("t"))).first()[0] == want


def test_keep_quotes(spark):
    assert spark.createDataFrame([('say "hi" )',)], "t string").select(T.repair_brackets(F.col("t"), True)).first()[0] == 'say "hi" '


@pytest.mark.parametrize("lines, want", [
    (["a", "b"], "a b"), (["日", "b"], "日b"), (["a", "日", "b"], "a日b"), (["", "b"], " b"), (["日", "", "b"], "日b"), (["a", "", "日"], "a 日"), (["a", ""], "a "),
])
def test_line_join(spark, lines, want):
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert df.select(T.join_lines(F.col("l"))).first()[0] == want


def test_dictionary(spark):
    rules, rejects = S.read_dictionary(spark, inline="# note\n\nfoo bar # tail\n  gone\n// x\na b c\n\\bw\\b z//t")
    assert [tuple(r) for r in rules.orderBy("line_no").collect()] == [(3, "foo", "bar"), (4, "gone", ""), (7, "\\bw\\b", "z")]
    assert [r.line_no for r in rejects.collect()] == [6]
    df = spark.createDataFrame([("foo gone éw w",)], "t string")
    text = X.apply_rules(F.col("t"), X.collect_rules(rules))
    assert df.select(text).first()[0] == "bar  éw z"
    many = [(i, f"q{i}x", "") for i in range(100)] + [(101, "foo", "bar")]
    assert df.select(X.apply_rules(F.col("t"), many)).first()[0] == "bar gone éw w"


def test_filter_reasons(spark):
    df = spark.createDataFrame([("é",), ("!!!",), ("bad",), ("fine",)], "t string")
    got = [r[0] for r in df.select(filters.drop_reason(F.col("t"), 2, ["bad"])).collect()]
    assert got == [None, "not valuable", "unwanted", None]


def test_routes(spark):
    rows = [(1, None, 0, "a", "en"), (1, "fr", 0, "a", "en"), (2, "fr", 0, "a", "en"), (3, None, 0, "a", "en"), (3, "fr", 0, "a", "de"), (3, "de", 0, "a", "fr"),
            (4, None, 0, "a", None)]
    routes = spark.createDataFrame(rows, "s int, src_lang string, step int, translator string, target string")
    got = {r.s: r.problem for r in X.validate_routes(routes, ["s"]).collect()}
    assert got == {1: None, 2: "no default", 3: "loop detected", 4: "empty array"}


def test_prompt_contract_needs_a_key(spark):
    with pytest.raises(ValueError):
        U.prompt_translate(spark.range(1), ["id"], ["id"], None, "a", "b", "", " ", "m")


LOADED = []


def _engine(kind):
    LOADED.append(kind)
    return kind


def test_model_is_loaded_once():
    for _ in range(3):
        assert U.load_once("x", functools.partial(_engine, "a")) == "a"
    assert LOADED == ["a"]
    assert U.load_once("x", functools.partial(_engine, "b")) == "b"  # another engine of the same name
    U.unload("x")
    assert U.load_once("x", functools.partial(_engine, "a")) == "a" and LOADED == ["a", "b", "a"]
    U.unload("x")


def test_batches_and_pages_reach_models_whole(spark):
    def whole():
        return lambda frame: frame[["page_id", "quad_id"]].assign(
            text=[f"{len(frame)}:{len(c)}" for c in frame["crop"]], fg=None, bg=None, prob=1.0)

    rows = [(1, q, 0, 10 + q, 2 * q, 0, 2, 3) for q in range(8)] + [(1, 9, 1, 5, 0, 0, 1, 1)]
    lines = spark.createDataFrame(rows, "page_id long, quad_id long, batch long, strip long, bx long, by long, bw long, bh long")
    pixels = spark.createDataFrame([(1, y, x, 7) for y in range(4) for x in range(16)], "page_id long, y long, x long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.quad_id: r.text for r in U.recognise(lines, whole, pixels=pixels).collect()}
        assert got == {**{q: "8:6" for q in range(8)}, 9: "1:1"}
        mask = spark.createDataFrame([(1, 0, 2, 4)], "page_id long, y long, x0 long, x1 long")
        fill = lambda: lambda f: f.assign(v=f["v"].where(~f["masked"], len(f)))[["page_id", "y", "x", "v"]]
        out = U.inpaint(pixels, fill, "page_id long, y long, x long, v long", mask=mask).collect()
        assert {(r.y, r.x) for r in out if r.v == 64} == {(0, 2), (0, 3), (0, 4)} and len(out) == 64
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_detector_with_mask(spark):
    import pandas as pd

    def model(frame):
        quads = pd.DataFrame({"page_id": frame["page_id"], "quad_id": 0, "pts": [[{"x": 0, "y": 0}] * 4] * len(frame), "score": 0.5})
        return quads, pd.DataFrame({"page_id": frame["page_id"], "y": 1, "x0": 2, "x1": 3})

    quads, runs = U.detect_with_mask(spark.range(5).withColumnRenamed("id", "page_id"), lambda: model)
    assert quads.count() == 5 and sorted(tuple(r) for r in runs.collect()) == [(p, 1, 2, 3) for p in range(5)]


def test_translators_and_page_language(spark):
    from folioframe.functions import language as L
    from folioframe.operators import translate as X

    known = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string")
    blocks = spark.createDataFrame([(1, 1, "the dog"), (1, 2, "katze"), (1, 3, "and the cat"), (2, 1, "der hund")], "page_id long, block_id long, text string")
    blocks = X.with_joined_language(blocks, L.train_profiles(known), ["page_id"], ["block_id"]).withColumn("skip_translate", F.lit(False))
    assert {(r.page_id, r.language) for r in blocks.collect()} == {(1, "en"), (2, "de")}
    routes = spark.createDataFrame([("en", 0, "engine", "fr"), (None, 0, "other", "fr")], "src_lang string, step int, translator string, target string")
    out = X.translate_blocks(blocks, routes, {}, translators={"engine": lambda texts, a, b: [f"{a}>{b}:{t}" for t in texts]}).collect()
    shown = {(r.page_id, r.block_id): r.translations["French"] for r in out}
    assert shown == {(1, 1): "en>fr:the dog", (1, 2): "en>fr:katze", (1, 3): "en>fr:and the cat", (2, 1): "der hund"}


def test_blocks_know_what_translation_needs(spark):
    from folioframe.functions import language as L

    known = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string")
    pts = lambda y: [{"x": 10, "y": y}, {"x": 200, "y": y}, {"x": 200, "y": y + 20}, {"x": 10, "y": y + 20}]
    lines = spark.createDataFrame([(1, 1, pts(10), 0.9, "the dog", 1.0, None, None), (1, 2, pts(900), 0.9, "die katze", 1.0, None, None)],
                                  "page_id long, quad_id long, pts array<struct<x:bigint,y:bigint>>, score double, text string, prob double, fg array<smallint>, bg array<smallint>")
    got = regions.merge_regions(lines, profiles=L.train_profiles(known), skip_languages=["de"]).collect()
    assert sorted((r.language, r.skip_translate) for r in got) == [("de", True), ("en", False)]


def test_package_reaches_the_workers(tmp_path):
    """Started in an empty folder, without the package on the workers' path."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\nimport __spark_entry__ as e\nfrom folioframe.session import local_session\n"
            "s = local_session(2, 2)\nassert e.queries()['j16_ud3_distinct_translation'](s, '/root/testdata/sf0.001').count() > 0")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=170, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_settings_defaults(spark):
    rows = [('{"ocr": {"prob": 0.7}}',), ("nonsense",)]
    got = S.parse_settings(spark.createDataFrame(rows, "value string")).collect()
    assert [r.ocr.prob for r in got] == [0.7, 0.2] and [r.detector.box_threshold for r in got] == [0.7, 0.7]
    assert got[1].inpainter.inpaint_color == [255, 255, 255]


@pytest.mark.parametrize("pattern,literal", [("abc", "abc"), ("ab*cd", "cd"), ("ab+c", "ab"), ("a{2,3}bc", "bc"), ("(ab)?cde", "cde"), ("x|abc", ""), ("(?i)abc", ""), (r"\d+abc\.", "abc."),
                                             ("[a[b]]xy", "xy"), (r"a\|bc", "a|bc"), ("", ""), ("a?", ""), (r"(a\)b){2,3}cd", "cd"), ("^end$", "end")])
def test_literals_that_patterns_require(pattern, literal):
    from folioframe.operators.translate import required_literal

    assert required_literal(pattern) == literal


def test_dictionary_of_5000_lines_equals_the_chain(spark):
    import random
    import re

    from folioframe.operators import translate as X

    rand = random.Random(7)
    word = lambda: "".join(rand.choice("abcdefgh") for _ in range(rand.randint(4, 6)))
    rules = []
    for i in range(5000):
        w = word()
        rules.append((i, rand.choice([w, w, w[:2] + "+" + w[2:], w + "[0-9]?", f"({w})"]), rand.choice([word(), "", "e" + w[1:]])))
    rules[10] = (10, "[0-9]{3}", "abcde")  # nothing to look for: tried on every text
    texts = [" ".join(rand.choice([word(), str(rand.randint(0, 2000))]) for _ in range(rand.randint(0, 2))) for _ in range(40)] + ["", None]
    want, trail = [], []
    for k, text in enumerate(texts):
        for n, pattern, value in rules if text else []:
            new = re.sub(pattern, value, text)
            if new != text:
                trail.append((k, n, text, new, value))
            text = new
        want.append((k, text))
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    assert sorted(tuple(r) for r in X.apply_dictionary(df, "text", rules).collect()) == sorted(want)
    assert sorted(tuple(r) for r in X.audit_dictionary(df, ["k"], "text", rules).collect()) == sorted(trail)
