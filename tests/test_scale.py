"""What keeps operators within the driver, the disk and the time at larger tables."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from folioframe.functions import language as L
from folioframe.operators import panels as P
from folioframe.operators import translate as X
from folioframe.session import measured_broadcasts
from folioframe.udf import contracts as U

BOX = "page_id bigint, panel_id bigint, x bigint, y bigint, r bigint, b bigint"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_guessed_sizes_decide_no_broadcast(spark):
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(static), spark.conf.get(measured, None)
    try:
        spark.conf.set(static, "3000000")
        spark.conf.unset(measured)
        measured_broadcasts(spark)
        assert (spark.conf.get(static), spark.conf.get(measured)) == ("-1", "3000000")
        measured_broadcasts(spark)
        measured_broadcasts(spark, False)
        assert (spark.conf.get(static), spark.conf.get(measured, None)) == ("3000000", None)
    finally:
        for key, value in zip((static, measured), before):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_trigrams_meet_a_broadcast_profile(spark):
    profiles = L.train_profiles(spark.createDataFrame([("the cat", "en"), ("die katze", "de")], "text string, lang string"))
    texts = spark.createDataFrame([(1, "the cat"), (2, "katze"), (3, None)], "id bigint, text string")
    out = L.detect_language(texts, profiles, ["id"])
    assert "BroadcastHashJoin [gram" in _plan(L.best_language(texts, profiles, ["id"]))
    assert {(r.id, r.language) for r in out.collect()} == {(1, "en"), (2, "de"), (3, None)}


def test_trigrams_of_a_large_profile_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(L, "broadcast_if_few", lambda df: df)
    profiles = L.train_profiles(spark.createDataFrame([("the the cat", "en"), ("die katze", "de")], "text string, lang string"))
    texts = spark.createDataFrame([(1, "the the"), (2, "katze katze")], "id bigint, text string")
    assert {(r.id, r.language) for r in L.detect_language(texts, profiles, ["id"]).collect()} == {(1, "en"), (2, "de")}


def test_routes_do_not_shuffle_blocks_by_language(spark):
    routes = spark.createDataFrame([("en", 0, "echo", "de"), (None, 0, "echo", "en")], "src_lang string, step int, translator string, target string")
    blocks = spark.range(4).select("id", F.when(F.col("id") > 0, F.lit("en")).alias("language"))
    out = X.with_route(blocks, routes)
    assert "SortMergeJoin" not in _plan(out) and "BroadcastHashJoin" in _plan(out)
    assert {(r.id, r.steps[0].target) for r in out.collect()} == {(0, "en"), (1, "de"), (2, "de"), (3, "de")}


def _pages(spark):
    rnd = random.Random(5)
    rows, segments = [], []
    for page in range(20):
        for i in range(rnd.randint(1, 8)):
            x, y = rnd.randint(0, 500), rnd.randint(0, 500)
            rows.append((page, i, x, y, x + rnd.randint(0, 220), y + rnd.randint(0, 220)))
        segments += [(page, i, *(rnd.randint(0, 700) for _ in range(4))) for i in range(rnd.randint(0, 3))]
    return spark.createDataFrame(rows, BOX), spark.createDataFrame(segments, "page_id bigint, seg_id bigint, ax bigint, ay bigint, bx bigint, `by` bigint")


def test_few_panels_need_no_bands_clusters_or_rounds(spark, monkeypatch):
    panels, segments = _pages(spark)
    jobs = [P.neighbours, P.merge_contained, P.deoverlap, lambda p: P.group_big(p, segments)]
    rows = lambda df: sorted(map(repr, df.collect()))
    monkeypatch.setattr(P, "FEW_PANELS", 0)
    crowded = [rows(job(panels)) for job in jobs]
    monkeypatch.undo()
    for name in ("_neighbours_by_bands", "clusters", "_group_by_rounds"):
        monkeypatch.setattr(P, name, None)
    assert [rows(job(panels)) for job in jobs] == crowded


def test_upscaler_gets_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(U, "TILE_PIXELS", 8)
    tiles = spark.range(40).select(F.col("id").alias("page_id"), *[F.lit(0).cast("bigint").alias(c) for c in ("tile_y", "tile_x", "ty", "tx")], F.col("id").alias("v"))

    def loader():
        def model(frame: pd.DataFrame) -> pd.DataFrame:
            assert len(frame) <= 2
            return frame
        return model

    assert {(r.page_id, r.v) for r in U.upscale(tiles, loader, 2, "bounded").collect()} == {(i, i) for i in range(40)}


def test_merged_blocks_are_written_before_their_language_is_found(spark):
    from folioframe.functions import geometry as G
    from folioframe.functions import language as L
    from folioframe.operators.regions import merge_regions

    texts = spark.createDataFrame([("the house and the dog", "en"), ("das haus und der hund", "de"), ("der die das und", None)], "text string, lang string")
    profiles = L.train_profiles(texts)
    found = {r.text: r.best.lang for r in L.best_language(texts.where("lang IS NOT NULL"), profiles, ["text"]).collect()}
    assert found == {"the house and the dog": "en", "das haus und der hund": "de"}
    weight = {(r.gram, r.lang): r.weight for r in profiles.collect()}
    for r in L.best_language(texts, profiles, ["text"]).collect():
        grams = [w[i:i + 3] for w in (f" {w} " for w in r.text.split()) for i in range(len(w) - 2)]
        assert r.best.score == max(sum(weight.get((g, lang), 0) for g in grams) for lang in ("en", "de"))
    lines = spark.range(3).selectExpr("id AS quad_id", "0L AS page_id", "'(the house]' AS text", "0.9D AS score", "0.9D AS prob",
                                      "CAST(NULL AS array<smallint>) AS fg", "CAST(NULL AS array<smallint>) AS bg", "id * 300 AS x")
    from pyspark.sql import functions as F
    lines = lines.withColumn("pts", G.box_quad(F.col("x"), F.lit(10).cast("bigint"), F.lit(80).cast("bigint"), F.lit(20).cast("bigint"))).drop("x")
    blocks = merge_regions(lines, profiles=profiles, skip_languages=["es"])
    assert {(r.text, r.language, r.skip_translate) for r in blocks.collect()} == {("(the house)", "en", False)}
    assert "regexp_replace" not in blocks._jdf.queryExecution().optimizedPlan().toString()


def test_pages_of_few_segments_are_united_without_a_join(spark, monkeypatch):
    import random

    from folioframe.operators import panels as P

    rng = random.Random(5)
    rows = []
    for page in range(12):
        for i in range(rng.randint(1, 40)):
            x, y = rng.randint(0, 60), rng.randint(0, 6)
            rows.append((page, i if i % 9 else 0, x, y, x + rng.choice([0, 1, 12, 30]), y + rng.choice([0, 0, 1, 25])))
    df = spark.createDataFrame(rows + [(None, 1, 0, 0, 9, 0), (None, 2, 8, 0, 30, 0), (99, 1, 0, 0, None, 0)],
                               "page_id bigint, seg_id bigint, ax bigint, ay bigint, bx bigint, by bigint")
    united = lambda d: sorted(map(tuple, P.union_segments(d, 6.0).collect()), key=str)
    by_page, few = united(df), united(df.where("page_id < 50"))
    monkeypatch.setattr(P, "FEW_TO_PAIR", 0)
    assert united(df) == by_page
    monkeypatch.undo()
    monkeypatch.setattr(P, "box_join", None)
    assert united(df.where("page_id < 50")) == few


def test_plain_rules_of_a_dictionary_take_one_round(spark, monkeypatch):
    from pyspark.sql import functions as F

    from folioframe.operators import translate as X

    rules = [(1, "abc", "bcd"), (2, "bcd", "x+"), (4, "x", "x"), (5, "\\+y?", "-"), (6, "-", "abc"), (7, "abc", ""), (8, "zz", "q")]
    texts = ["abc abc bcd", "abcd", "", None, "x+y zz", "zzz", "ab", "a-bc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.text for r in X.apply_dictionary(df, "text", rules).collect()}
    assert got == {r.id: r.text for r in df.select("id", X.apply_rules(F.col("text"), rules).alias("text")).collect()}
    rows = lambda d: sorted(map(tuple, d.select("id", "line_no", "before", "after", "value").collect()))
    assert rows(X.audit_dictionary(df, ["id"], "text", rules)) == rows(X.replacement_audit(df, ["id"], "text", rules))
    rounds = []
    monkeypatch.setattr(X, "cut_lineage", lambda d, cut=X.cut_lineage: rounds.append(1) or cut(d))
    plain = [(1, "a", "b"), (2, "b", "c"), (3, "c", "d")]
    assert X.audit_dictionary(spark.createDataFrame([(1, "abc")], "id int, text string"), ["id"], "text", plain).count() == 3
    assert len(rounds) == 1


def _chain_of_rules(n):
    """Each rule makes the word of the next one, so a text has as many changes as rules."""
    return [(i + 1, f"word{i:03d}", f"word{i + 1:03d}") for i in range(n)]


def test_changes_of_a_dictionary_are_found_without_their_texts(spark):
    rules, text = _chain_of_rules(200), "word000 " + "x " * 2000
    df = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "id int, text string")
    found = df.select("id", "text", X._candidates(rules)("text", F.lit(0)).alias("found"))
    sizes = {r.id: r.n for r in found.select("id", F.length(F.to_json("found")).alias("n")).collect()}
    assert sizes[1] < 2 * len(text) and sizes[2] < 100 and sizes[3] < 100
    assert {r.id: r.text for r in X.apply_dictionary(df, "text", rules).collect()} == {1: text.replace("word000", "word200"), 2: "x", 3: None}


def test_an_audit_of_a_dictionary_keeps_a_text_once_a_round(spark, monkeypatch):
    rules, filler = _chain_of_rules(100) + [(101, "word[0-9]+", "xx-y"), (102, "-", ""), (103, "xy", "z"), (104, "z{2}", "word000")], "- " * 1000
    texts = [(1, filler + "word000 z"), (1, filler + "word000 z"), (2, "word099" + filler), (3, filler.replace("-", "+")), (None, "xxyx" + filler), (5, None), (6, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    want = []
    for k, text in texts:
        for n, pattern, value in rules if text else []:
            new = re.sub(pattern, value, text)
            if new != text:
                want.append((k, n, text, new, value))
            text = new
    kept = []
    monkeypatch.setattr(X, "cut_lineage", lambda d, cut=X.cut_lineage: kept.append(cut(d)) or kept[-1])
    # about 3 texts a piece
    monkeypatch.setattr(X, "_SENT_CHARS", 6000, raising=False)
    got = X.audit_dictionary(df, ["id"], "text", rules)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    longest = [d.select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] for d in kept]
    assert max(longest) < 3 * len(filler)
