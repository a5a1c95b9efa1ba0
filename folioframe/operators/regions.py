"""Lines to regions to text blocks."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.functions.language import detect_language
from folioframe.operators import filters
from folioframe.operators.graph import component_links, spanning_forest
from folioframe.operators.spatial import CELL, MERGE_RULE, grouping_edges
from folioframe.session import cut_lineage

#: Fixed values of the split rule.
GAMMA, SIGMA, PAIR_ANGLE = 0.5, 2.0, 0.2 * math.pi

#: Regions up to this many lines are split inside one row; larger ones are
#: split by rounds of joins.
ROW_LIMIT = 512


# --- small regions: one row each --------------------------------------------


def _tree(xy: np.ndarray, ids: np.ndarray) -> list[tuple]:
    """Minimum spanning tree edges (w, u, v, i, j), ties to the smaller ids."""
    n = len(ids)
    best: list = [None] * n
    done = np.zeros(n, dtype=bool)
    edges, at = [], 0
    for _ in range(n - 1):
        done[at] = True
        d = np.sqrt(((xy - xy[at]) ** 2).sum(axis=1).astype("float64"))
        for j in np.flatnonzero(~done):
            edge = (d[j], min(ids[at], ids[j]), max(ids[at], ids[j]), at, j)
            if best[j] is None or edge[:3] < best[j][:3]:
                best[j] = edge
        at = min(np.flatnonzero(~done), key=lambda j: best[j][:3])
        edges.append(best[at])
    return edges


def _touching(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the hulls of two quads meet: no corner-to-corner axis parts them."""
    corners = np.concatenate([a, b])
    dirs = (corners[:, None, :] - corners[None, :, :]).reshape(-1, 2)
    axes = np.concatenate([dirs, np.stack([-dirs[:, 1], dirs[:, 0]], axis=1)])
    pa, pb = a @ axes.T, b @ axes.T
    return not bool(((pa.min(0) > pb.max(0)) | (pb.min(0) > pa.max(0))).any())


def _split(members, edges, ids, quads, fonts, angles, out):
    """Label ``members`` (positions) with their region, cutting the longest edge."""
    todo = [(members, edges)]
    while todo:
        part, tree = todo.pop()
        if len(part) == 1:
            keep = True
        elif len(part) == 2:
            i, j = part
            keep = (tree[0][0] < (1 + GAMMA) * max(fonts[i], fonts[j])
                    and abs(angles[i] - angles[j]) < PAIR_ANGLE)
        else:
            w = np.array([e[0] for e in tree])
            longest = max(tree, key=lambda e: (e[0], -e[1], -e[2]))
            font = float(np.mean([fonts[i] for i in part]))
            spread = float(w.std())
            keep = longest[0] <= w.mean() + SIGMA * spread or longest[0] <= (1 + GAMMA) * font
            if keep and not spread < max(0.3 * font + 5.0, 5.0):
                a, b = quads[longest[3]], quads[longest[4]]
                shift = np.abs(a.mean(axis=0) - b.mean(axis=0)).max()
                keep = shift < 5.0 and _touching(a, b)
        if keep:
            label = min(ids[i] for i in part)
            for i in part:
                out[i] = label
            continue
        cut = max(tree, key=lambda e: (e[0], -e[1], -e[2]))
        rest = [e for e in tree if e is not cut]
        side, grown = {cut[3]}, True
        while grown:
            grown = False
            for e in rest:
                if (e[3] in side) != (e[4] in side):
                    side |= {e[3], e[4]}
                    grown = True
        todo.append(([i for i in part if i in side], [e for e in rest if e[3] in side]))
        todo.append(([i for i in part if i not in side], [e for e in rest if e[3] not in side]))


@F.pandas_udf(ArrayType(LongType()))
def _split_rows(ids: pd.Series, corners: pd.Series, fonts: pd.Series, angles: pd.Series) -> pd.Series:
    result = []
    for i, c, f, a in zip(ids, corners, fonts, angles):
        quads = np.asarray(c, dtype="int64").reshape(-1, 4, 2)
        out = [0] * len(i)
        _split(list(range(len(i))), _tree(quads[:, 0, :], i), i, quads, f, a, out)
        result.append(out)
    return pd.Series(result)


def _split_small(lines: DataFrame) -> DataFrame:
    """Regions of the lines whose component fits one row."""
    flat = F.flatten(F.transform("pts", lambda p: F.array(p["x"], p["y"])))
    packed = lines.groupBy("page_id", "component").agg(
        F.sort_array(F.collect_list(F.struct("quad_id", flat.alias("c"), "font_size", "angle"))).alias("m"))
    labels = _split_rows(
        F.col("m.quad_id"), F.flatten(F.col("m.c")), F.col("m.font_size"), F.col("m.angle"))
    return packed.select(
        "page_id", F.explode(F.arrays_zip(F.col("m.quad_id").alias("quad_id"), labels.alias("region"))).alias("z")
    ).select("page_id", "z.quad_id", "z.region")


# --- large regions: rounds of joins -----------------------------------------


def _keep_rule(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """Per component: its longest edge and whether it stays one region; two lines have a rule of their own."""
    key = ["page_id", "component"]
    edges = tree.groupBy(*key).agg(
        F.avg("w").alias("mean"), F.stddev_pop("w").alias("spread"),
        F.max(F.struct("w", (-F.col("u")).alias("nu"), (-F.col("v")).alias("nv"))).alias("top"))
    fonts = nodes.groupBy(*key).agg(F.avg("font_size").alias("font"), F.max("font_size").alias("largest"), F.count(F.lit(1)).alias("lines"),
                                    (F.max("angle") - F.min("angle")).alias("turn"))
    end = lambda n: nodes.select(
        "page_id", F.col("quad_id").alias(n), F.col("pts").alias(f"{n}_pts"),
        F.col("cx").alias(f"{n}_cx"), F.col("cy").alias(f"{n}_cy"))
    df = (
        edges.join(fonts, key)
        .withColumns({"u": -F.col("top.nu"), "v": -F.col("top.nv"), "w": F.col("top.w")})
        .join(end("u"), ["page_id", "u"]).join(end("v"), ["page_id", "v"])
    )
    shift = F.greatest(F.abs(F.col("u_cx") - F.col("v_cx")), F.abs(F.col("u_cy") - F.col("v_cy")))
    near = (F.col("w") <= F.col("mean") + F.col("spread") * SIGMA) | (F.col("w") <= F.col("font") * (1 + GAMMA))
    even = F.col("spread") < F.greatest(F.col("font") * 0.3 + 5.0, F.lit(5.0))
    stacked = (shift < 5.0) & (G.quad_distance("u_pts", "v_pts") == 0)
    pair = (F.col("w") < F.col("largest") * (1 + GAMMA)) & (F.col("turn") < PAIR_ANGLE)
    return df.select(*key, "u", "v", F.when(F.col("lines") == 2, pair).otherwise(near & (even | stacked)).alias("keep"))


def _split_large(lines: DataFrame, limit: int) -> DataFrame:
    """Regions of components beyond ``limit``, by cutting all of them in step."""
    lines = cut_lineage(lines)
    x, y = G.corner(F.col("pts"), 0)
    points = lines.select("page_id", "component", F.col("quad_id").alias("id"), x.alias("x"), y.alias("y"))
    nodes = cut_lineage(lines.select("page_id", "quad_id", "component", "pts", "font_size", "angle", "cx", "cy"))
    tree = spanning_forest(points)
    key = ["page_id", "component"]
    done = []
    while True:
        rule = cut_lineage(_keep_rule(nodes, tree))
        kept = rule.where("keep").select(*key)
        done.append(nodes.join(kept, key, "left_semi").select("page_id", "quad_id", F.col("component").alias("region")))
        cut = rule.where(~F.col("keep"))
        if cut.isEmpty():
            break
        tree = tree.join(cut.select(*key), key, "left_semi").join(
            cut.select("page_id", "u", "v"), ["page_id", "u", "v"], "left_anti")
        nodes = nodes.join(cut.select(*key), key, "left_semi")
        links = component_links(tree.select("page_id", "u", "v"))
        label = links.select("page_id", F.col("u").alias("quad_id"), F.col("v").alias("_root"))
        nodes = cut_lineage(
            nodes.drop("component").join(label, ["page_id", "quad_id"], "left")
            .withColumn("component", F.coalesce("_root", "quad_id")).drop("_root"))
        sizes = nodes.groupBy(*key).count()
        small = sizes.where(F.col("count") <= limit).select(*key)
        done.append(_split_small(nodes.join(small, key, "left_semi")))
        big = sizes.where(F.col("count") > limit).select(*key)
        nodes = cut_lineage(nodes.join(big, key, "left_semi"))
        root = nodes.select("page_id", F.col("quad_id").alias("u"), "component")
        tree = cut_lineage(tree.drop("component").join(root, ["page_id", "u"]))
        if nodes.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def split_regions(lines: DataFrame, links: DataFrame, limit: int = ROW_LIMIT) -> DataFrame:
    """Add ``region`` (its smallest line id) to lines with geometry.

    ``links`` ties the lines of a component to its root.  Lines without a link
    are regions of their own and meet no shuffle beyond the one join.
    """
    size = links.groupBy("page_id", F.col("v").alias("component")).agg((F.count(F.lit(1)) + 1).alias("size"))
    root = links.select("page_id", F.col("u").alias("quad_id"), F.col("v").alias("component")).unionByName(
        links.select("page_id", F.col("v").alias("quad_id"), F.col("v").alias("component")).distinct())
    root = root.join(size, ["page_id", "component"])
    slim = lines.select("page_id", "quad_id", "pts", "font_size", "angle", "cx", "cy")
    members = slim.join(root, ["page_id", "quad_id"])
    parts = [_split_small(members.where(F.col("size") <= limit))]
    if not size.where(F.col("size") > limit).isEmpty():
        parts.append(_split_large(members.where(F.col("size") > limit).drop("size"), limit))
    labels = reduce(DataFrame.unionByName, parts)
    return lines.join(labels, ["page_id", "quad_id"], "left").withColumn(
        "region", F.coalesce("region", "quad_id"))


def regions(lines: DataFrame, limit: int = ROW_LIMIT, cell: int = CELL) -> DataFrame:
    """Group and split lines with geometry; adds ``region``."""
    lines = cut_lineage(lines)
    links = component_links(grouping_edges(lines, MERGE_RULE, cell))
    return split_regions(lines, links, limit)


# --- aggregates -------------------------------------------------------------


def majority_vertical() -> Column:
    """Direction of a region; a tie goes to the line with the most extreme aspect."""
    count, up = F.count(F.lit(1)), F.count_if(F.col("vertical"))
    extreme = F.max(F.struct(
        F.greatest(F.col("aspect"), F.lit(1.0) / F.col("aspect")).alias("a"),
        (-F.col("quad_id")).alias("q"), F.col("vertical").alias("v")))
    return F.when(up * 2 == count, extreme["v"]).otherwise(up * 2 > count)


def mean_color(name: str) -> Column:
    """Channel means of the coloured lines, truncated; null without any."""
    parts = [F.avg(F.col(name).getItem(i)).cast("smallint") for i in range(3)]
    return F.when(F.count(F.col(name)) > 0, F.array(*parts))


def region_angle() -> Column:
    deg = F.degrees(F.avg("angle")) - F.lit(90.0)
    return F.when(F.abs(deg) < 3.0, F.lit(0.0)).otherwise(deg)


def reading_key(vertical: Column) -> Column:
    """Right to left for vertical regions, top to bottom otherwise."""
    return F.when(vertical, -F.col("cx")).otherwise(F.col("cy"))


def text_blocks(lines: DataFrame) -> DataFrame:
    """One row per region of lines that carry ``region``."""
    total = lines.groupBy("page_id").agg(F.sum("area").alias("_page_area"))
    line = F.struct("cx", "cy", "quad_id", "text", "pts")
    grouped = lines.groupBy("page_id", "region").agg(
        F.count(F.lit(1)).alias("n_lines"), majority_vertical().alias("vertical"),
        F.sum(F.log("score") * F.col("area")).alias("_logprob"),
        F.min(F.col("font_size").cast("bigint")).alias("font_size"),
        region_angle().alias("angle"), mean_color("fg").alias("fg"), mean_color("bg").alias("bg"),
        F.collect_list(line).alias("_lines"))
    keyed = F.transform("_lines", lambda e: F.struct(
        F.when(F.col("vertical"), -e["cx"]).otherwise(e["cy"]).alias("k"),
        e["quad_id"].alias("q"), e["text"].alias("text"), e["pts"].alias("pts")))
    grouped = grouped.withColumn("_lines", F.sort_array(keyed))
    return grouped.join(total, "page_id").select(
        "page_id", F.col("region").alias("block_id"), "n_lines", "vertical",
        T.join_lines(F.col("_lines.text")).alias("text"), F.col("_lines.pts").alias("lines"),
        "font_size", "angle", F.exp(F.col("_logprob") / F.col("_page_area")).alias("prob"), "fg", "bg")


def _with_regions(lines: DataFrame, limit: int, cell: int) -> DataFrame:
    """Lines with geometry and region; only the geometry is written, not the text."""
    geo = cut_lineage(G.with_geometry(G.with_corner_order(lines.select("page_id", "quad_id", "pts", "score"))))
    labelled = regions(geo, limit, cell)
    return labelled.join(lines.select("page_id", "quad_id", "text", "fg", "bg"), ["page_id", "quad_id"])


def merge_regions(
    lines: DataFrame, prob: float = 0.2, min_text_length: int = 1, remove_text: list[str] | None = None,
    remove_mode: str = "exact", limit: int = ROW_LIMIT, cell: int = CELL,
    profiles: DataFrame | None = None, skip_languages: list[str] | None = None,
) -> DataFrame:
    """The whole merge: probability filter, grouping, split, blocks, text repair.

    The probability filter runs before any join, blocks whose text is too short,
    has no letter or is unwanted leave at the end. With language ``profiles``,
    blocks get their ``language`` and, if it is one of ``skip_languages``, the
    flag ``skip_translate``: what translation needs.
    """
    kept = filters.min_probability(lines, prob)
    blocks = text_blocks(_with_regions(kept, limit, cell))
    # written here: the merge runs once, and a text is repaired once and not in every test of the filters and the detection
    blocks = cut_lineage(blocks.withColumn("text", G.let(T.strip(F.col("text")), lambda t: T.repair_brackets(t))))
    reason = filters.drop_reason(F.col("text"), min_text_length, remove_text, remove_mode)
    blocks = blocks.where(reason.isNull())
    if profiles is None:
        return blocks
    return filters.flag_skip_language(detect_language(blocks, profiles, ["page_id", "block_id"]), list(skip_languages or []))


def line_merge(items: DataFrame) -> DataFrame:
    """Lines in, ``(page_id, text, lines, angle)`` per region out, no text filter."""
    return text_blocks(_with_regions(items, ROW_LIMIT, CELL)).select("page_id", "block_id", "text", "lines", "angle")


def line_count_check(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per page: lines put in and lines found in its blocks."""
    a = lines.groupBy("page_id").agg(F.count(F.lit(1)).alias("lines_in"))
    b = blocks.groupBy("page_id").agg(F.sum(F.size("lines")).alias("lines_out"))
    out = F.coalesce("lines_out", F.lit(0))
    return a.join(b, "page_id", "left").select(
        "page_id", "lines_in", out.alias("lines_out"), (F.col("lines_in") == out).alias("same"))
