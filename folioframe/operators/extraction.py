"""Boxes from a score bitmap: contour boxes in, scored page quads out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.operators import filters
from folioframe.operators import mask as M
from folioframe.operators.ranking import ranked
from folioframe.session import cut_lineage


def region_scores(quads: DataFrame, raster: DataFrame, pages: DataFrame, value: str = "v", key: str = "quad_id") -> DataFrame:
    """Number and mean of the values inside each quad, by running sums along the rows of the raster.

    Every span of a quad asks for the sums up to its two ends, so it costs two
    rows however many pixels it covers. The sums of a row of pixels and what is
    asked of it are one window.
    """
    spans = M.polygon_rows(quads, pages, key).where("x0 <= x1")
    ends = spans.select("page_id", "y", F.col(key).alias("_key"), F.explode(F.array(
        F.struct((F.col("x0") - 1).alias("x"), F.lit(-1).alias("sign")), F.struct(F.col("x1").alias("x"), F.lit(1).alias("sign")))).alias("_e"))
    kind = raster.schema[value].dataType
    asked = ends.select("page_id", "y", F.col("_e.x").cast("bigint").alias("x"), F.lit(1).alias("_asks"), F.lit(None).cast(kind).alias("_v"), "_key", F.col("_e.sign").alias("_sign"))
    none = F.lit(None).cast(spans.schema[key].dataType)
    px = raster.select("page_id", "y", F.col("x").cast("bigint").alias("x"), F.lit(0).alias("_asks"), F.col(value).alias("_v"), none.alias("_key"), F.lit(0).alias("_sign"))
    upto = Window.partitionBy("page_id", "y").orderBy("x", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    sums = px.unionByName(asked).select("page_id", "_asks", "_key", "_sign", F.sum(1 - F.col("_asks")).over(upto).alias("_n"),
                                        F.count("_v").over(upto).alias("_known"), F.coalesce(F.sum("_v").over(upto), F.lit(0)).alias("_sum")).where("_asks = 1")
    total = lambda c: F.sum(F.col(c) * F.col("_sign"))
    out = sums.groupBy("page_id", F.col("_key").alias(key)).agg(total("_n").alias("n"), total("_known").alias("_known"), total("_sum").alias("_sum"))
    return out.where("n > 0").select("page_id", key, "n", F.try_divide(F.col("_sum").cast("double"), F.col("_known")).alias("score"))


def candidate_cap(boxes: DataFrame, order: str, limit: int = 1000) -> DataFrame:
    """The first ``limit`` candidates of a page (a feature of the detector)."""
    return ranked(boxes, ["page_id"], [order], "_n").where(F.col("_n") <= limit).drop("_n")


def extract_boxes(
    boxes: DataFrame, bitmap: DataFrame, pages: DataFrame, dest: DataFrame, threshold: float = 0.5,
    box_threshold: float = 0.7, unclip: float = 2.3, min_size: float = 3.0, limit: int = 1000,
) -> DataFrame:
    """``boxes(page_id, quad_id, x, y, w, h)`` on a bitmap to scored page quads.

    Small boxes leave first, then those with a low mean score; the rest move
    outward, are scaled to ``dest(page_id, dest_w, dest_h)`` and put in order.
    """
    lit = filters.above(bitmap, "v", threshold).select("page_id").distinct()
    kept = filters.min_side(candidate_cap(boxes.join(lit, "page_id", "left_semi"), "quad_id", limit), "w", "h", min_size)
    quads = kept.withColumn("pts", G.box_quad(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    scores = region_scores(quads, bitmap, pages).drop("n")
    quads = quads.join(scores, ["page_id", "quad_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    quads = filters.box_threshold(quads, box_threshold)
    d = G.unclip_offset(F.col("w"), F.col("h"), unclip)
    quads = quads.withColumns({"x": F.col("x") - d, "y": F.col("y") - d, "w": F.col("w") + d * 2, "h": F.col("h") + d * 2})
    quads = filters.min_side(quads, "w", "h", min_size + 2)
    quads = quads.join(pages, "page_id").join(dest, "page_id")

    def place(v, size, to):
        return F.least(F.greatest(F.round(v / size * to), F.lit(0.0)), to.cast("double"))

    x0, x1 = (place(v, F.col("width"), F.col("dest_w")) for v in (F.col("x"), F.col("x") + F.col("w")))
    y0, y1 = (place(v, F.col("height"), F.col("dest_h")) for v in (F.col("y"), F.col("y") + F.col("h")))
    pts = F.array(G.point(x0, y0), G.point(x1, y0), G.point(x1, y1), G.point(x0, y1))
    # few rows are left; cutting here keeps the corner rewrites in compiled code
    out = cut_lineage(quads.select("page_id", "quad_id", "score", pts.alias("pts")))
    out = cut_lineage(out.withColumn("pts", G.roll_to_origin(F.col("pts"))))
    return G.with_corner_order(filters.min_area(filters.non_zero(out)))
