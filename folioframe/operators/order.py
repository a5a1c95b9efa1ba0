"""Reading order, OCR batches and page-level votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators import regions
from folioframe.operators.graph import connected_components
from folioframe.operators.ranking import ranked
from folioframe.operators.spatial import CELL, DIRECTION_RULE, grouping_edges


def reading_order(lines: DataFrame) -> DataFrame:
    """Number the lines of every region in reading order (``line_no`` from 1)."""
    direction = lines.groupBy("page_id", "region").agg(regions.majority_vertical().alias("_vert"))
    ordered = lines.join(direction, ["page_id", "region"])
    key = regions.reading_key(F.col("_vert"))
    return ranked(ordered, ["page_id", "region"], [key, "quad_id"], "line_no").drop("_vert")


def page_share(lines: DataFrame, column: str) -> DataFrame:
    """Share of a page total; the total is aggregated before it is joined back."""
    total = lines.groupBy("page_id").agg(F.sum(column).alias("_total"))
    return lines.join(total, "page_id").withColumn("share", F.try_divide(F.col(column), F.col("_total"))).drop("_total")


def direction_order(lines: DataFrame, cell: int = CELL) -> DataFrame:
    """Direction groups of lines with geometry, and the OCR order inside each."""
    grouped = connected_components(lines, grouping_edges(lines, DIRECTION_RULE, cell))
    votes = grouped.groupBy("page_id", "component").agg(
        (F.count_if(F.col("vertical")) > F.floor(F.count(F.lit(1)) / 2)).alias("vertical_group"))
    grouped = grouped.join(votes, ["page_id", "component"])
    key = F.when(F.col("vertical_group"), -(F.col("bx") + F.col("bw"))).otherwise(
        F.col("by") + (F.col("bh") / F.lit(2)).cast("bigint"))
    return ranked(grouped, ["page_id", "component"], [key, "quad_id"], "pos")


def width_batches(lines: DataFrame, vertical: Column, text_height: int, size: int, keep=()) -> DataFrame:
    """Batches of lines of similar strip length, padded to the longest one + 7."""
    strip = F.when(vertical, F.col("bh") * F.lit(float(text_height)) / F.col("bw")).otherwise(
        F.col("bw") * F.lit(float(text_height)) / F.col("bh")).cast("bigint")
    numbered = ranked(lines.select("page_id", "quad_id", strip.alias("strip"), *keep), ["page_id"], ["strip", "quad_id"], "_n")
    numbered = numbered.withColumn("batch", ((F.col("_n") - 1) / F.lit(size)).cast("bigint")).drop("_n")
    pad = F.max("strip").over(Window.partitionBy("page_id", "batch")) + F.lit(7)
    return numbered.withColumn("pad_width", pad)


def meter(column: str) -> Column:
    """Mean of a column, 0 without rows."""
    return F.coalesce(F.round(F.avg(column), 6), F.lit(0.0))


def rotation_vote(pages: DataFrame, quads: DataFrame) -> DataFrame:
    """Pages without quads, or with at least half of them wide, ask for a turn."""
    votes = quads.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("aspect") > 1).alias("wide"))
    return pages.join(votes, "page_id", "left").select(
        "page_id", (F.col("n").isNull() | (F.col("wide") * 2 >= F.col("n"))).alias("rotate"))
