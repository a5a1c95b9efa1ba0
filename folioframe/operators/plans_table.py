"""Planning tables: target sizes and crops as projections on page and line sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import geometry as G


def _up_to(v: Column, step: int) -> Column:
    return (F.ceil(v / F.lit(step)) * step).cast("bigint")


def resize_plans(df: DataFrame, square: int, mag: float, letterbox: int, limit: int,
                 w: str = "w", h: str = "h", key: str = "panel_id") -> DataFrame:
    """Target sizes of every resize policy for pages of w x h pixels.

    ``aspect_*``: keep the aspect within ``square`` and pad to 256; ``mult_*``:
    pad to 8; ``letter_*``/``pad_*``: letterbox; ``square_pad_*``: pad to a
    square; ``limit_side``: longest side allowed; ``fit_scale``: mask scale.
    """
    w, h = F.col(w), F.col(h)
    side = F.greatest(w, h)
    ratio = F.lit(float(min(square * mag, square))) / side
    letter = F.least(F.lit(float(letterbox)) / w, F.lit(float(letterbox)) / h)
    lw, lh = F.round(w * letter).cast("bigint"), F.round(h * letter).cast("bigint")
    return df.select(
        key,
        F.round(ratio, 6).alias("ratio"),
        _up_to(F.round(w * ratio), 256).alias("aspect_w"), _up_to(F.round(h * ratio), 256).alias("aspect_h"),
        _up_to(w, 8).alias("mult_w"), _up_to(h, 8).alias("mult_h"),
        lw.alias("letter_w"), lh.alias("letter_h"), (letterbox - lw).alias("pad_w"), (letterbox - lh).alias("pad_h"),
        F.greatest(F.lit(0), h - w).alias("square_pad_w"), F.greatest(F.lit(0), w - h).alias("square_pad_h"),
        F.least(F.lit(limit), side).alias("limit_side"),
        F.round(F.least(F.greatest((h - h / F.lit(3.0)) / h, F.lit(0.5)), F.lit(1.0)), 6).alias("fit_scale"),
    )


def crop_plan(df: DataFrame, page_w: Column, page_h: Column, text_height: int) -> DataFrame:
    """Clamped crop and target size per line; vertical lines swap the sides."""
    x0, y0, x1, y1 = G.bounds(F.col("pts"))
    v1x, v1y, v2x, v2y = G.axes(F.col("pts"))
    ratio = F.try_divide(G.hypot(v1x, v1y), G.hypot(v2x, v2y))
    low = F.lit(max(text_height, 2)).cast("bigint")
    across = F.greatest(F.lit(2), F.round(text_height / ratio).cast("bigint"))
    down = F.greatest(F.lit(2), F.round(text_height * ratio).cast("bigint"))
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0)), top)
    return df.select(
        "quad_id", clamp(x0, page_w).alias("x1"), clamp(y0, page_h).alias("y1"),
        clamp(x1, page_w).alias("x2"), clamp(y1, page_h).alias("y2"),
        F.when(F.col("vertical"), low).otherwise(across).alias("out_w"),
        F.when(F.col("vertical"), down).otherwise(low).alias("out_h"),
    )


def strip_plan(df: DataFrame, target: int, w: str = "w", h: str = "h") -> DataFrame:
    """Pages that need strip tiling, one row per strip (long side as height)."""
    long, short = F.greatest(F.col(w), F.col(h)), F.least(F.col(w), F.col(h))
    df = df.withColumns({"long_side": long, "short_side": short}).where(needs_strips(long, short, target))
    per = F.greatest(F.lit(2), F.floor(F.lit(2.0 * target) / F.col("short_side"))).cast("bigint")
    df = df.withColumn("patch_h", per * F.col("short_side"))
    df = df.withColumn("strips", F.ceil(F.col("long_side") / F.col("patch_h")).cast("bigint"))
    step = F.when(F.col("strips") > 1, ((F.col("long_side") - F.col("patch_h")) / (F.col("strips") - 1)).cast("bigint")).otherwise(F.lit(0))
    return (
        df.withColumn("step", step)
        .withColumn("strip", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("strips") - 1)))
        .withColumn("top", F.col("strip") * F.col("step"))
        .withColumn("bottom", F.least(F.col("top") + F.col("patch_h"), F.col("long_side")))
    )


def needs_strips(long: Column, short: Column, target: int) -> Column:
    return (long / F.lit(float(target)) > 2.5) & (long / short > 3)
