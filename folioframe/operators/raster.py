"""Pixel statistics and rewrites on ``raster(page_id, y, x, ...)``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.session import broadcast_if_small

_PX = ["page_id", "y", "x"]


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def page_sizes(raster: DataFrame) -> DataFrame:
    return raster.groupBy("page_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def byte(v: Column) -> Column:
    return F.least(F.greatest(F.round(v), F.lit(0.0)), F.lit(255.0)).cast("bigint")


def gamma_correct(rgb: DataFrame) -> DataFrame:
    """Bring the mean luma of every page to the middle; one number per page moves."""
    mean = rgb.groupBy("page_id").agg(F.avg(luma(F.col("r"), F.col("g"), F.col("b"))).alias("_m"))
    mean = mean.withColumn("gamma", F.lit(math.log(127.5)) / F.log("_m")).drop("_m")
    fix = lambda c: byte(F.pow(F.col(c) / 255.0, F.col("gamma")) * 255.0).alias(c)
    return rgb.join(broadcast_if_small(mean), "page_id").select(*_PX, fix("r"), fix("g"), fix("b"))


def histogram_cdf(values: DataFrame, column: str) -> DataFrame:
    """Counts, running counts and the first running count per page (256 rows at most)."""
    hist = values.groupBy("page_id", column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("page_id").orderBy(column)
    cdf = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hist = hist.withColumn("cdf", cdf)
    page = Window.partitionBy("page_id")
    return hist.withColumns({"cdf_min": F.min("cdf").over(page), "total": F.max("cdf").over(page)})


def equalize(rgb: DataFrame) -> DataFrame:
    """Histogram equalisation of the brightness, colours kept."""
    r, g, b = (F.col(c) for c in "rgb")
    yuv = rgb.select(
        *_PX, byte(luma(r, g, b)).alias("l"),
        byte(r * -0.169 - g * 0.331 + b * 0.5 + 128.0).alias("u"), byte(r * 0.5 - g * 0.419 - b * 0.081 + 128.0).alias("v"))
    cdf = histogram_cdf(yuv, "l")
    scale = F.lit(255.0) / F.greatest(F.col("total") - F.col("cdf_min"), F.lit(1))
    lut = cdf.select("page_id", "l", byte((F.col("cdf") - F.col("cdf_min")) * scale).alias("e"))
    e, u, v = F.col("e"), F.col("u") - 128.0, F.col("v") - 128.0
    return yuv.join(broadcast_if_small(lut), ["page_id", "l"]).select(
        *_PX, byte(e + v * 1.402).alias("r"), byte(e - u * 0.344136 - v * 0.714136).alias("g"), byte(e + u * 1.772).alias("b"))


def invert(df: DataFrame, *channels: str) -> DataFrame:
    return df.withColumns({c: F.lit(255) - F.col(c) for c in channels})


# --- coordinates ------------------------------------------------------------


def padded_size(width: Column, height: Column, to_w: int, to_h: int) -> tuple[Column, Column]:
    """Size after padding; a page larger in both directions stays as it is."""
    same = (width > to_w) & (height > to_h)
    return (F.when(same, width).otherwise(F.greatest(width, F.lit(to_w))),
            F.when(same, height).otherwise(F.greatest(height, F.lit(to_h))))


def pad_center(raster: DataFrame, pages: DataFrame, side: int) -> DataFrame:
    """Move pixels so that the page sits in the middle of a square."""
    full = F.greatest(F.col("width"), F.col("height"), F.lit(side))
    j = raster.join(broadcast_if_small(pages), "page_id")
    return j.withColumns({
        "x": F.col("x") + F.floor((full - F.col("width")) / F.lit(2)), "y": F.col("y") + F.floor((full - F.col("height")) / F.lit(2))
    }).drop("width", "height")


def crop(raster: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return raster.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def rotate_right(raster: DataFrame, pages: DataFrame) -> DataFrame:
    j = raster.join(broadcast_if_small(pages), "page_id")
    return j.withColumns({"y": F.col("x"), "x": F.col("height") - 1 - F.col("y")}).drop("width", "height")


def rotate_left(raster: DataFrame, pages: DataFrame) -> DataFrame:
    j = raster.join(broadcast_if_small(pages), "page_id")
    return j.withColumns({"y": F.col("width") - 1 - F.col("x"), "x": F.col("y")}).drop("width", "height")


def transpose(raster: DataFrame) -> DataFrame:
    return raster.withColumns({"y": F.col("x"), "x": F.col("y")})


def resize_nearest(raster: DataFrame, pages: DataFrame, to_w: int, to_h: int) -> DataFrame:
    """Every source pixel is copied to the target cells that map back to it."""
    def cells(v, size, to):
        first = F.ceil(v * F.lit(to) / size).cast("bigint")
        last = F.ceil((v + 1) * F.lit(to) / size).cast("bigint") - 1
        return F.when(first <= last, F.sequence(first, last))

    j = raster.join(broadcast_if_small(pages), "page_id")
    j = j.withColumn("_y", F.explode(cells(F.col("y"), F.col("height"), to_h)))
    j = j.withColumn("_x", F.explode(cells(F.col("x"), F.col("width"), to_w)))
    return j.withColumns({"y": F.col("_y"), "x": F.col("_x")}).drop("_x", "_y", "width", "height")


def resize_box(raster: DataFrame, factor: int, value: str = "v") -> DataFrame:
    """Mean of factor x factor blocks."""
    cell = lambda c: F.floor(F.col(c) / F.lit(factor)).cast("bigint").alias(c)
    return raster.groupBy("page_id", cell("y"), cell("x")).agg(F.avg(value).alias(value))


def swap_channels(rgb: DataFrame) -> DataFrame:
    return rgb.withColumns({"r": F.col("b"), "b": F.col("r")})


def split_channels(rgb: DataFrame) -> DataFrame:
    """Three one-channel planes."""
    return rgb.select(*_PX, F.inline(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in "rgb"])))


# --- page tests -------------------------------------------------------------


def border_black_ratio(crops: DataFrame, key: list[str], frame: int = 2) -> DataFrame:
    """Share of dark pixels, in percent, in the frame of every crop.

    ``crops`` holds ``key, y, x, v`` and the crop's ``width, height``, with
    coordinates relative to the crop.
    """
    edge = (F.col("x") < frame) | (F.col("y") < frame) | (F.col("x") >= F.col("width") - frame) | (F.col("y") >= F.col("height") - frame)
    dark = F.count_if(F.col("v") <= 127)
    return crops.where(edge).groupBy(*key).agg((F.round(dark / F.count(F.lit(1)), 6) * 100).alias("black"))


def color_test(rgb: DataFrame, key: list[str]) -> DataFrame:
    """Whether more than ten pixels differ visibly from their grey."""
    gray = luma(F.col("r"), F.col("g"), F.col("b"))
    off = sum(((F.col(c) - gray) * (F.col(c) - gray) for c in "rgb"), F.lit(0.0))
    return rgb.groupBy(*key).agg((F.count_if(off > 100.0) > 10).alias("colored"))


def ignore_region(crops: DataFrame, key: list[str], bubble: int) -> DataFrame:
    """Regions that are no speech bubble: mixed frame, or coloured."""
    black = border_black_ratio(crops.withColumn("v", byte(luma(F.col("r"), F.col("g"), F.col("b")))), key)
    mixed = F.col("black").between(bubble, 100 - bubble) if 1 <= bubble <= 50 else F.lit(False)
    both = black.join(color_test(crops, key), key)
    ignore = (mixed | F.col("colored")) if 1 <= bubble <= 50 else F.lit(False)
    return both.select(*key, "black", "colored", ignore.alias("ignore"))


# --- tiles and strips -------------------------------------------------------


def split_tiles(raster: DataFrame, size: int, margin: int) -> DataFrame:
    """Tiles of ``size`` with a margin; a pixel near an edge is in several tiles."""
    def tiles(c, limit):
        low = F.floor((F.col(c) - margin) / F.lit(size)).cast("bigint")
        high = F.floor((F.col(c) + margin) / F.lit(size)).cast("bigint")
        return F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.floor((limit - 1) / F.lit(size)).cast("bigint")))

    return (
        raster.withColumn("tile_y", F.explode(tiles("y", F.col("height"))))
        .withColumn("tile_x", F.explode(tiles("x", F.col("width"))))
        .withColumns({"ty": F.col("y") - F.col("tile_y") * size + margin, "tx": F.col("x") - F.col("tile_x") * size + margin})
        .drop("y", "x")
    )


def merge_tiles(tiles: DataFrame, size: int, margin: int) -> DataFrame:
    """Crop the margins and put the tiles back together."""
    inner = F.col("ty").between(margin, margin + size - 1) & F.col("tx").between(margin, margin + size - 1)
    return tiles.where(inner).withColumns({
        "y": F.col("tile_y") * size + F.col("ty") - margin, "x": F.col("tile_x") * size + F.col("tx") - margin,
    }).drop("ty", "tx", "tile_y", "tile_x")


def merge_strips(strips: DataFrame, value: str = "v") -> DataFrame:
    """Mean of the strips over every pixel: ``(page_id, top, sy, x, v)`` to pages."""
    return strips.groupBy("page_id", (F.col("top") + F.col("sy")).alias("y"), "x").agg(F.avg(value).alias(value))


# --- blending ---------------------------------------------------------------


def blend_over(base: DataFrame, over: DataFrame) -> DataFrame:
    """RGBA over RGB; pixels without an overlay stay."""
    o = over.select(*_PX, *[F.col(c).alias(f"_{c}") for c in "rgba"])
    a = F.col("_a") / 255.0
    mix = lambda c: F.when(F.col("_a").isNull(), F.col(c)).otherwise(
        byte(F.col(f"_{c}") * a + F.col(c) * (F.lit(1.0) - a))).alias(c)
    return base.join(o, _PX, "left").select(*_PX, mix("r"), mix("g"), mix("b"))


def blend_alpha(base: DataFrame, over: DataFrame) -> DataFrame:
    """RGBA over RGBA."""
    o = over.select(*_PX, *[F.col(c).alias(f"_{c}") for c in "rgba"])
    sa, oa = F.col("a") / 255.0, F.col("_a") / 255.0
    rest = sa * (F.lit(1.0) - oa)
    out = oa + rest
    mix = lambda c: (
        F.when(F.col("_a").isNull(), F.col(c)).when(F.col("_a") == 255, F.col(f"_{c}"))
        .otherwise(F.coalesce(byte(F.try_divide(F.col(f"_{c}") * oa + F.col(c) * rest, out)), F.lit(0))).alias(c))
    alpha = F.when(F.col("_a").isNull(), F.col("a")).when(F.col("_a") == 255, F.lit(255)).otherwise(byte(out * 255.0))
    return base.join(o, _PX, "left").select(*_PX, mix("r"), mix("g"), mix("b"), alpha.cast("bigint").alias("a"))


def constant_fill(mask: DataFrame, color: tuple[int, int, int]) -> DataFrame:
    """Overlay of one colour under a mask of pixels above 127."""
    return mask.where("v > 127").select(
        *_PX, *[F.lit(v).cast("bigint").alias(c) for c, v in zip("rgba", (*color, 255))])


def attach_alpha(rgb: DataFrame, mask: DataFrame) -> DataFrame:
    return rgb.join(mask.select(*_PX, F.col("v").alias("a")), _PX, "left").withColumn("a", F.coalesce("a", F.lit(0)))


def cut_out(page: DataFrame, overlay: DataFrame) -> DataFrame:
    """Copy the overlay where its alpha is above 128."""
    o = overlay.where("a > 128").select(*_PX, *[F.col(c).alias(f"_{c}") for c in "rgb"])
    return page.join(o, _PX, "left").select(*_PX, *[F.coalesce(f"_{c}", c).alias(c) for c in "rgb"])


# --- thresholds and histograms ----------------------------------------------


def in_range(df: DataFrame, low, high, value: str = "v") -> DataFrame:
    return df.where(F.col(value).between(low, high))


def otsu_threshold(values: DataFrame, key: list[str], value: str = "v") -> DataFrame:
    """Threshold with the largest between-class variance per key (lowest on a tie).

    Only 256 counts per key enter the windows.
    """
    hist = values.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*key).orderBy(value)
    run, whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*key)
    hist = hist.withColumns({
        "w0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col(value)).over(run),
        "wt": F.sum("n").over(whole), "st": F.sum(F.col("n") * F.col(value)).over(whole)})
    w1 = F.col("wt") - F.col("w0")
    gap = F.try_divide(F.col("s0").cast("double"), F.col("w0")) - F.try_divide((F.col("st") - F.col("s0")).cast("double"), w1)
    score = F.coalesce(F.round(F.col("w0") * w1 * gap * gap, 3), F.lit(0.0))
    return hist.groupBy(*key).agg(F.min_by(F.col(value), F.struct(-score, F.col(value))).alias("threshold"))


def xor_score(joined: DataFrame, key: list[str], a: Column, b: Column) -> DataFrame:
    """Sum of byte-wise differences, for the mask and for its inverse."""
    s = F.sum(a.cast("bigint").bitwiseXOR(b.cast("bigint")))
    n = F.sum((F.lit(255) - a).cast("bigint").bitwiseXOR(b.cast("bigint")))
    return joined.groupBy(*key).agg(s.alias("plain"), n.alias("inverse")).select(
        *key, F.least("plain", "inverse").alias("score"), (F.col("inverse") < F.col("plain")).alias("inverted"))


def gray_bins(values: DataFrame, key: list[str], value: str = "v", bins: int = 255) -> DataFrame:
    """Counts per grey bin, with the bin's lower grey."""
    b = F.floor(F.col(value) * bins / 256).cast("bigint")
    return values.groupBy(*key, b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "color", F.floor(F.col("bin") * 256 / F.lit(bins)).cast("bigint"))


def top_colors(bins: DataFrame, key: list[str], k: int = 3, var: int = 10, tol: float = 0.001) -> DataFrame:
    """Up to k colours that differ by more than ``var``, most frequent first.

    The fold sees at most 255 bins per key.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "bin", "color")))
    rows = bins.groupBy(*key).agg(order.alias("_b"), F.sum("n").alias("_t"))
    start = F.struct(F.array(F.col("_b")[0]["color"]).alias("c"), F.lit(False).alias("stop"))

    def step(s, e):
        apart = F.forall(s["c"], lambda c: F.abs(c - e["color"]) > var)
        take = ~s["stop"] & apart
        c = F.when(take, F.concat(s["c"], F.array(e["color"]))).otherwise(s["c"])
        stop = s["stop"] | (F.size(c) >= k) | (-e["m"] < F.col("_t") * tol)
        return F.struct(c.alias("c"), stop.alias("stop"))

    tail = F.slice("_b", F.lit(2), F.greatest(F.size("_b") - 1, F.lit(0)))
    return rows.select(*key, F.aggregate(tail, start, step)["c"].alias("colors"))


def weighted_sum(raster: DataFrame, kernel: list[list[float]], value: str = "v") -> DataFrame:
    """3x3 weighted sum around every pixel of the page, zero outside.

    Every pixel is sent to the nine pixels it contributes to and summed before
    the shuffle where neighbours share a task.
    """
    cells = [F.struct(F.lit(1 - i).alias("dy"), F.lit(1 - j).alias("dx"), F.lit(float(kernel[i][j])).alias("k"))
             for i in range(3) for j in range(3)]
    spread = raster.withColumn("_c", F.explode(F.array(*cells))).select(
        "page_id", (F.col("y") + F.col("_c.dy")).alias("y"), (F.col("x") + F.col("_c.dx")).alias("x"),
        (F.col(value) * F.col("_c.k")).alias("s"), ((F.col("_c.dy") == 0) & (F.col("_c.dx") == 0)).alias("own"))
    return spread.groupBy(*_PX).agg(F.sum("s").alias("s"), F.bool_or("own").alias("own")).where("own").drop("own")
