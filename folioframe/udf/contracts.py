"""Where models plug in: batch functions over Arrow batches.

A model function gets a pandas frame and returns one.  It is loaded once per
Python worker and reused for every batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import mask as M
from folioframe.operators import translate as X
from folioframe.operators.spatial import CELL, with_cells
from folioframe.session import cut_lineage

_LOADED: dict[tuple, object] = {}

QUAD_SCHEMA = "page_id bigint, quad_id bigint, pts array<struct<x:bigint,y:bigint>>, score double"
LINE_SCHEMA = "page_id bigint, quad_id bigint, text string, fg array<smallint>, bg array<smallint>, prob double"


def _identity(loader: Callable) -> str:
    """What tells loaders apart after they were sent to a worker: their pickled code, bound values and options."""
    return hashlib.sha256(cloudpickle.dumps(loader)).hexdigest()


def load_once(name: str, loader: Callable[[], object], identity: str | None = None) -> object:
    """The object ``loader`` makes, kept for the life of the worker; another loader of the same name makes its own."""
    key = name, identity or _identity(loader)
    if key not in _LOADED:
        _LOADED[key] = loader()
    return _LOADED[key]


def unload(name: str) -> None:
    for key in [k for k in _LOADED if k[0] == name]:
        del _LOADED[key]


def run_model(df: DataFrame, name: str, loader: Callable[[], Callable], schema: str, rows: int | None = None) -> DataFrame:
    """Apply a loaded batch function ``fn(frame) -> frame`` to every batch, in pieces of at most ``rows`` rows if given."""
    identity = _identity(loader)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_once(name, loader, identity)
        for batch in batches:
            for first in range(0, max(len(batch), 1), rows or max(len(batch), 1)):
                yield model(batch.iloc[first:first + rows].reset_index(drop=True) if rows else batch)

    return df.mapInPandas(run, schema)


def run_grouped(df: DataFrame, keys: list[str], order: list[str], name: str, loader: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply a loaded function ``fn(frame) -> frame`` to every group whole, whatever the size of Arrow batches."""
    identity = _identity(loader)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return load_once(name, loader, identity)(group.sort_values(order, ignore_index=True) if order else group)

    return df.groupBy(*keys).applyInPandas(run, schema)


def detect(pages: DataFrame, loader, name: str = "detector") -> DataFrame:
    """Pages to quads."""
    return run_model(pages, name, loader, QUAD_SCHEMA)


def detect_with_mask(pages: DataFrame, loader, name: str = "detector") -> tuple[DataFrame, DataFrame]:
    """Pages to quads and to the runs of the text mask; the model returns both frames for a batch.

    Both go through one pass, written once, as rows that are either a quad or a run.
    """
    identity = _identity(loader)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_once(name, loader, identity)
        for batch in batches:
            quads, runs = model(batch)
            for part in (quads.assign(y=None, x0=None, x1=None), runs.assign(quad_id=None, pts=None, score=None)):
                if len(part):
                    yield part[["page_id", "quad_id", "pts", "score", "y", "x0", "x1"]]

    out = cut_lineage(pages.mapInPandas(run, QUAD_SCHEMA + ", y bigint, x0 bigint, x1 bigint"))
    return out.where("quad_id IS NOT NULL").select("page_id", "quad_id", "pts", "score"), out.where("y IS NOT NULL").select("page_id", "y", "x0", "x1")


def with_crops(lines: DataFrame, pixels: DataFrame) -> DataFrame:
    """Add ``crop``, the ordered pixels ``(y, x, v)`` under the box ``bx, by, bw, bh`` of every line.

    A pixel meets the lines of its grid cell only; a crop is bounded by its line.
    """
    box = lines.select("page_id", "quad_id", "bx", "by", "bw", "bh")
    cells = with_cells(box, F.col("bx"), F.col("by"), F.col("bx") + F.col("bw") - 1, F.col("by") + F.col("bh") - 1).drop("_x0", "_y0", "_x1", "_y1")
    at = lambda c: F.floor(F.col(c) / F.lit(CELL)).cast("bigint")
    px = pixels.select("page_id", "y", "x", "v").withColumns({"_cx": at("x"), "_cy": at("y")}).join(cells, ["page_id", "_cx", "_cy"])
    px = px.where("x >= bx AND x < bx + bw AND y >= by AND y < by + bh")
    crops = px.groupBy("page_id", "quad_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("crop"))
    return lines.join(crops, ["page_id", "quad_id"], "left")


def recognise(batches: DataFrame, loader, name: str = "ocr", pixels: DataFrame | None = None) -> DataFrame:
    """Lines of width-sorted batches to texts; a batch reaches the model whole, with the crops of its lines if pixels are given."""
    batches = batches if pixels is None else with_crops(batches, pixels)
    out = run_grouped(batches, ["page_id", "batch"], ["strip", "quad_id"], name, loader, LINE_SCHEMA)
    return out.withColumn("prob", F.coalesce("prob", F.lit(1.0)))


def inpaint(pixels: DataFrame, loader, schema: str, name: str = "inpainter", mask: DataFrame | None = None, unit: list[str] | None = None) -> DataFrame:
    """Pixels of a whole page, or of a whole tile named by ``unit``, to filled ones.

    With ``mask(page_id, y, x0, x1)`` runs, pixels carry ``masked``.
    """
    unit = unit or ["page_id"]
    if mask is not None:
        inside = M.to_pixels(mask).withColumn("masked", F.lit(True))
        pixels = pixels.join(inside, ["page_id", "y", "x"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
    return run_grouped(pixels, unit, ["y", "x"], name, loader, schema)


#: Pixels of the tiles that the upscaler gets at once, before they grow.
TILE_PIXELS = 1 << 17


def upscale(tiles: DataFrame, loader, size: int, name: str = "upscaler") -> DataFrame:
    """Tiles in, enlarged tiles out; a tile is bounded by its size, and so is what the model gets at once."""
    packed = tiles.groupBy("page_id", "tile_y", "tile_x").agg(
        F.sort_array(F.collect_list(F.struct("ty", "tx", "v"))).alias("px"))
    flat = packed.select("page_id", "tile_y", "tile_x", F.col("px.ty").alias("ty"), F.col("px.tx").alias("tx"), F.col("px.v").alias("v"))
    out = run_model(flat, name, loader, "page_id bigint, tile_y bigint, tile_x bigint, ty array<bigint>, tx array<bigint>, v array<bigint>",
                    rows=max(1, TILE_PIXELS // (size * size)))
    return out.select("page_id", "tile_y", "tile_x", F.inline(F.arrays_zip("ty", "tx", "v")))


def prompt_translate(df: DataFrame, group: list[str], order: list[str], client: Callable[[list[str]], list[tuple[int, str]]],
                     source: str, target: str, template: str, api_key: str, model: str, budget: int | None = None) -> DataFrame:
    """Numbered prompts through ``client``, replies as rows: one prompt per group, or as many as it takes to keep each within ``budget`` bytes.

    The client gets prompts and returns ``(http status, body)``; a status outside
    2xx becomes an error row of its group.
    """
    if not api_key.strip():
        raise ValueError("api key is required")
    if not model.strip():
        raise ValueError("model is required")
    prompts = X.numbered_prompt(df, group, order) if budget is None else X.prompts_by_budget(df, group, order, budget)
    key = group if budget is None else [*group, "prompt_no"]
    prompts = prompts if budget is None else prompts.withColumnRenamed("prompt", "prompt_no")
    prompts = prompts.withColumn("prompt", T.prompt(F.lit(template), F.lit(source), F.lit(target), F.col("texts"))).drop("texts")
    kinds = dict(prompts.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*key, "expected", *([] if budget is None else ["numbers"])]) + ", http int, content string"

    def run(batches):
        for batch in batches:
            replies = client(batch["prompt"].tolist())
            batch = batch.drop(columns="prompt")
            batch["http"] = [r[0] for r in replies]
            batch["content"] = [r[1] for r in replies]
            yield batch

    answers = prompts.mapInPandas(run, schema)
    good = F.col("http").between(200, 299)
    parsed = X.parse_numbered_reply(answers.where(good), key, numbers=None if budget is None else "numbers").drop("prompt_no")
    failed = answers.where(~good).select(
        *group, F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("string").alias("text"),
        F.concat(F.lit("request failed with "), F.col("http").cast("string")).alias("error"))
    return parsed.unionByName(failed)
