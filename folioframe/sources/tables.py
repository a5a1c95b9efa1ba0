"""Stage tables, settings, dictionaries, vocabularies and the integrity audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators.translate import parse_dictionary


def save_stage(df: DataFrame, folder: str, stage: str, fmt: str = "parquet") -> None:
    """Write the table of a stage; JSON keeps nested values readable."""
    df.write.mode("overwrite").format(fmt).save(f"{folder}/{stage}")


def load_stage(spark: SparkSession, folder: str, stage: str, schema=None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(f"{folder}/{stage}")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one small text file with their number from 1."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("i", "value")).withColumn("line_no", F.col("i") + 1).drop("i")


def read_dictionary(spark: SparkSession, path: str | None = None, inline: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rules and rejected lines of a dictionary file or of inline text."""
    if inline is not None:
        lines = spark.createDataFrame(list(enumerate(inline.splitlines(), 1)), "line_no int, value string")
    else:
        lines = _numbered_lines(spark, path)
    return parse_dictionary(lines)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """One token per line; the id is the line index from 0."""
    lines = _numbered_lines(spark, path)
    last = F.max("line_no").over(Window.partitionBy())
    lines = lines.withColumn("_last", last).where(~((F.col("line_no") == F.col("_last")) & (F.col("value") == "")))
    return lines.select((F.col("line_no") - 1).cast("bigint").alias("token"), F.col("value").alias("piece"))


# Settings with their defaults, group.field -> (type, default).
SETTINGS = {
    "upscaler": {"upscaler": ("string", None), "patch_size": ("int", None), "padding": ("int", 0)},
    "detector": {"detector": ("string", "DBNet"), "detect_size": ("int", 2048), "unclip_ratio": ("double", 2.3),
                 "text_threshold": ("double", 0.5), "box_threshold": ("double", 0.7)},
    "ocr": {"ocr": ("string", "Ocr48px"), "min_text_length": ("int", 1), "filter_text": ("array<string>", []), "prob": ("double", 0.2)},
    "mask_refinement": {"ignore_bubble": ("int", 0), "dilation_offset": ("double", 20.0), "kernel_size": ("int", 3),
                        "furigana": ("boolean", False), "method": ("string", "FitText")},
    "inpainter": {"inpainter": ("string", "LamaAot"), "inpainting_size": ("int", 2048),
                  "inpaint_color": ("array<int>", [255, 255, 255]), "mask": ("string", "RefinedMask")},
    "translator": {"filter_lang": ("array<string>", []), "pre_dict": ("string", None), "post_dict": ("string", None)},
    "render": {"renderer": ("string", "Raw")},
}


def settings_schema() -> str:
    """DDL of the settings JSON; the detector nests its options one level deeper."""
    groups = []
    for group, fields in SETTINGS.items():
        if group == "detector":
            inner = ",".join(f"{n}:{t}" for n, (t, _) in fields.items() if n != "detector")
            groups.append(f"detector struct<detector:string,options:struct<{inner}>>")
        else:
            groups.append(f"{group} struct<{','.join(f'{n}:{t}' for n, (t, _) in fields.items())}>")
    return ", ".join(groups)


def _default(value, kind: str) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def parse_settings(df: DataFrame, column: str = "value") -> DataFrame:
    """Settings JSON to one struct per group; whatever is missing gets its default."""
    parsed = df.withColumn("_s", F.from_json(F.col(column), settings_schema()))
    groups = {}
    for group, fields in SETTINGS.items():
        cols = []
        for name, (kind, value) in fields.items():
            path = f"_s.detector.options.{name}" if group == "detector" and name != "detector" else f"_s.{group}.{name}"
            cols.append(F.coalesce(F.col(path), _default(value, kind)).alias(name))
        groups[group] = F.struct(*cols)
    return parsed.withColumns(groups).drop("_s")


# --- integrity --------------------------------------------------------------

#: Fixed value: a manifest entry with this hash is not checked.
UNCHECKED = "###"


def audit(files: DataFrame, manifest: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Compare files and folders with a manifest ``(path, expected)``.

    ``files(path, content)`` is hashed once per row.  A folder's hash is the hash
    of its sorted relative paths and file hashes, so content never meets in one
    place; it differs from a hash over the joined bytes.  ``known(path, hash)``
    holds hashes of an earlier audit, and those files are not read again.
    """
    if known is not None:
        fresh = files.join(known.select("path"), "path", "left_anti")
        hashes = fresh.select("path", F.sha2("content", 256).alias("hash")).unionByName(known.select("path", "hash"))
    else:
        hashes = files.select("path", F.sha2("content", 256).alias("hash"))
    # every ancestor folder of a file, so that folders join on equality too
    parts = F.split("path", "/")
    folders = hashes.select("path", "hash", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder"))
    folders = folders.where("folder <> path AND folder <> ''").join(
        manifest.select(F.col("path").alias("folder")).distinct(), "folder")
    rel = F.substr("path", F.length("folder") + 2)
    digest = folders.groupBy("folder").agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rel.alias("p"), "hash"))), lambda e: F.concat(e["p"], e["hash"])), ""), 256).alias("hash"))
    found = hashes.unionByName(digest.select(F.col("folder").alias("path"), "hash"))
    status = (
        F.when(F.col("hash").isNull(), F.lit("missing"))
        .when(F.col("expected") == UNCHECKED, F.lit("unchecked"))
        .when(F.col("hash") == F.col("expected"), F.lit("ok")).otherwise(F.lit("mismatch")))
    return manifest.join(found, "path", "left").withColumn("status", status).withColumn(
        "failure", F.col("status").isin("missing", "mismatch"))


# --- exports ----------------------------------------------------------------


def page_export(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per page with its ordered blocks (and page columns)."""
    item = F.struct("block_id", *[c for c in blocks.columns if c not in ("page_id", "block_id")])
    # a map cannot be sorted, so the order key is kept apart
    packed = blocks.groupBy("page_id").agg(F.collect_list(item).alias("blocks")).withColumn(
        "blocks", F.array_sort("blocks", lambda a, b: F.when(a["block_id"] < b["block_id"], -1).when(a["block_id"] > b["block_id"], 1).otherwise(0)))
    return packed if pages is None else pages.join(packed, "page_id", "left")


def overlay_items(blocks: DataFrame) -> DataFrame:
    """Blocks with ``obb`` and ``translations`` to ``(page_id, overlays)`` JSON."""
    from folioframe.functions import geometry as G

    o = F.col("obb")
    left, top = G.obb_top_left(o["x"], o["y"], o["w"], o["h"], o["theta"])
    u32 = lambda c: T.saturate(c, 4294967295)
    black, white = F.array(*[F.lit(0).cast("smallint")] * 3), F.array(*[F.lit(255).cast("smallint")] * 3)
    item = F.struct(
        F.col("block_id").alias("k"), u32(left).alias("x"), u32(top).alias("y"), u32(o["w"]).alias("width"), u32(o["h"]).alias("height"),
        u32(F.degrees(o["theta"])).alias("rotation"), F.coalesce("fg", black).alias("color"),
        F.coalesce("bg", white).alias("shadow"), T.display_text(F.col("translations"), F.col("text")).alias("text"))
    # a blank text is not rendered
    shown = blocks.where(T.strip(T.display_text(F.col("translations"), F.col("text"))) != "")
    rows = shown.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("i"))
    public = F.transform("i", lambda e: F.struct(*[e[c].alias(c) for c in ("x", "y", "width", "height", "rotation", "color", "shadow", "text")]))
    return rows.select("page_id", F.to_json(public).alias("overlays"))


def html_pages(overlays: DataFrame, font: str = "arial") -> DataFrame:
    """One HTML fragment per page, the overlay list as an escaped attribute."""
    body = F.concat(
        F.lit('<div class="canvas-wrapper" style="--ui-font-family: '), T.html_escape(F.lit(font)),
        F.lit(";\" data-overlays='"), T.html_escape(F.col("overlays")),
        F.lit("'><img class=\"base-image\" src=\"./"), F.col("page_id").cast("string"), F.lit('.png" alt="Image" /></div>'))
    return overlays.select("page_id", body.alias("value"))


def write_output(blocks: DataFrame, folder: str, renderer: str) -> None:
    """Write by renderer: ``raw`` as nested Parquet, ``json``, or ``html`` as (page_id, value) rows in few files."""
    kind = renderer.lower()
    if kind in ("raw", "mit", "mit.bin"):
        page_export(blocks).write.mode("overwrite").parquet(folder)
    elif kind == "json":
        page_export(blocks).write.mode("overwrite").json(folder)
    elif kind == "html":
        html_pages(overlay_items(blocks)).write.mode("overwrite").parquet(folder)
    else:
        raise ValueError(f"no sink for renderer {renderer!r}")
