"""Sources, sinks, jobs, model contracts and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.operators import blocks as B
from folioframe.operators import jobs as J
from folioframe.operators import mask as M
from folioframe.operators import order, regions
from folioframe.operators import raster as R
from folioframe.plans.raster_queries import RAS, RGB
from folioframe.plans.registry import query
from folioframe.plans.sqltext import BLOCKS_SQL, BOX_LINES
from folioframe.plans.views import ctes, table, textlines, view
from folioframe.session import cut_lineage, ensure_checkpoint_dir
from folioframe.sources import pages as P
from folioframe.sources import tables as S
from folioframe.streaming import jobs as ST
from folioframe.udf import contracts as U


def scratch(spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# paths of a mixed input folder, one per event
_FILES = """f AS (SELECT event_id, ts, concat('in/', event_type, '/', CASE WHEN event_id % 11 = 0 THEN '.' ELSE '' END, 'u', user_id, '.',
 CASE event_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'webp' WHEN 3 THEN 'txt' WHEN 4 THEN 'html' ELSE 'bin' END) AS path FROM events)"""


def _files(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id", "ts AS modificationTime", """concat('in/', event_type, '/', CASE WHEN event_id % 11 = 0 THEN '.' ELSE '' END, 'u', user_id, '.',
        CASE event_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'webp' WHEN 3 THEN 'txt' WHEN 4 THEN 'html' ELSE 'bin' END) AS path""")


@query("s1_page_scan", sql=f"WITH {_FILES} SELECT event_id, substring(path, 4) AS rel_path FROM f WHERE event_id % 6 < 3 AND event_id % 11 <> 0")
def s1_page_scan(spark, sf):
    return P.page_files(_files(spark, sf), "in/").select("event_id", "rel_path")


@query("s2_t9_expand_inputs", sql=f"WITH {_FILES} SELECT DISTINCT path FROM f")
def s2_t9_expand_inputs(spark, sf):
    files = _files(spark, sf)
    return P.expand_inputs(files.where("event_id % 2 = 0"), files)


@query("s3_j20_pending_pages", sql=f"""WITH {_FILES}, d AS (SELECT DISTINCT regexp_replace(path, '\\.[^.]*$', '.html') AS path FROM f WHERE event_id % 13 = 0)
SELECT event_id FROM f WHERE event_id % 6 < 3 AND event_id % 11 <> 0 AND regexp_replace(path, '\\.[^.]*$', '.html') NOT IN (SELECT path FROM d)""")
def s3_j20_pending_pages(spark, sf):
    files = _files(spark, sf)
    done = files.where("event_id % 13 = 0").select(F.concat(P.directory(F.col("path")), F.lit("/"), P.stem(F.col("path")), F.lit(".html")).alias("path"))
    return P.pending(P.page_files(files), done, "html").select("event_id")


@query("s12_t6_results", sql=f"WITH {_FILES} SELECT event_id, ts AS mtime FROM f WHERE event_id % 6 IN (0, 4, 5)")
def s12_t6_results(spark, sf):
    return P.results(_files(spark, sf)).select("event_id", F.col("modificationTime").alias("mtime"))


@query("s13_w11_unique_names", sql=f"""WITH {_FILES}, n AS (SELECT event_id, regexp_extract(path, '[^/]*$') AS name, row_number() OVER (PARTITION BY regexp_extract(path, '[^/]*$') ORDER BY path, event_id) - 1 AS k FROM f)
SELECT event_id, CASE WHEN k = 0 THEN name ELSE regexp_replace(name, '(\\.[^.]*)$', '_' || k || '\\1') END AS target FROM n""")
def s13_w11_unique_names(spark, sf):
    files = _files(spark, sf).withColumn("path", F.concat("path", F.lit("")))
    # paths repeat here, so the event number makes the order total
    dirs = files.select("event_id", F.concat(P.directory(F.col("path")), F.lit("/"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit("/"), P.file_name(F.col("path"))).alias("path"))
    return P.unique_names(dirs).select("event_id", "target")


@query("s4_raw_raster", sql=RAS + " SELECT page_id, y, x, v FROM raster")
def s4_raw_raster(spark, sf):
    px = view(spark, sf, "raster")
    images = P.write_raw(px, R.page_sizes(px), ("v",))
    return P.read_raw(images).select("page_id", "y", "x", F.col("values")[0].cast("bigint").alias("v"))


@query("s4_raw_raster_rgb", sql=RGB + " SELECT page_id, y, x, r, g, b FROM rgb")
def s4_raw_raster_rgb(spark, sf):
    px = view(spark, sf, "rgb")
    images = P.write_raw(px, R.page_sizes(px), ("r", "g", "b"), dim_bytes=4)
    out = P.read_raw(images, dim_bytes=4)
    return out.select("page_id", "y", "x", *[F.col("values")[i].cast("bigint").alias(c) for i, c in enumerate("rgb")])


@query("s5_stage_tables", sql=BOX_LINES + " SELECT page_id, quad_id, x0, y2, round(score, 6) AS score FROM boxes")
def s5_stage_tables(spark, sf):
    df, folder = textlines(spark, sf).select("page_id", "quad_id", "pts", "score"), scratch(spark, "stages")
    S.save_stage(df, folder, "quads", "json")
    back = S.load_stage(spark, folder, "quads", df.schema, "json")
    return back.select("page_id", "quad_id", F.col("pts")[0]["x"].alias("x0"), F.col("pts")[2]["y"].alias("y2"), F.round("score", 6).alias("score"))


# the JSON of an event becomes a settings file with one or two values set
@query("s7_settings", sql="""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) ELSE 2048 END AS detect_size, 2.3::DOUBLE AS unclip_ratio,
 CASE WHEN event_id % 3 = 1 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS prob, CASE WHEN event_id % 3 = 1 THEN 7 ELSE 1 END AS min_text_length, 'FitText' AS method, 255 AS color0 FROM events""")
def s7_settings(spark, sf):
    k = F.get_json_object("props", "$.k")
    value = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"detector": {"options": {"detect_size": '), k, F.lit("}}}")))
        .when(F.col("event_id") % 3 == 1, F.lit('{"ocr": {"prob": 0.5, "min_text_length": 7}, "render": {}}')).otherwise(F.lit("broken"))
    )
    s = S.parse_settings(table(spark, sf, "events").select("event_id", value.alias("value")))
    return s.select("event_id", "detector.detect_size", "detector.unclip_ratio", "ocr.prob", "ocr.min_text_length", "mask_refinement.method",
                    F.col("inpainter.inpaint_color")[0].alias("color0"))


@query("s9_integrity_audit", sql="""
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 5 = 1 THEN 'mismatch' WHEN page_id % 5 = 2 THEN 'unchecked' ELSE 'ok' END AS status, page_id % 5 < 2 AS failure FROM pages""")
def s9_integrity_audit(spark, sf):
    pages = table(spark, sf, "pages")
    path = F.concat(F.lit("m/"), (F.col("page_id") % 9).cast("string"), F.lit("/p"), F.col("page_id").cast("string"))
    content = F.encode("html", "UTF-8")
    k = F.col("page_id") % 5
    expected = F.when(k == 1, F.lit("0")).when(k == 2, F.lit("###")).otherwise(F.sha2(content, 256))
    files = pages.where(k != 0).select(path.alias("path"), content.alias("content"))
    manifest = pages.select("page_id", path.alias("path"), expected.alias("expected"))
    return S.audit(files, manifest).select("page_id", "status", "failure")


@query("s9_folder_audit", sql="""
SELECT page_id % 9 AS folder, sha256(string_agg('p' || page_id || sha256(html), '' ORDER BY 'p' || page_id)) AS hash FROM pages GROUP BY page_id % 9""")
def s9_folder_audit(spark, sf):
    pages = table(spark, sf, "pages")
    folder = F.concat(F.lit("m/"), (F.col("page_id") % 9).cast("string"))
    files = pages.select(F.concat(folder, F.lit("/p"), F.col("page_id").cast("string")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    manifest = pages.select((F.col("page_id") % 9).alias("folder"), folder.alias("path")).distinct().withColumn("expected", F.lit("###"))
    return S.audit(files, manifest).select("folder", "hash")


def _merged(spark, sf):
    return regions.merge_regions(textlines(spark, sf))


@query("s10_a24_page_export", sql=BLOCKS_SQL + " SELECT page_id, count(*) AS n_blocks, min(region) AS first_block, sum(n_lines) AS n_lines FROM blk WHERE regexp_matches(text, '\\p{L}') GROUP BY page_id")
def s10_a24_page_export(spark, sf):
    folder = scratch(spark, "export")
    S.page_export(_merged(spark, sf)).write.parquet(folder)
    back = spark.read.parquet(folder)
    total = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda a, b: a + b["n_lines"])
    return back.select("page_id", F.size("blocks").alias("n_blocks"), F.col("blocks")[0]["block_id"].alias("first_block"), total.alias("n_lines"))


@query("s11_html_overlays", sql=ctes("textlines") + """
SELECT page_id, count(*) AS n, min(x) AS x, max(w) AS w, sum(length(text)) AS chars FROM textlines GROUP BY page_id""")
def s11_html_overlays(spark, sf):
    lines = textlines(spark, sf).select("page_id", F.col("quad_id").alias("block_id"), F.array("pts").alias("lines"), "text", "fg", "bg")
    blocks = B.with_obb(lines).withColumn("translations", F.create_map(F.lit("English"), F.col("text"), F.lit("last_trans"), F.lit("English")))
    upright = G.bounds(F.col("lines")[0])
    o = F.struct(((upright[0] + upright[2]) / 2.0).alias("x"), ((upright[1] + upright[3]) / 2.0).alias("y"),
                 (upright[2] - upright[0]).cast("double").alias("w"), (upright[3] - upright[1]).cast("double").alias("h"), F.lit(0.0).alias("theta"))
    html = S.html_pages(S.overlay_items(blocks.withColumn("obb", o)))
    raw = F.regexp_extract("value", "data-overlays='([^']*)'", 1)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(name), F.lit(char))
    items = F.from_json(raw, "array<struct<x:bigint,y:bigint,width:bigint,height:bigint,text:string>>")
    return html.select("page_id", F.explode(items).alias("i")).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("i.x").alias("x"), F.max("i.width").alias("w"), F.sum(F.length("i.text")).alias("chars"))


@query("s14_renderer_sinks", sql=BLOCKS_SQL + """
SELECT k.kind, count(*) AS pages FROM (SELECT DISTINCT page_id FROM blk WHERE regexp_matches(text, '\\p{L}')), (SELECT unnest(['raw', 'json', 'html']) AS kind) k GROUP BY k.kind""")
def s14_renderer_sinks(spark, sf):
    blocks = B.with_obb(_merged(spark, sf)).withColumn("translations", F.create_map(F.lit("last_trans"), F.lit("x")))
    blocks = cut_lineage(blocks)
    folder = scratch(spark, "sinks")
    readers = {"raw": spark.read.parquet, "json": spark.read.json, "html": spark.read.parquet}
    out = None
    for kind, read in readers.items():
        S.write_output(blocks, f"{folder}/{kind}", kind)
        part = read(f"{folder}/{kind}").select("page_id").agg(F.count_distinct("page_id").alias("pages")).select(F.lit(kind).alias("kind"), "pages")
        out = part if out is None else out.unionByName(part)
    return out


# --- jobs -------------------------------------------------------------------


@query("w10_latest_status", sql=ctes("job_items") + """
SELECT job_id, path, arg_max(status, seq) AS status, max(seq) AS seq FROM job_items GROUP BY job_id, path""")
def w10_latest_status(spark, sf):
    return J.latest_status(view(spark, sf, "job_items"), ["job_id", "path"]).select("job_id", "path", "status", "seq")


@query("a23_job_rollup", sql=ctes("job_items") + """
SELECT job_id, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS total,
 CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial' ELSE 'done' END AS status FROM (SELECT job_id, path, arg_max(status, seq) AS status FROM job_items GROUP BY job_id, path) GROUP BY job_id""")
def a23_job_rollup(spark, sf):
    return J.job_rollup(J.latest_status(view(spark, sf, "job_items"), ["job_id", "path"]))


@query("w12_progress", sql=ctes("job_items") + """
SELECT job_id, seq, CAST(least(100, round(100.0::DOUBLE * row_number() OVER (PARTITION BY job_id ORDER BY seq) / count(*) OVER (PARTITION BY job_id))) AS BIGINT) AS percent FROM job_items""")
def w12_progress(spark, sf):
    return J.progress(view(spark, sf, "job_items")).select("job_id", "seq", "percent")


@query("c8_page_job", sql=BOX_LINES + """, p AS (SELECT g.page_id, html, count(b.quad_id) FILTER (b.prob >= 0.2) AS n, count(b.quad_id) FILTER (b.prob >= 0.9) AS k FROM pages g LEFT JOIN boxes b ON b.page_id = g.page_id GROUP BY ALL),
 s AS (SELECT page_id, CASE WHEN length(html) % 7 = 0 THEN 'failed' WHEN n = 0 THEN 'skipped' WHEN k = 0 THEN 'skipped' ELSE 'done' END AS status, CASE WHEN length(html) % 7 = 0 THEN 'decode' WHEN n = 0 THEN 'detect' WHEN k = 0 THEN 'ocr' END AS stage FROM p)
SELECT page_id, status, stage FROM s""")
def c8_page_job(spark, sf):
    pages = table(spark, sf, "pages")
    n = textlines(spark, sf).groupBy("page_id").agg(F.count_if(F.col("prob") >= 0.2).alias("n"), F.count_if(F.col("prob") >= 0.9).alias("k"))
    df = pages.join(n, "page_id", "left")
    none = F.lit(None).cast("string")
    out = J.run_pages(df, [
        ("decode", F.when(F.length("html") % 7 == 0, F.lit("unreadable")), F.lit(False)),
        ("detect", none, F.coalesce("n", F.lit(0)) == 0), ("ocr", none, F.coalesce("k", F.lit(0)) == 0)])
    return out.select("page_id", "status", "stage")


# --- models -----------------------------------------------------------------


def _stub_detector():
    import pandas as pd

    def model(frame):
        n = frame["html"].str.len().astype("int64")
        quads = [[{"x": int(k % 90), "y": int(k % 70)}, {"x": int(k % 90 + 40), "y": int(k % 70)},
                  {"x": int(k % 90 + 40), "y": int(k % 70 + 12)}, {"x": int(k % 90), "y": int(k % 70 + 12)}] for k in n]
        return pd.DataFrame({"page_id": frame["page_id"], "quad_id": frame["page_id"] * 10, "pts": quads, "score": (n % 10) / 10.0})

    return model


@query("ud1_detector", sql="SELECT page_id, page_id * 10 AS quad_id, length(html) % 90 AS x, length(html) % 70 AS y, (length(html) % 10) / 10.0::DOUBLE AS score FROM pages")
def ud1_detector(spark, sf):
    q = U.detect(table(spark, sf, "pages").select("page_id", "html"), _stub_detector)
    return q.select("page_id", "quad_id", F.col("pts")[0]["x"].alias("x"), F.col("pts")[0]["y"].alias("y"), "score")


def _mask_detector():
    """A quad and the runs of a small mask per page, both from the length of its text."""
    def model(frame):
        import pandas as pd

        n = frame["html"].str.len()
        pts = [[{"x": int(v % 90), "y": int(v % 70)}] * 4 for v in n]
        quads = pd.DataFrame({"page_id": frame["page_id"], "quad_id": frame["page_id"] * 10, "pts": pts, "score": (n % 10) / 10.0})
        rows = [(p, y, int(v % 90), int(v % 90) + y) for p, v in zip(frame["page_id"], n) for y in range(int(v % 4))]
        return quads, pd.DataFrame(rows, columns=["page_id", "y", "x0", "x1"])

    return model


@query("ud1_detector_with_mask", sql="""SELECT page_id, 'quad' AS kind, length(html) % 70 AS y, length(html) % 90 AS x0, NULL::BIGINT AS x1 FROM pages
UNION ALL SELECT page_id, 'run', y, length(html) % 90, length(html) % 90 + y FROM pages, range(3) k(y) WHERE y < length(html) % 4""")
def ud1_detector_with_mask(spark, sf):
    quads, runs = U.detect_with_mask(table(spark, sf, "pages").select("page_id", "html"), _mask_detector)
    first = F.col("pts")[0]
    return quads.select("page_id", F.lit("quad").alias("kind"), first["y"].alias("y"), first["x"].alias("x0"), F.lit(None).cast("bigint").alias("x1")).unionByName(
        runs.select("page_id", F.lit("run").alias("kind"), "y", "x0", "x1"))


def _crop_ocr():
    """Reads a crop as the number and the sum of its pixels."""
    def model(frame):
        out = frame[["page_id", "quad_id"]].copy()
        crops = [[] if c is None else list(c) for c in frame["crop"]]
        out["text"] = [f"{len(c)}/{sum(int(p['v']) for p in c)}" for c in crops]
        out["fg"], out["bg"], out["prob"] = None, None, 0.5
        return out

    return model


@query("ud2_ocr_with_crops", sql=RAS + """, b AS (SELECT doc_id AS quad_id, doc_id // 20 AS page_id, (doc_id * 7) % 24 AS x0, (doc_id * 5) % 26 AS y0, 8 + n_chars % 9 AS w, 4 + doc_id % 5 AS h FROM documents)
SELECT b.page_id, b.quad_id, count(r.v) || '/' || coalesce(sum(r.v), 0) AS text FROM b LEFT JOIN raster r ON r.page_id = b.page_id AND r.x >= x0 AND r.x < x0 + w AND r.y >= y0 AND r.y < y0 + h GROUP BY b.page_id, b.quad_id""")
def ud2_ocr_with_crops(spark, sf):
    k = F.col("doc_id")
    quads = table(spark, sf, "documents").select(F.floor(k / 20).alias("page_id"), k.alias("quad_id"), G.box_quad(k * 7 % 24, k * 5 % 26, F.col("n_chars") % 9 + 8, k % 5 + 4).alias("pts"))
    geo = cut_lineage(G.with_geometry(G.with_corner_order(quads)))
    batches = order.width_batches(geo, F.col("vertical"), text_height=48, size=16)
    boxed = batches.drop("bx", "by", "bw", "bh").join(geo.select("page_id", "quad_id", "bx", "by", "bw", "bh"), ["page_id", "quad_id"])
    return U.recognise(boxed, _crop_ocr, pixels=view(spark, sf, "raster")).select("page_id", "quad_id", "text")


def _stub_ocr():
    def model(frame):
        out = frame[["page_id", "quad_id"]].copy()
        out["text"] = [f"{s}/{p}" for s, p in zip(frame["strip"], frame["pad_width"])]
        out["fg"], out["bg"] = None, None
        out["prob"] = [None if q % 2 else 0.5 for q in frame["quad_id"]]
        return out

    return model


@query("ud2_ud9_ocr", sql=BOX_LINES + """, s AS (SELECT page_id, quad_id, CAST(trunc(CASE WHEN vertical THEN bh * 48::DOUBLE / bw ELSE bw * 48::DOUBLE / bh END) AS BIGINT) AS strip FROM bgeo),
 r AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY strip, quad_id) - 1) // 16 AS batch FROM s),
 m AS (SELECT *, max(strip) OVER (PARTITION BY page_id, batch) + 7 AS pad FROM r)
SELECT page_id, quad_id, strip || '/' || pad AS text, CASE WHEN quad_id % 2 = 1 THEN 1.0 ELSE 0.5 END AS prob FROM m""")
def ud2_ud9_ocr(spark, sf):
    geo = cut_lineage(G.with_geometry(G.with_corner_order(textlines(spark, sf))))
    batches = order.width_batches(geo, F.col("vertical"), text_height=48, size=16)
    return U.recognise(batches, _stub_ocr).select("page_id", "quad_id", "text", "prob")


def _stub_inpainter():
    def model(frame):
        frame = frame.copy()
        frame.loc[frame["m"] > 127, "v"] = 77
        return frame[["page_id", "y", "x", "v"]]

    return model


@query("ud4_inpainter", sql=RGB + " SELECT page_id, y, x, CASE WHEN g > 127 THEN 77 ELSE v END AS v FROM rgb")
def ud4_inpainter(spark, sf):
    px = view(spark, sf, "rgb").select("page_id", "y", "x", "v", F.col("g").alias("m"))
    return U.inpaint(px, _stub_inpainter, "page_id bigint, y bigint, x bigint, v bigint")


def _masked_inpainter():
    """Fills masked pixels with the mean of the others of the unit."""
    def model(frame):
        frame = frame.copy()
        rest = frame.loc[~frame["masked"], "v"]
        frame.loc[frame["masked"], "v"] = int(rest.sum()) // max(1, len(rest))
        return frame[["page_id", "y", "x", "v"]]

    return model


@query("ud4_inpainter_with_mask", sql=RAS + """, m AS (SELECT page_id, CAST(coalesce(sum(v) FILTER (v <= 140), 0) AS BIGINT) // greatest(1, count(*) FILTER (v <= 140)) AS mean FROM raster GROUP BY page_id)
SELECT page_id, y, x, CASE WHEN v > 140 THEN mean ELSE v END AS v FROM raster JOIN m USING (page_id)""")
def ud4_inpainter_with_mask(spark, sf):
    px = view(spark, sf, "raster")
    mask = M.to_runs(px.where("v > 140").select("page_id", "y", "x"))
    return U.inpaint(px.select("page_id", "y", "x", "v"), _masked_inpainter, "page_id bigint, y bigint, x bigint, v bigint", mask=mask)


def _stub_upscaler():
    import numpy as np

    def double(ty, tx, v):
        ty, tx, v = (np.repeat(np.asarray(a, dtype="int64"), 4) for a in (ty, tx, v))
        dy, dx = np.tile([0, 0, 1, 1], len(ty) // 4), np.tile([0, 1, 0, 1], len(ty) // 4)
        return ty * 2 + dy, tx * 2 + dx, v

    def model(frame):
        frame = frame.copy()
        done = [double(a, b, c) for a, b, c in zip(frame["ty"], frame["tx"], frame["v"])]
        for i, c in enumerate(("ty", "tx", "v")):
            frame[c] = [d[i] for d in done]
        return frame

    return model


@query("ud5_upscaler", sql=RAS + " SELECT page_id, y * 2 + dy AS y, x * 2 + dx AS x, v FROM raster, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)")
def ud5_upscaler(spark, sf):
    px = view(spark, sf, "raster")
    tiles = R.split_tiles(px.join(R.page_sizes(px), "page_id"), 8, 2)
    big = U.upscale(tiles, _stub_upscaler, 8)
    return R.merge_tiles(big, 16, 4).select("page_id", "y", "x", "v")


def _echo_client(prompts):
    """Answers every numbered line in brackets; an odd number of lines fails."""
    replies = []
    for p in prompts:
        lines = p.split("\n")[1:]
        body = "\n".join(f"{line.split(' ', 1)[0]} <{line.split(' ', 1)[1]}>" for line in lines)
        replies.append((500 if len(lines) % 5 == 0 else 200, body))
    return replies


@query("ud6_prompt_translation", sql="""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS number, '<' || replace(text, chr(10), ' ') || '>' AS text, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations))
SELECT conv_id, number, text, NULL AS error FROM t WHERE n % 5 <> 0 UNION ALL SELECT DISTINCT conv_id, NULL, NULL, 'request failed with 500' FROM t WHERE n % 5 = 0""")
def ud6_prompt_translation(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return U.prompt_translate(df, ["conv_id"], ["turn"], _echo_client, "en", "de", "Translate {source_language} to {target_language}:\n{texts}", "key", "model")


def _reverse_client(prompts):
    """Answers every line of a prompt under its number, the last one first."""
    return [(200, "\n".join(f"{line.split('] ', 1)[0]}] <{line.split('] ', 1)[1]}>" for line in reversed(p.split("\n")[1:]))) for p in prompts]


@query("ud6_prompts_by_budget", sql="""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS number, '<' || text || '>' AS text, NULL AS error FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations)""")
def ud6_prompts_by_budget(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return U.prompt_translate(df, ["conv_id"], ["turn"], _reverse_client, "en", "de", "Translate {source_language} to {target_language}:\n{texts}", "key", "model", budget=300)


@query("ud8_quad_accessors", sql=BOX_LINES + """
SELECT quad_id, round(score, 6) AS score, round(aspect, 6) AS aspect, area, vertical, (x0 + x1) // 2 AS mid_x FROM bgeo""")
def ud8_quad_accessors(spark, sf):
    df = G.with_geometry(G.with_corner_order(textlines(spark, sf)))
    return df.select("quad_id", F.round("score", 6).alias("score"), F.round("aspect", 6).alias("aspect"), "area", "vertical",
                     G.midpoints(F.col("pts"))[0][0].alias("mid_x"))


# --- streams ----------------------------------------------------------------


@query("st1_page_ingest", sql=BLOCKS_SQL + " SELECT page_id, region AS block_id, n_lines FROM blk WHERE regexp_matches(text, '\\p{L}')")
def st1_page_ingest(spark, sf):
    folder = scratch(spark, "ingest")
    pages = f"{folder}/pages"
    # pages arrive whole: a file of lines never splits a page
    textlines(spark, sf).repartition("page_id").write.parquet(pages)
    stream = ST.file_stream(spark, pages, spark.read.parquet(pages).schema, max_files=2)
    ST.ingest(stream, lambda batch: regions.merge_regions(batch).select("page_id", "block_id", "n_lines"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("page_id", "block_id", "n_lines")


@query("st2_stage_progress", sql=ctes("job_items") + """, l AS (SELECT job_id, path, arg_max(status, seq) AS status FROM job_items GROUP BY job_id, path)
SELECT job_id, count(*) AS total, count(*) FILTER (status <> 'running') AS ended, CAST(least(100, round(count(*) FILTER (status <> 'running') * 100.0::DOUBLE / count(*))) AS BIGINT) AS percent FROM l GROUP BY job_id""")
def st2_stage_progress(spark, sf):
    folder = scratch(spark, "progress")
    items = view(spark, sf, "job_items").join(table(spark, sf, "events").select(F.col("event_id").alias("seq"), "ts"), "seq")
    # files cut across the order of events, so that later batches bring earlier states
    items.repartition("path").write.parquet(f"{folder}/events")
    stream = ST.file_stream(spark, f"{folder}/events", items.schema, max_files=2)
    ST.follow_progress(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return ST.job_progress(ST.progress_states(spark, f"{folder}/out"))
