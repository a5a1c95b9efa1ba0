"""Page-shaped views over the given tables.

Each view is one SELECT written for both dialects: ``{d}`` is whole-number
division, ``{dbl}`` the suffix that makes a literal a double, ``{pixels}`` the
explode of an embedding.  Spark derives every view, so work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.session import spread

_LINES = """
SELECT doc_id AS quad_id, doc_id {d} 20 AS page_id,
 CASE WHEN (doc_id {d} 20) % 4 = 3 THEN y ELSE x END AS x, CASE WHEN (doc_id {d} 20) % 4 = 3 THEN x ELSE y END AS y,
 CASE WHEN (doc_id {d} 20) % 4 = 3 THEN h ELSE w END AS w, CASE WHEN (doc_id {d} 20) % 4 = 3 THEN w ELSE h END AS h,
 text, lang, (50 + (doc_id * 13) % 50) / 100.0{dbl} AS score, ((doc_id * 37) % 100) / 100.0{dbl} AS prob
 FROM (SELECT doc_id, text, lang, 60 + n_chars % 240 AS w, 20 + doc_id % 5 AS h,
   CASE WHEN (doc_id % 20) {d} 5 >= 2 THEN 340 + ((doc_id % 20) {d} 5) * 400 - (60 + n_chars % 240)
        ELSE 40 + ((doc_id % 20) {d} 5) * 400 + (doc_id * 7) % 13 END AS x,
   60 + (doc_id % 5) * 34 + CASE WHEN doc_id % 5 >= 3 THEN 60 ELSE 0 END + (doc_id * 11) % 5 AS y FROM documents) s
"""

# the same lines tilted by k/20, corners in canonical order
_SLANTED = """
SELECT quad_id, page_id, score, prob, k,
 x + t AS x0, y AS y0, x + t + w AS x1, y + s AS y1, x + w AS x2, y + s + h AS y2, x AS x3, y + h AS y3
 FROM (SELECT doc_id AS quad_id, doc_id {d} 20 AS page_id, x, y, w, h, score, prob, k,
         (w * k) {d} 20 AS s, (h * k) {d} 20 AS t
       FROM (SELECT doc_id, (doc_id {d} 3) % 8 AS k, 60 + n_chars % 240 AS w, 20 + doc_id % 5 AS h,
               40 + ((doc_id % 20) {d} 5) * 400 + (doc_id * 7) % 13 AS x, 60 + (doc_id % 5) * 34 AS y,
               (50 + (doc_id * 13) % 50) / 100.0{dbl} AS score, ((doc_id * 37) % 100) / 100.0{dbl} AS prob
             FROM documents) a) b
"""

_PANELS = """
SELECT p_partkey {d} 6 AS page_id, p_partkey AS panel_id, 20 + (p_partkey % 2) * 500 AS x, 20 + ((p_partkey % 6) {d} 2) * 400 AS y,
 20 + (p_partkey % 2) * 500 + 380 + (p_size * 7) % 160 AS r, 20 + ((p_partkey % 6) {d} 2) * 400 + CASE WHEN p_size % 9 = 0 THEN 60 ELSE 330 + p_size END AS b FROM part
"""

_SEGMENTS = """
SELECT DISTINCT l_orderkey {d} 40 AS page_id, ((l_orderkey % 40) * 1000000 + l_partkey) * 10 + l_linenumber AS seg_id,
 20 + l_partkey % 900 AS ax, 20 + l_partkey * 11 % 1100 AS ay,
 20 + l_partkey % 900 + CASE WHEN l_linenumber % 2 = 0 THEN 300 ELSE 4 END AS bx,
 20 + l_partkey * 11 % 1100 + CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 200 END AS by
 FROM lineitem
"""

# scattered boxes, a few per page, many of them overlapping or nested
_BOXES = """
SELECT l_orderkey AS page_id, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS panel_id, x, y, x + w AS r, y + h AS b
 FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey % 400 AS x, (l_suppkey * 37 + l_partkey) % 500 AS y,
   40 + (l_partkey * 7 + l_linenumber * 31) % 300 AS w, 30 + (l_suppkey * 13 + l_linenumber * 17) % 350 AS h FROM lineitem) q
"""

_LOGITS = "SELECT vec_id {d} 10 AS sample_id, vec_id % 10 AS t, embedding AS scores FROM embeddings"

# sixteen 8x8 tiles make one 32x32 page
_RASTER = """
SELECT vec_id {d} 16 AS page_id, ((vec_id % 16) {d} 4) * 8 + i {d} 8 AS y, (vec_id % 4) * 8 + i % 8 AS x,
 CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5{dbl}) * 255))) AS BIGINT) AS v
 FROM {pixels} p
"""

_RGB = """
SELECT page_id, y, x, v AS r, (v * 7 + x * 13) % 256 AS g, (v * 3 + y * 29) % 256 AS b, v FROM ({raster}) q
"""

_BLOCKS = "SELECT conv_id AS page_id, conv_id AS block_id, turn AS line_no, text FROM conversations"

_JOB_ITEMS = """
SELECT event_id {d} 500 AS job_id, concat('page-', CAST(user_id AS VARCHAR(20)), '.png') AS path,
 CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'running' END AS status,
 event_type AS message, event_id AS seq FROM events
"""

_VIEWS = {
    "textlines": (_LINES, ["documents"]),
    "slanted": (_SLANTED, ["documents"]),
    "panels": (_PANELS, ["part"]),
    "boxes": (_BOXES, ["lineitem"]),
    "segments": (_SEGMENTS, ["lineitem"]),
    "logits": (_LOGITS, ["embeddings"]),
    "raster": (_RASTER, ["embeddings"]),
    "rgb": (_RGB, ["embeddings"]),
    "blocks": (_BLOCKS, ["conversations"]),
    "job_items": (_JOB_ITEMS, ["events"]),
}

_DIALECT = {
    "spark": {"{d}": "div", "{dbl}": "D",
              "{pixels}": "(SELECT vec_id, i, e FROM embeddings LATERAL VIEW posexplode(embedding) px AS i, e)"},
    "duckdb": {"{d}": "//", "{dbl}": "::DOUBLE",
               "{pixels}": "(SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"},
}


def _render(name: str, dialect: str) -> str:
    text = _VIEWS[name][0].strip().replace("{raster}", _RASTER.strip())
    for key, value in _DIALECT[dialect].items():
        text = text.replace(key, value)
    return text


def ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the SQL twin of a query."""
    return "WITH " + ", ".join(f"{n} AS ({_render(n, 'duckdb')})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, tables = _VIEWS[name]
    sql = _render(name, "spark")
    for t in tables:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def textlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upright lines as quads, with colours on part of the rows."""
    df = view(spark, sf_dir, "textlines")
    q = F.col("quad_id")
    color = lambda a: F.array(*[((q * m) % 256).cast("smallint") for m in a])
    return df.select(
        "page_id", "quad_id", "text", "lang", "score", "prob",
        G.box_quad(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("pts"),
        F.when(q % 3 != 0, color((7, 11, 13))).alias("fg"),
        F.when(q % 6 != 0, color((17, 19, 23))).alias("bg"),
    )


def slanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilted lines as quads, corners in canonical order."""
    df = view(spark, sf_dir, "slanted")
    pts = F.array(*[G.point(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)])
    return df.select("page_id", "quad_id", "score", "prob", "k", pts.alias("pts"))
