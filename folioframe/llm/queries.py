"""The corpus queries: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.llm import divergence, exact, langid, licenses, neardup, packing, pieces, pii, secrets, spelling, tokenfile, topk, toxicity
from folioframe.llm.base import fold, read
from folioframe.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from folioframe.llm.vocabularies import tokenizer_path

#: The pass phrase of the pseudonyms in the query and the pipeline; a user brings their own.
PHRASE = "pseudonyms of the corpus queries"
#: A-Z in lower case, in SQL.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_toxicity")
def op1_toxicity(spark, sf):
    docs = read(spark, sf, "documents")
    chain = toxicity.train(docs, read(spark, sf, "labels"), fold("doc_id", 5) != 0)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return toxicity.score_toxicity(docs, chain).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), spans.alias("spans"))


def _license_sql() -> str:
    """The canonical form in SQL: notices of copyright go line by line, spellings are replaced word by word."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names, words = (f"[{', '.join(map(quoted, part))}]" for part in (licenses.SPELLINGS.keys(), licenses.SPELLINGS.values()))
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licenses.catalogue_entries())
    body = licenses.BODY_WORDS.replace(" ", "|")
    # not a notice: a word that goes on the sentence, or nothing, behind "copyright" or an item (c)
    notice = (f"(regexp_matches(x, '^[^a-z0-9]*(©|all rights reserved)') OR (regexp_matches(x, '^[^a-z0-9]*(copyright\\b|\\(c\\))') AND NOT "
              f"regexp_matches(x, '^[^a-z0-9]*(copyright\\b|\\(c\\))[\\x00-\\x09\\x0b-\\x2f\\x3a-\\x60\\x7b-\\x7f]*(({body})\\b|$)')))")
    lines = f"array_to_string(list_filter(string_split({_LOWER.format('t')}, chr(10)), lambda x: NOT {notice}), chr(10))"
    plain = f"regexp_replace({lines}, '[^a-z0-9]+', ' ', 'g')"
    spelt = f"""array_to_string(list_transform(list_filter(string_split({plain}, ' '), lambda w: w <> ''),
 lambda w: coalesce(list_extract({words}, list_position({names}, w)), w)), ' ')"""
    return f"""WITH known(license, c) AS (SELECT min(license), c FROM (VALUES {known}) e(license, c) GROUP BY c), d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, sha256({spelt}) AS text_digest, {spelt} AS c FROM d),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS t FROM d), lc AS (SELECT r, {spelt} AS c FROM l),
n AS (SELECT r, count(*) AS n_notices, array_to_string(list_sort(list_distinct(list(license))), ',') AS notices FROM lc JOIN known USING (c) GROUP BY r)
SELECT w.doc_id, w.text_digest, k.license, coalesce(n.n_notices, 0) AS n_notices, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN known k ON k.c = w.c LEFT JOIN n ON n.r = w.r"""


@query("op2_license_scan", sql=_license_sql())
def op2_license_scan(spark, sf):
    return licenses.scan_licenses(read(spark, sf, "documents"), licenses.catalogue(spark))


@query("op3_language_id")
def op3_language_id(spark, sf):
    docs = read(spark, sf, "documents")
    net = langid.train(docs, fold("doc_id", 4) != 2)
    found = langid.predict(docs, net)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op4_exact_top_k", sql="""WITH f AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE)) AS e FROM f),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id),
s AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM s WHERE rank <= 20""")
def op4_exact_top_k(spark, sf):
    return topk.top_k(read(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


@query("op5_secret_scan")
def op5_secret_scan(spark, sf):
    return secrets.secret_digest(secrets.scan_secrets(read(spark, sf, "documents")))


@query("op6_sentencepiece")
def op6_sentencepiece(spark, sf):
    return pieces.encoding_digest(read(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op7_exact_dedup", sql="""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""")
def op7_exact_dedup(spark, sf):
    return exact.exact_groups(read(spark, sf, "documents")).selectExpr("id AS doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op8_pii")
def op8_pii(spark, sf):
    done = pii.pseudonymised(read(spark, sf, "documents").select("doc_id", "text"), PHRASE)
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    spans = F.array_join(F.transform("pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return done.select("doc_id", F.size("pii_spans").cast("long").alias("n_pii"), *(count(kind).alias(f"n_{kind}") for kind in pii.NAMES), spans.alias("spans"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark, sf):
    like = neardup.Similarity(words=3, num=85, den=100)
    return neardup.near_groups(read(spark, sf, "documents"), like).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf):
    return packing.pack_documents(read(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op11_spelling_variants", sql=f"""WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
 lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
x AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents),
r AS (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS h FROM x GROUP BY id, run),
b AS (SELECT id, run, k, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substring(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM r),
c AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, steps[xor(c, b) % 256 + 1]))) AS crc FROM b, tbl),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN crc % 97 = 0 THEN substring(run, 1, crc % length(run)) || substring(run, crc % length(run) + 2)
 ELSE run END AS word FROM c) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
e AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
s AS (SELECT DISTINCT e.word, e.n, v.word AS other, v.n AS m FROM e JOIN v ON e.rest = v.word),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM e a JOIN e b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION ALL SELECT word, n, other, m FROM s UNION ALL SELECT other, m, word, n FROM s),
t AS (SELECT word, other, m, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM p),
f AS (SELECT v.word, v.n, coalesce(t.n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
 FROM v LEFT JOIN t ON t.word = v.word AND t.place = 1),
w(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT w.word, f.form, step + 1 FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, l.root FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM w GROUP BY word) l ON l.word = f.word""")
def op11_spelling_variants(spark, sf):
    return spelling.spelling_groups(read(spark, sf, "documents"))


@query("op12_bit_plane_output")
def op12_bit_plane_output(spark, sf):
    files = tokenfile.write_token_files(read(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))
    return tokenfile.read_token_files(files)


@query("op13_source_divergence", sql=f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
x AS (SELECT r, lang, source, {_LOWER.format("unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))")} AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT x.lang, x.source, x.term, count(*) AS n FROM x JOIN k ON k.lang = x.lang AND k.term = x.term GROUP BY x.lang, x.source, x.term),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (t.total + l.v) AS p, 1 + 1000000000 * (k.n + 1) // (l.total + l.v) AS q
 FROM t JOIN k ON k.lang = t.lang JOIN l ON l.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200""")
def op13_source_divergence(spark, sf):
    return divergence.source_divergence(read(spark, sf, "documents"))
