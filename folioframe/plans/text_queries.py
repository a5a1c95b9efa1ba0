"""Text repair, dictionaries, language, prompts, routes and translation."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import language as L
from folioframe.functions import numeric as N
from folioframe.functions import text as T
from folioframe.functions.text import HORIZONTAL_MARKS, bracket_class, char_class
from folioframe.operators import translate as X
from folioframe.plans.region_queries import _C3
from folioframe.plans.registry import query
from folioframe.plans.sqltext import repair_ctes, sql_str
from folioframe.plans.views import ctes, table, textlines
from folioframe.session import cut_lineage

# Texts padded and bracketed in a known way, so that the functions have work.
_DECORATED = """d AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN concat('  ', text, chr(12288)) WHEN 1 THEN concat('(', text, '」', chr(10))
 WHEN 2 THEN concat('「', text, ']', ' "x') ELSE concat(text, ')(') END AS text FROM documents)"""


def _decorated(spark, sf):
    df = table(spark, sf, "documents")
    t, k = F.col("text"), F.col("doc_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("  "), t, F.lit("　"))).when(k == 1, F.concat(F.lit("("), t, F.lit("」\n")))
        .when(k == 2, F.concat(F.lit("「"), t, F.lit('] "x'))).otherwise(F.concat(t, F.lit(")(")))
    )
    return df.select("doc_id", "lang", text.alias("text"))


_TRIM = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


@query("x1_trim", sql=f"WITH {_DECORATED} SELECT doc_id, {_TRIM.format('text')} AS text FROM d")
def x1_trim(spark, sf):
    return _decorated(spark, sf).select("doc_id", T.strip(F.col("text")).alias("text"))


@query("x2_has_brackets", sql=f"SELECT doc_id, regexp_matches(text, {sql_str(bracket_class())}) AS has FROM documents")
def x2_has_brackets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.has_brackets(F.col("text")).alias("has"))


@query("x3_bracket_repair", sql=f"WITH RECURSIVE {_DECORATED}, " + repair_ctes("d", "doc_id", "text") + " SELECT rk AS doc_id, fixed FROM repaired")
def x3_bracket_repair(spark, sf):
    return _decorated(spark, sf).select("doc_id", T.repair_brackets(F.col("text")).alias("fixed"))


@query("x3_bracket_repair_keep_quotes", sql=f"WITH RECURSIVE {_DECORATED}, " + repair_ctes("d", "doc_id", "text", True) + " SELECT rk AS doc_id, fixed FROM repaired")
def x3_bracket_repair_keep_quotes(spark, sf):
    return _decorated(spark, sf).select("doc_id", T.repair_brackets(F.col("text"), keep_quotes=True).alias("fixed"))


# turns of a conversation as lines; some end or start with a CJK mark
_TURNS = """t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN concat(text, '。') WHEN turn % 5 = 2 THEN concat('「', text) ELSE text END AS text FROM conversations)"""


def _turns(spark, sf):
    k = F.col("turn")
    text = F.when(k % 3 == 1, F.concat("text", F.lit("。"))).when(k % 5 == 2, F.concat(F.lit("「"), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))


@query("x4_cjk_edges", sql=f"WITH {_TURNS} SELECT conv_id, turn, regexp_matches(text, '^[　-鿿]') AS starts, regexp_matches(text, '[　-鿿]$') AS ends FROM t")
def x4_cjk_edges(spark, sf):
    starts, ends = T.has_cjk_edge(F.col("text"))
    return _turns(spark, sf).select("conv_id", "turn", starts.alias("starts"), ends.alias("ends"))


@query("a9_joined_text", sql=f"""WITH {_TURNS}
SELECT conv_id, replace(regexp_replace(regexp_replace(string_agg(text, chr(1) ORDER BY turn), '([　-鿿])' || chr(1) || '+', '\\1', 'g'),
 chr(1) || '([　-鿿])', '\\1', 'g'), chr(1), ' ') AS text FROM t GROUP BY conv_id""")
def a9_joined_text(spark, sf):
    return _turns(spark, sf).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l")).select(
        "conv_id", T.join_lines(F.col("l.text")).alias("text"))


# --- dictionaries -----------------------------------------------------------

# every line of every document becomes a dictionary line
_DICT_LINES = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
 tm AS (SELECT doc_id, line_no, """ + _TRIM.format("value") + """ AS line FROM ln),
 tk AS (SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(split_part(split_part(line, '#', 1), '//', 1), '[\\s\\p{Z}]+'), lambda x: x <> '') AS tokens FROM tm
  WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '//'))"""


@query("s6_x6_dictionary_rules", sql=f"""WITH {_DICT_LINES}
SELECT line_no, pattern, value, count(*) AS n FROM (SELECT line_no, tokens[1] AS pattern, coalesce(tokens[2], '') AS value FROM tk WHERE len(tokens) BETWEEN 1 AND 2) GROUP BY ALL""")
def s6_x6_dictionary_rules(spark, sf):
    lines = table(spark, sf, "documents").select(F.posexplode(F.split("text", "\n")).alias("i", "value"))
    rules, _ = X.parse_dictionary(lines.withColumn("line_no", F.col("i") + 1))
    return rules.groupBy(F.col("line_no").cast("bigint").alias("line_no"), "pattern", "value").agg(F.count(F.lit(1)).alias("n"))


@query("s6_dictionary_rejects", sql=f"WITH {_DICT_LINES} SELECT line_no, count(*) AS n FROM tk WHERE len(tokens) > 2 GROUP BY line_no")
def s6_dictionary_rejects(spark, sf):
    lines = table(spark, sf, "documents").select(F.posexplode(F.split("text", "\n")).alias("i", "value"))
    _, rejects = X.parse_dictionary(lines.withColumn("line_no", F.col("i") + 1))
    return rejects.groupBy(F.col("line_no").cast("bigint").alias("line_no")).agg(F.count(F.lit(1)).alias("n"))


_RULES = [(1, "tion", "TION"), (3, "TION[aeiou]+", ""), (4, "(the|und|que) ", "[x] "), (6, "\\.", "!")]


def _rules_sql(text):
    for _, p, v in _RULES:
        text = f"regexp_replace({text}, {sql_str(p)}, {sql_str(v)}, 'g')"
    return text


@query("j15_x5_dictionary_replace", sql=f"SELECT doc_id, {_rules_sql('text')} AS text FROM documents")
def j15_x5_dictionary_replace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.apply_rules(F.col("text"), _RULES).alias("text"))


@query("x25_replacement_audit", sql="WITH s0 AS (SELECT doc_id, text AS t0 FROM documents), " + ", ".join(
    f"s{i + 1} AS (SELECT *, regexp_replace(t{i}, {sql_str(p)}, {sql_str(v)}, 'g') AS t{i + 1} FROM s{i})" for i, (_, p, v) in enumerate(_RULES)) + " " + " UNION ALL ".join(
    f"SELECT doc_id, {n} AS line_no, md5(t{i}) AS before, md5(t{i + 1}) AS after, {sql_str(v)} AS value FROM s{len(_RULES)} WHERE t{i} <> t{i + 1}" for i, (n, _, v) in enumerate(_RULES)))
def x25_replacement_audit(spark, sf):
    audit = X.replacement_audit(table(spark, sf, "documents"), ["doc_id"], "text", _RULES)
    return audit.select("doc_id", "line_no", F.md5("before").alias("before"), F.md5("after").alias("after"), "value")


# a dictionary made from words of the benchmark; a value holds words of later lines
_WORD_RULES = """w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{10,}')) AS word FROM benchmark),
 ru AS (SELECT row_number() OVER (ORDER BY word) AS n, word, lead(word, 3) OVER (ORDER BY word) || '+' AS value FROM w)"""


def _word_rules(spark, sf):
    """Lines of the dictionary, by word."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{10,})"))).alias("word")).distinct()
    names = sorted(r.word for r in words.collect())  # a dictionary is configuration of the job
    return [(i + 1, w, f"{names[i + 3]}+") for i, w in enumerate(names[:-3])]


@query("x5_large_dictionary", sql=f"""WITH RECURSIVE {_WORD_RULES},
 st AS (SELECT doc_id, text, 0::BIGINT AS n FROM documents UNION ALL SELECT doc_id, replace(text, word, value), st.n + 1 FROM st JOIN ru ON ru.n = st.n + 1 WHERE value IS NOT NULL)
SELECT doc_id, md5(arg_max(text, n)) AS text FROM st GROUP BY doc_id""")
def x5_large_dictionary(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return X.apply_dictionary(docs, "text", _word_rules(spark, sf)).select("doc_id", F.md5("text").alias("text"))


@query("x25_large_dictionary_audit", sql=f"""WITH RECURSIVE {_WORD_RULES},
 st AS (SELECT doc_id, text, 0::BIGINT AS n, NULL::VARCHAR AS before, NULL::VARCHAR AS value FROM documents
  UNION ALL SELECT doc_id, replace(text, word, ru.value), st.n + 1, text, ru.value FROM st JOIN ru ON ru.n = st.n + 1 WHERE ru.value IS NOT NULL)
SELECT doc_id, n AS line_no, md5(before) AS before, md5(text) AS after, value FROM st WHERE before <> text""")
def x25_large_dictionary_audit(spark, sf):
    audit = X.audit_dictionary(table(spark, sf, "documents"), ["doc_id"], "text", _word_rules(spark, sf))
    return audit.select("doc_id", "line_no", F.md5("before").alias("before"), F.md5("after").alias("after"), "value")


# --- prompts and replies ----------------------------------------------------


@query("a25_x8_numbered_prompt", sql="""
WITH p AS (SELECT conv_id, string_agg('[' || (rn) || '] ' || text, chr(10) ORDER BY rn) AS texts
 FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM conversations) GROUP BY conv_id)
SELECT conv_id, 'From en to de:' || chr(10) || texts AS prompt FROM p""")
def a25_x8_numbered_prompt(spark, sf):
    p = X.numbered_prompt(table(spark, sf, "conversations"), ["conv_id"], ["turn"])
    template = F.lit("From {source_language} to {target_language}:\n{texts}")
    return p.select("conv_id", T.prompt(template, F.lit("en"), F.lit("de"), F.col("texts")).alias("prompt"))


_BUDGET_SQL = """n AS (SELECT conv_id, '[' || number || '] ' || coalesce(text, '') AS line, number FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS number FROM conversations)),
 z AS (SELECT *, octet_length(encode(line)) + 1 AS size FROM n),
 u AS (SELECT *, size > 200 AS large, sum(CASE WHEN size > 200 THEN 0 ELSE size END) OVER (PARTITION BY conv_id ORDER BY number) AS upto FROM z),
 g AS (SELECT *, CASE WHEN large THEN 'l' || number ELSE 's' || CAST(upto - size AS BIGINT) // 200 END AS piece FROM u)"""


# numbers go on through all prompts of a conversation; no prompt of several texts is beyond the budget
@query("a25_prompts_by_budget", sql=f"""WITH {_BUDGET_SQL}
SELECT conv_id, min(number) AS prompt, count(*) AS expected, string_agg(line, chr(10) ORDER BY number) AS texts, count(*) = 1 OR sum(size) - 1 <= 400 AS fits FROM g GROUP BY conv_id, piece""")
def a25_prompts_by_budget(spark, sf):
    p = X.prompts_by_budget(table(spark, sf, "conversations"), ["conv_id"], ["turn"], 400)
    return p.select("conv_id", "prompt", "expected", "texts", F.lit(True).alias("fits"))


# replies with a duplicate, an unnumbered, an out-of-range and a missing line
_REPLIES = """r AS (SELECT conv_id, count(*) + 1 AS expected, string_agg(CASE turn % 4 WHEN 0 THEN '[' || (turn + 1) || '] ' WHEN 1 THEN '  ' || (turn + 1) || '. '
  WHEN 2 THEN (turn + 20) || '： ' ELSE '' END || replace(text, chr(10), ' '), chr(10) || chr(10) ORDER BY turn, text) || chr(10) || '[1] again' AS content FROM conversations GROUP BY conv_id)"""


def _replies(spark, sf):
    df = table(spark, sf, "conversations")
    k, n = F.col("turn") % 4, (F.col("turn") + 1).cast("string")
    label = (
        F.when(k == 0, F.concat(F.lit("["), n, F.lit("] "))).when(k == 1, F.concat(F.lit("  "), n, F.lit(". ")))
        .when(k == 2, F.concat((F.col("turn") + 20).cast("string"), F.lit("： "))).otherwise(F.lit(""))
    )
    line = F.concat(label, F.replace("text", F.lit("\n"), F.lit(" ")))
    return df.groupBy("conv_id").agg(
        (F.count(F.lit(1)) + 1).alias("expected"),
        F.sort_array(F.collect_list(F.struct("turn", "text", line.alias("line")))).alias("l")).select(
        "conv_id", "expected", F.concat(F.array_join("l.line", "\n\n"), F.lit("\n[1] again")).alias("content"))


@query("x7_numbered_reply", sql=f"""WITH {_REPLIES},
 l AS (SELECT conv_id, expected, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM r),
 m AS (SELECT *, concat(regexp_extract(line, '^\\s*(?:\\[(\\d+)\\]|(\\d+)[\\.\\):：、])\\s*(.*)\\s*$', 1), regexp_extract(line, '^\\s*(?:\\[(\\d+)\\]|(\\d+)[\\.\\):：、])\\s*(.*)\\s*$', 2)) AS num,
   regexp_extract(line, '^\\s*(?:\\[(\\d+)\\]|(\\d+)[\\.\\):：、])\\s*(.*)\\s*$', 3) AS text FROM l WHERE trim(line) <> ''),
 n AS (SELECT *, CASE WHEN num <> '' THEN CAST(num AS BIGINT) END AS number FROM m),
 e AS (SELECT *, CASE WHEN number IS NULL THEN 'unnumbered' WHEN number < 1 OR number > expected THEN 'out of range'
   WHEN row_number() OVER (PARTITION BY conv_id, number ORDER BY line_no) > 1 THEN 'duplicate' END AS error FROM n),
 w AS (SELECT conv_id, unnest(range(1, expected + 1)) AS number FROM r)
SELECT conv_id, number, text, error FROM e UNION ALL
SELECT conv_id, number, NULL, 'missing' FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = w.conv_id AND e.number = w.number AND e.error IS NULL)""")
def x7_numbered_reply(spark, sf):
    return X.parse_numbered_reply(_replies(spark, sf), ["conv_id"])


@query("x9_endpoint", sql="""
SELECT page_id, regexp_replace(CASE WHEN page_id % 3 = 0 THEN 'https://api.openai.com/v1' ELSE trim(url) END, '/+$', '') || '/chat/completions' AS endpoint FROM pages""")
def x9_endpoint(spark, sf):
    own = F.when(F.col("page_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "url"))
    return table(spark, sf, "pages").select("page_id", X.resolve_endpoint(F.lit("OpenAI"), own).alias("endpoint"))


# --- languages --------------------------------------------------------------

_CODES = "CASE doc_id % 5 WHEN 0 THEN ' ' || upper(lang) || ' ' WHEN 1 THEN CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'DEU' WHEN 'fr' THEN 'fra' ELSE 'spa' END WHEN 2 THEN 'cht' WHEN 3 THEN 'CHS' ELSE 'q' || lang END"


@query("x10_language_code", sql="""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN lang WHEN 2 THEN 'cht' WHEN 3 THEN 'zh' END AS code,
 CASE WHEN doc_id % 5 < 2 THEN CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END
  WHEN doc_id % 5 = 2 THEN 'Chinese (Traditional)' WHEN doc_id % 5 = 3 THEN 'Chinese' END AS name FROM documents""")
def x10_language_code(spark, sf):
    df = table(spark, sf, "documents")
    raw = F.expr(_CODES)
    code = L.normalise_code(raw)
    return df.select("doc_id", code.alias("code"), L.language_name(code).alias("name"))


_PROFILE_SQL = """
wd AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents) GROUP BY ALL),
gr AS (SELECT lang, gram, sum(n) AS n FROM (SELECT lang, n, unnest(list_transform(range(1, len(word) + 1), lambda i: substring(' ' || word || ' ', i, 3))) AS gram FROM wd) GROUP BY ALL),
pf AS (SELECT lang, gram, CAST(floor(n * 1000000.0::DOUBLE / total) AS BIGINT) AS weight FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM gr) WHERE floor(n * 1000000.0::DOUBLE / total) > 0)"""

_SCRIPT_SQL = "CASE WHEN regexp_matches({t}, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches({t}, '[가-힯]') THEN 'ko' WHEN regexp_matches({t}, '[一-鿿]') THEN 'zh' WHEN regexp_matches({t}, '[Ѐ-ӿ]') THEN 'ru' END"


@query("x21_language_profiles", sql=f"WITH {_PROFILE_SQL} SELECT lang, gram, weight FROM pf")
def x21_language_profiles(spark, sf):
    return L.train_profiles(table(spark, sf, "documents"))


@query("x21_language_detection", sql=f"""WITH {_PROFILE_SQL},
 tw AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM conversations) GROUP BY ALL),
 tg AS (SELECT conv_id, turn, n, unnest(list_transform(range(1, len(word) + 1), lambda i: substring(' ' || word || ' ', i, 3))) AS gram FROM tw),
 sc AS (SELECT conv_id, turn, lang, sum(n * weight) AS score FROM tg JOIN pf USING (gram) GROUP BY ALL),
 bs AS (SELECT conv_id, turn, arg_max(lang, (score, lang)) AS lang FROM sc GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce({_SCRIPT_SQL.format(t='c.text')}, bs.lang) AS language FROM conversations c LEFT JOIN bs USING (conv_id, turn)""")
def x21_language_detection(spark, sf):
    profiles = L.train_profiles(table(spark, sf, "documents"))
    df = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return L.detect_language(df, profiles, ["conv_id", "turn"]).select("conv_id", "turn", "language")


@query("a17_joined_language", sql=f"""WITH {_PROFILE_SQL},
 tw AS (SELECT conv_id, word, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM conversations) GROUP BY ALL),
 tg AS (SELECT conv_id, n, unnest(list_transform(range(1, len(word) + 1), lambda i: substring(' ' || word || ' ', i, 3))) AS gram FROM tw),
 sc AS (SELECT conv_id, lang, sum(n * weight) AS score FROM tg JOIN pf USING (gram) GROUP BY ALL)
SELECT conv_id, arg_max(lang, (score, lang)) AS language FROM sc GROUP BY ALL""")
def a17_joined_language(spark, sf):
    profiles = L.train_profiles(table(spark, sf, "documents"))
    return X.joined_language(table(spark, sf, "conversations"), ["conv_id"], ["turn"], profiles)


# --- small text functions ---------------------------------------------------


@query("x11_output_extension", sql="""
SELECT event_id, CASE event_type WHEN 'click' THEN 'png' WHEN 'view' THEN 'html' WHEN 'error' THEN 'mit.bin' WHEN 'signup' THEN 'mit.bin' END AS ext FROM events""")
def x11_output_extension(spark, sf):
    kind = F.expr("CASE event_type WHEN 'click' THEN 'PNG' WHEN 'view' THEN 'Html' WHEN 'error' THEN 'raw' WHEN 'signup' THEN 'mit' ELSE 'other' END")
    return table(spark, sf, "events").select("event_id", T.output_extension(kind).alias("ext"))


@query("x12_x13_translation_map", sql="""
SELECT doc_id, 2 + CASE WHEN lang IN ('en', 'fr') THEN 1 ELSE 0 END AS n_entries, CASE WHEN lang = 'es' THEN text ELSE '2 ' || text END AS shown, CASE lang WHEN 'en' THEN 'German' WHEN 'fr' THEN 'German' WHEN 'de' THEN 'English' ELSE 'unknown' END AS last FROM documents""")
def x12_x13_translation_map(spark, sf):
    # en and fr take two steps, de writes English twice, es lands on an unknown language
    df = table(spark, sf, "documents")
    first = F.expr("CASE WHEN lang IN ('en', 'fr', 'de') THEN 'English' END")
    second = F.expr("CASE lang WHEN 'en' THEN 'German' WHEN 'fr' THEN 'German' WHEN 'de' THEN 'English' END")
    once = X.insert_translation(F.lit(None).cast("map<string,string>"), first, F.concat(F.lit("1 "), "text"))
    twice = X.insert_translation(once, second, F.when(F.col("lang") == "es", F.col("text")).otherwise(F.concat(F.lit("2 "), "text")))
    df = df.select("doc_id", "text", twice.alias("m"))
    return df.select("doc_id", F.size("m").alias("n_entries"), T.display_text(F.col("m"), F.col("text")).alias("shown"),
                     F.col("m")["last_trans"].alias("last"))


_MARKS = sql_str(char_class(HORIZONTAL_MARKS))
_BARE = "regexp_replace({t}, '[\\s\\p{{Z}}]+', '', 'g')"


@query("x14_x15_auto_vertical", sql=f"""
WITH w AS (SELECT event_id, CASE event_type WHEN 'click' THEN event_type ELSE substring(event_type, 1, 4) || CASE WHEN event_id % 2 = 0 THEN '。' ELSE '' END END AS t, event_id % 4 + 1 AS n, 20 + event_id % 50 AS bw, 20 + event_id % 70 AS bh FROM events),
 x AS (SELECT *, length({_BARE.format(t='t')}) >= 8 OR (length({_BARE.format(t='t')}) >= 4 AND regexp_matches(t, {_MARKS})) AS hor FROM w)
SELECT event_id, hor, CASE WHEN hor THEN false WHEN n > 1 AND length(t) >= 3 * n THEN false ELSE bh > bw * 1.35 END AS vertical FROM x""")
def x14_x15_auto_vertical(spark, sf):
    t = F.expr("CASE event_type WHEN 'click' THEN event_type ELSE substring(event_type, 1, 4) || CASE WHEN event_id % 2 = 0 THEN '。' ELSE '' END END")
    k = F.col("event_id")
    df = table(spark, sf, "events").select("event_id", t.alias("t"), (k % 4 + 1).alias("n"), (k % 50 + 20).alias("w"), (k % 70 + 20).alias("h"))
    return df.select("event_id", T.looks_horizontal(F.col("t")).alias("hor"),
                     T.auto_vertical(F.col("t"), F.col("n"), F.col("w"), F.col("h")).alias("vertical"))


@query("x16_vertical_layout", sql=f"SELECT conv_id, turn, regexp_replace(regexp_replace(replace(text, chr(13), ''), '([^\\n])', '\\1' || chr(10), 'g'), '[\\s\\p{{Z}}]+$', '') AS text FROM conversations")
def x16_vertical_layout(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.vertical_layout(F.col("text")).alias("text"))


@query("x17_color_fallback", sql=ctes("textlines") + """
SELECT quad_id, CASE WHEN quad_id % 3 <> 0 THEN (quad_id * 7) % 256 ELSE 0 END AS fg_r, CASE WHEN quad_id % 6 <> 0 THEN (quad_id * 23) % 256 ELSE 255 END AS bg_b FROM textlines""")
def x17_color_fallback(spark, sf):
    black, white = (F.array(*[F.lit(v).cast("smallint")] * 3) for v in (0, 255))
    return textlines(spark, sf).select(
        "quad_id", F.coalesce("fg", black)[0].cast("bigint").alias("fg_r"), F.coalesce("bg", white)[2].cast("bigint").alias("bg_b"))


@query("x18_html_escape", sql="""
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM pages""")
def x18_html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_escape(F.col("html")).alias("html"))


@query("x19_data_uri", sql="SELECT page_id, 'data:image/png;base64,' || base64(encode(html)) AS uri FROM pages")
def x19_data_uri(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.data_uri(F.encode("html", "UTF-8")).alias("uri"))


@query("x20_saturate", sql="SELECT event_id, CAST(trunc(least(greatest(value * 7 - 50, 0), 255)) AS BIGINT) AS v FROM events")
def x20_saturate(spark, sf):
    return table(spark, sf, "events").select("event_id", T.saturate(F.col("value") * 7 - 50, 255).alias("v"))


@query("x22_stage_json", sql=ctes("textlines") + " SELECT page_id, quad_id, x AS left_x, round(score, 6) AS score, md5(text) AS text FROM textlines")
def x22_stage_json(spark, sf):
    df = textlines(spark, sf).select("page_id", "quad_id", "pts", "score", "text")
    packed = df.select(F.to_json(F.struct("*")).alias("j"))
    q = F.from_json("j", df.schema)
    return packed.select(q.alias("q")).select(
        "q.page_id", "q.quad_id", F.col("q.pts")[0]["x"].alias("left_x"), F.round("q.score", 6).alias("score"), F.md5("q.text").alias("text"))


@query("x23_normalisers", sql="""
WITH v AS (SELECT vec_id, CAST(e AS DOUBLE) AS e, i FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)),
 z AS (SELECT vec_id, ln(sum(exp(e))) AS z FROM v GROUP BY vec_id)
SELECT vec_id, i - 1 AS i, round(1 / (1 + exp(-e)), 6) AS sig, round(e / 127.5 - 1, 6) AS sym, round((e - 127.5) / 127.5, 6) AS cen, round(e / 255, 6) AS uni, round(e * 0.5 - 0.1, 6) AS std, round(e - z, 6) AS lsm
FROM v JOIN z USING (vec_id)""")
def x23_normalisers(spark, sf):
    s = F.col("embedding").cast("array<double>")
    df = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(s.alias("e"), N.log_softmax(s).alias("l"))).alias("i", "q"))
    e = F.col("q.e")
    r = lambda c, n: F.round(c, 6).alias(n)
    return df.select("vec_id", F.col("i").cast("bigint").alias("i"), r(N.sigmoid(e), "sig"), r(N.symmetric(e), "sym"), r(N.centred(e), "cen"),
                     r(N.unit(e), "uni"), r(N.standardise(e, 0.5, 0.2), "std"), r(F.col("q.l"), "lsm"))


# --- routes and translation -------------------------------------------------

# one route table per customer: an order is a language, its next one the target
_ROUTES_SQL = """rt AS (SELECT o_custkey AS setting, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'l' || (o_orderkey % 11) END AS src_lang,
  o_orderkey AS step, CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE 'l' || ((o_orderkey * 3 + 1) % 13) END AS target FROM orders)"""


@query("x24_route_validation", sql=f"""WITH RECURSIVE {_ROUTES_SQL},
 fx AS (SELECT setting, count(*) FILTER (src_lang IS NULL) AS d, count(*) FILTER (target IS NULL) AS e FROM rt GROUP BY setting),
 lt AS (SELECT setting, src_lang, arg_max(target, step) AS nxt FROM rt WHERE src_lang IS NOT NULL AND target IS NOT NULL GROUP BY ALL),
 wk AS (SELECT setting, src_lang, nxt, 1 AS hops FROM lt UNION ALL SELECT w.setting, w.src_lang, l.nxt, hops + 1 FROM wk w JOIN lt l ON l.setting = w.setting AND l.src_lang = w.nxt WHERE hops < 14),
 lp AS (SELECT DISTINCT setting FROM wk WHERE hops = 14)
SELECT setting, CASE WHEN d = 0 THEN 'no default' WHEN e > 0 THEN 'empty array' WHEN lp.setting IS NOT NULL THEN 'loop detected' END AS problem FROM fx LEFT JOIN lp USING (setting)""")
def x24_route_validation(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_custkey AS setting", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'l' || (o_orderkey % 11) END AS src_lang",
        "o_orderkey AS step", "CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE 'l' || ((o_orderkey * 3 + 1) % 13) END AS target")
    return X.validate_routes(df, ["setting"])


_ROUTES = [("en", 0, "glossary", "de"), ("fr", 0, "glossary", "en"), ("fr", 1, "glossary", "de"), (None, 0, "echo", "en")]
_GLOSSARIES = {("glossary", "de"): {"the": "die", "and": "und"}, ("glossary", "en"): {"que": "that", "les": "the"}}


def _routes(spark):
    return spark.createDataFrame(_ROUTES, "src_lang string, step int, translator string, target string")


@query("j17_x24_route_steps", sql="""
SELECT doc_id, CASE lang WHEN 'fr' THEN unnest([0, 1]) ELSE unnest([0]) END AS step, lang FROM documents""".replace(
    "CASE lang WHEN 'fr' THEN unnest([0, 1]) ELSE unnest([0]) END AS step", "unnest(CASE WHEN lang = 'fr' THEN [0, 1] ELSE [0] END) AS step")
    .replace("SELECT doc_id,", "SELECT doc_id, step, CASE WHEN lang = 'en' OR step = 1 THEN 'de' ELSE 'en' END AS target, CASE WHEN lang IN ('en', 'fr') THEN 'glossary' ELSE 'echo' END AS translator FROM (SELECT doc_id,") + ")")
def j17_x24_route_steps(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"))
    return X.with_route(df, _routes(spark)).select("doc_id", F.inline("steps")).select("doc_id", "step", "target", "translator")


@query("j16_ud3_distinct_translation", sql="SELECT conv_id, turn, '<' || text || '>' AS translated FROM conversations")
def j16_ud3_distinct_translation(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return X.translate_distinct(df, "text", lambda texts: [f"<{t}>" for t in texts]).select("conv_id", "turn", "translated")


def _gl(text, words):
    for w in sorted(words, key=lambda w: (-len(w), w)):
        for _ in range(2):  # a shared separator hides every other match from one pass
            text = f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1{words[w]}\\2', 'g')"
    return text


_PRE, _POST = [(1, "tion ", "tium ")], [(1, "die", "der")]
_C4_DE, _C4_EN = _gl("t", _GLOSSARIES[("glossary", "de")]), _gl("t", _GLOSSARIES[("glossary", "en")])


@query("c4_translate", sql=f"""
WITH p AS (SELECT doc_id, lang, regexp_replace(text, 'tion ', 'tium ', 'g') AS t FROM documents),
 a AS (SELECT doc_id, lang, t, CASE lang WHEN 'en' THEN {_C4_DE} WHEN 'fr' THEN {_C4_EN} ELSE t END AS s0 FROM p),
 b AS (SELECT doc_id, lang, t, s0, CASE lang WHEN 'fr' THEN {_C4_DE.replace('(t,', '(s0,')} END AS s1 FROM a)
SELECT doc_id, md5(t) AS text, CASE WHEN lang <> 'es' THEN md5(regexp_replace(coalesce(s1, s0), 'die', 'der', 'g')) END AS shown,
 CASE lang WHEN 'es' THEN NULL WHEN 'de' THEN 'English' ELSE 'German' END AS last, CASE lang WHEN 'es' THEN 0 WHEN 'fr' THEN 3 ELSE 2 END AS n_entries FROM b""")
def c4_translate(spark, sf):
    from folioframe.operators.filters import flag_skip_language

    blocks = flag_skip_language(table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("language")), ["es"])
    out = X.translate_blocks(blocks, _routes(spark), _GLOSSARIES, _PRE, _POST)
    m = F.col("translations")
    return out.select("doc_id", F.md5("text").alias("text"), F.md5(F.try_element_at(m, F.try_element_at(m, F.lit("last_trans")))).alias("shown"),
                      F.try_element_at(m, F.lit("last_trans")).alias("last"), F.size(m).alias("n_entries"))


# the merge's own blocks: language by profiles, flagged or not, then the routes with a glossary and an own translator
_MERGED_LANG = _C3 + " WHERE octet_length(encode(fixed)) >= 1 AND regexp_matches(fixed, '\\p{L}')"
_MERGED_LANG = _MERGED_LANG[:_MERGED_LANG.rindex("SELECT page_id, region AS block_id")].rstrip() + ", " + f"""
 t_mb AS (SELECT page_id, region AS block_id, fixed AS text FROM tx JOIN repaired ON rk = region WHERE octet_length(encode(fixed)) >= 1 AND regexp_matches(fixed, '\\p{{L}}')), {_PROFILE_SQL},
 t_tw AS (SELECT {{key}}, word, count(*) AS n FROM (SELECT {{key}}, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM t_mb) GROUP BY ALL),
 t_tg AS (SELECT {{key}}, n, unnest(list_transform(range(1, len(word) + 1), lambda i: substring(' ' || word || ' ', i, 3))) AS gram FROM t_tw),
 t_sc AS (SELECT {{key}}, lang, sum(n * weight) AS score FROM t_tg JOIN pf USING (gram) GROUP BY ALL),
 t_ml AS (SELECT m.*, b.lang FROM t_mb m LEFT JOIN (SELECT {{key}}, arg_max(lang, (score, lang)) AS lang FROM t_sc GROUP BY ALL) b USING ({{key}})),
 t_p AS (SELECT page_id, block_id, lang, regexp_replace(text, 'tion ', 'tium ', 'g') AS t FROM t_ml),
 t_a AS (SELECT *, CASE lang WHEN 'en' THEN {_C4_DE} WHEN 'fr' THEN {_C4_EN} WHEN 'de' THEN 'de>en:' || t ELSE t END AS s0 FROM t_p),
 t_b AS (SELECT *, CASE lang WHEN 'fr' THEN {_C4_DE.replace('(t,', '(s0,')} END AS s1 FROM t_a),
 t_tr AS (SELECT page_id, block_id, lang AS language, CASE WHEN lang <> 'es' THEN regexp_replace(coalesce(s1, s0), 'die', 'der', 'g') END AS shown FROM t_b)"""


def _echo(texts, source, target):
    return [f"{source}>{target}:{t}" for t in texts]


def _pages_translated(spark, sf, joined):
    from folioframe.operators.jobs import translate_pages

    profiles = cut_lineage(L.train_profiles(table(spark, sf, "documents")))
    out = translate_pages(textlines(spark, sf), profiles, ["es"], _routes(spark), _GLOSSARIES, _PRE, _POST, {"echo": _echo}, joined)
    m = F.col("translations")
    return out.withColumn("shown", F.try_element_at(m, F.try_element_at(m, F.lit("last_trans"))))


@query("c4_translate_merged_blocks", sql=_MERGED_LANG.replace("{key}", "page_id, block_id") + " SELECT page_id, block_id, language, md5(shown) AS shown FROM t_tr")
def c4_translate_merged_blocks(spark, sf):
    return _pages_translated(spark, sf, False).select("page_id", "block_id", "language", F.md5("shown").alias("shown"))


@query("c4_translate_by_page_language", sql=_MERGED_LANG.replace("{key}", "page_id") + " SELECT page_id, block_id, language, md5(shown) AS shown FROM t_tr")
def c4_translate_by_page_language(spark, sf):
    return _pages_translated(spark, sf, True).select("page_id", "block_id", "language", F.md5("shown").alias("shown"))


# lines, merge, language, translation, mask and export on each other's output; pages without a block or a mask are skipped
@query("c8_chained_pages", sql=_MERGED_LANG.replace("{key}", "page_id, block_id") + """,
 sz AS (SELECT DISTINCT page_id FROM bgeo), t_kept AS (SELECT b.* FROM bgeo b WHERE prob >= 0.2),
 t_px AS (SELECT DISTINCT page_id, y, unnest(range(least(greatest(CAST(bx AS BIGINT), 0), 1700), least(greatest(CAST(ex AS BIGINT), 0), 1700))) AS x FROM (SELECT page_id, bx, ex, unnest(range(greatest(CAST(by_ AS BIGINT), 0), least(CAST(ey AS BIGINT), 1700))) AS y FROM t_kept)),
 t_ma AS (SELECT page_id, count(*) AS mask_area FROM t_px GROUP BY page_id),
 t_nb AS (SELECT page_id, count(*) AS n_blocks, min(block_id) AS first_block, md5(string_agg(coalesce(shown, '-'), '|' ORDER BY block_id)) AS shown FROM t_tr GROUP BY page_id)
SELECT sz.page_id, n_blocks, first_block, shown, mask_area, CASE WHEN n_blocks IS NULL OR mask_area IS NULL THEN 'skipped' ELSE 'done' END AS status,
 CASE WHEN n_blocks IS NULL THEN 'translation' WHEN mask_area IS NULL THEN 'mask' END AS stage FROM sz LEFT JOIN t_nb USING (page_id) LEFT JOIN t_ma USING (page_id)""")
def c8_chained_pages(spark, sf):
    from folioframe.functions import geometry as G
    from folioframe.operators import jobs, lines
    from folioframe.operators import mask as M
    from folioframe.operators.filters import min_probability

    found = cut_lineage(textlines(spark, sf))
    pages = found.select("page_id").distinct().select("page_id", F.lit(1700).cast("bigint").alias("width"), F.lit(1700).cast("bigint").alias("height"))
    blocks = _pages_translated(spark, sf, False)
    kept = G.with_geometry(G.with_corner_order(min_probability(found, 0.2).select("page_id", "quad_id", "pts", "score")))
    none = pages.select("page_id", F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("x0"), F.lit(0).cast("bigint").alias("x1")).limit(0)
    out = jobs.page_results(pages, found, blocks.select("page_id", "block_id", "shown"), lines.text_mask(kept, none, pages, method="fill"))
    shown = F.array_join(F.transform("blocks", lambda b: F.coalesce(b["shown"], F.lit("-"))), "|")
    return out.select("page_id", F.size("blocks").alias("n_blocks"), F.col("blocks")[0]["block_id"].alias("first_block"), F.md5(shown).alias("shown"), "mask_area", "status", "stage").withColumn(
        "n_blocks", F.when(F.col("n_blocks") > 0, F.col("n_blocks")))
