"""OCR decoding over embeddings read as logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import decode as D
from folioframe.plans.registry import query
from folioframe.plans.views import ctes, view

_STEPS = ctes("logits") + """, sc AS (SELECT sample_id, t, scores, unnest(scores) AS s, generate_subscripts(scores, 1) - 1 AS i FROM logits),
 st AS (SELECT sample_id, t, min(i) FILTER (s = m) AS token, max(i) FILTER (s = m) AS token_last, any_value(CAST(m AS DOUBLE)) - any_value(lse) AS logprob, any_value(scores) AS scores
  FROM (SELECT *, max(s) OVER (PARTITION BY sample_id, t) AS m, ln(sum(exp(CAST(s AS DOUBLE))) OVER (PARTITION BY sample_id, t)) AS lse FROM sc) GROUP BY sample_id, t),
 kp AS (SELECT * FROM (SELECT *, lag(token, 1, 0) OVER (PARTITION BY sample_id ORDER BY t) AS before FROM st) WHERE token <> before AND token <> 0)"""

_PIECE = "CASE token WHEN 1 THEN '<S>' WHEN 2 THEN '</S>' WHEN 3 THEN '<SP>' ELSE chr(CAST(32 + token AS INTEGER)) END"


def _steps(spark, sf):
    return D.best_tokens(view(spark, sf, "logits"))


def vocabulary(spark):
    """64 entries: blank, start, end and space, then printable characters."""
    piece = F.expr("CASE id WHEN 1 THEN '<S>' WHEN 2 THEN '</S>' WHEN 3 THEN '<SP>' ELSE char(32 + id) END")
    return spark.range(64).select(F.col("id").alias("token"), piece.alias("piece"))


@query("t8_argmax", sql=_STEPS + " SELECT sample_id, t, token, token_last, round(logprob, 6) AS logprob FROM st")
def t8_argmax(spark, sf):
    last = D.best_tokens(view(spark, sf, "logits"), last_on_tie=True).select("sample_id", "t", F.col("token").alias("token_last"))
    return _steps(spark, sf).join(last, ["sample_id", "t"]).select("sample_id", "t", "token", "token_last", F.round("logprob", 6).alias("logprob"))


@query("w3_ctc_collapse", sql=_STEPS + " SELECT sample_id, t, token FROM kp")
def w3_ctc_collapse(spark, sf):
    return D.ctc_collapse(_steps(spark, sf)).select("sample_id", "t", "token")


def _pieces(spark, sf):
    return D.with_vocabulary(D.ctc_collapse(_steps(spark, sf)), vocabulary(spark))


@query("j14_s8_vocabulary", sql=_STEPS + f" SELECT sample_id, t, token, {_PIECE} AS piece FROM kp")
def j14_s8_vocabulary(spark, sf):
    return _pieces(spark, sf).select("sample_id", "t", "token", "piece")


_END = f""", pc AS (SELECT *, {_PIECE.replace("WHEN 2 ", "WHEN 20 ")} AS piece FROM kp),
 en AS (SELECT * FROM (SELECT *, max(piece = '</S>') OVER (PARTITION BY sample_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS e FROM pc) WHERE NOT e)"""


def _ended(spark, sf):
    # token 20 ends a line here, so that some samples are cut
    vocab = vocabulary(spark).withColumn("piece", F.when(F.col("token") == 20, F.lit(D.END)).when(
        F.col("token") == 2, F.lit('"')).otherwise(F.col("piece")))
    return D.until_end(D.with_vocabulary(D.ctc_collapse(_steps(spark, sf)), vocab))


@query("w4_until_end", sql=_STEPS + _END + " SELECT sample_id, t, token FROM en")
def w4_until_end(spark, sf):
    return _ended(spark, sf).select("sample_id", "t", "token")


_LEVEL = "CAST(trunc(least(greatest(CAST(scores[{i}] AS DOUBLE) * 255.0, 0), 255)) AS INTEGER)"


@query("a14_a16_sample_text", sql=_STEPS + _END + f""",
 tx AS (SELECT sample_id, string_agg(CASE piece WHEN '<SP>' THEN ' ' ELSE piece END, '' ORDER BY t) AS text, round(exp(avg(logprob)), 6) AS prob,
  CAST(trunc(coalesce(avg({_LEVEL.format(i=11)}) FILTER (piece <> '<SP>'), 0)) AS BIGINT) AS r,
  CAST(trunc(coalesce(avg({_LEVEL.format(i=12)}) FILTER (piece <> '<SP>'), 0)) AS BIGINT) AS g FROM en WHERE piece <> '<S>' GROUP BY sample_id),
 pv AS (SELECT sample_id, avg(CASE WHEN scores[22] > scores[21] THEN 1.0 ELSE 0.0 END) > 0.5 AS has_color FROM en GROUP BY sample_id)
SELECT sample_id, text, prob, r, g, has_color FROM tx JOIN pv USING (sample_id)""")
def a14_a16_sample_text(spark, sf):
    s = F.col("scores").cast("array<double>")
    tokens = _ended(spark, sf).withColumns({"r": s[10], "g": s[11], "p0": s[20], "p1": s[21]})
    text = D.sample_texts(tokens, ("r", "g"))
    return text.join(D.color_presence(tokens, "p0", "p1"), "sample_id").select(
        "sample_id", "text", F.round("prob", 6).alias("prob"), F.col("r").cast("bigint").alias("r"), F.col("g").cast("bigint").alias("g"), "has_color")


# ten hypotheses of three steps per sample, extended by three tokens each
_BEAM = ctes("logits") + """, hy AS (SELECT sample_id, t AS hyp_id, [0.0, CAST(scores[1] AS DOUBLE) - 1, CAST(scores[2] AS DOUBLE) - 1] AS lp, scores FROM logits),
 ex AS (SELECT sample_id, hyp_id, tok AS token, (lp[1] + lp[2] + lp[3] + (CAST(scores[tok + 1] AS DOUBLE) - 1)) / 4 AS mean FROM (SELECT *, unnest([5, 6, 7]) AS tok FROM hy)),
 rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY mean DESC, hyp_id, token) AS rank FROM ex) WHERE rank <= 6),
 ru AS (SELECT *, sum(CASE WHEN token = 7 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY rank) AS done, sum(CASE WHEN token <> 7 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY rank) AS live FROM rk),
 fu AS (SELECT *, max(done) OVER (PARTITION BY sample_id) >= 2 AS enough FROM ru)"""


@query("w5_beam_step", sql=_BEAM + """
SELECT sample_id, hyp_id, token, rank, round(mean, 6) AS mean, state FROM (SELECT *, CASE WHEN token = 7 AND done <= 2 THEN 'finished' WHEN token <> 7 AND NOT enough AND live <= 5 THEN 'live' END AS state FROM fu) WHERE state IS NOT NULL""")
def w5_beam_step(spark, sf):
    s = F.col("scores").cast("array<double>")
    base = view(spark, sf, "logits").select("sample_id", F.col("t").alias("hyp_id"), s.alias("s"))
    hyps = base.select("sample_id", "hyp_id", F.array(F.lit(9), F.lit(8), F.lit(8)).alias("tokens"),
                       F.array(F.lit(0.0), F.col("s")[0] - 1, F.col("s")[1] - 1).alias("logprobs"))
    cand = base.select("sample_id", "hyp_id", F.inline(F.array(*[
        F.struct(F.lit(t).alias("token"), (F.col("s")[t] - 1).alias("logprob")) for t in (5, 6, 7)])))
    out = D.beam_step(hyps, cand, k=5, end=7, max_finished=2)
    return out.select("sample_id", "hyp_id", F.element_at("tokens", -1).alias("token"), "rank", F.round("mean", 6).alias("mean"), "state")


@query("a16_best_hypothesis", sql=ctes("logits") + """
, hy AS (SELECT sample_id, t AS hyp_id, (CAST(scores[1] AS DOUBLE) + CAST(scores[2] AS DOUBLE)) / 3 AS mean FROM logits)
SELECT sample_id, arg_max(hyp_id, (mean, -hyp_id)) AS hyp_id, round(exp(max(mean)), 6) AS prob FROM hy GROUP BY sample_id""")
def a16_best_hypothesis(spark, sf):
    s = F.col("scores").cast("array<double>")
    hyps = view(spark, sf, "logits").select(
        "sample_id", F.col("t").alias("hyp_id"), F.array(F.lit(1)).alias("tokens"), F.array(F.lit(0.0), s[0], s[1]).alias("logprobs"))
    return D.best_hypothesis(hyps).select("sample_id", "hyp_id", F.round("prob", 6).alias("prob"))
