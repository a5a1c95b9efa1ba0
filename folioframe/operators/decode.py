"""OCR output decoding: logits to tokens to text, and one beam-search step.

A sample is one text line, so a window over its steps is bounded by the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import numeric as N
from folioframe.session import broadcast_if_small

# Special vocabulary entries.
START, END, SPACE = "<S>", "</S>", "<SP>"


def best_tokens(logits: DataFrame, last_on_tie: bool = False) -> DataFrame:
    """Best class and its log-probability for every step."""
    s = F.col("scores").cast("array<double>")
    pick = N.argmax_last(s) if last_on_tie else N.argmax_first(s)
    return logits.withColumns({
        "token": pick.cast("bigint"), "logprob": F.array_max(s) - N.log_sum_exp(s)})


def ctc_collapse(steps: DataFrame, blank: int = 0) -> DataFrame:
    """Keep a step when its token is not blank and differs from the step before."""
    before = F.lag("token", 1, blank).over(Window.partitionBy("sample_id").orderBy("t"))
    return steps.withColumn("_before", before).where(
        (F.col("token") != F.col("_before")) & (F.col("token") != blank)).drop("_before")


def with_vocabulary(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add the token text; the vocabulary is broadcast when its size allows."""
    return tokens.join(broadcast_if_small(vocabulary), "token")


def until_end(tokens: DataFrame) -> DataFrame:
    """Drop everything from the first end token of a sample on."""
    w = Window.partitionBy("sample_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max(F.col("piece") == END).over(w)
    return tokens.withColumn("_end", seen).where(~F.col("_end")).drop("_end")


def color_level(c: Column) -> Column:
    return F.least(F.greatest(c * 255.0, F.lit(0.0)), F.lit(255.0)).cast("int")


def sample_texts(tokens: DataFrame, colors: tuple[str, ...] = ()) -> DataFrame:
    """Text, confidence and mean colours per sample.

    Special tokens give no colour; a space token gives a blank.  The confidence
    is exp of the mean log-probability of the emitted tokens.
    """
    shown = tokens.where(F.col("piece") != START)
    piece = F.when(F.col("piece") == SPACE, F.lit(" ")).otherwise(F.col("piece"))
    plain = F.col("piece") != SPACE
    means = [F.coalesce(F.avg(F.when(plain, color_level(F.col(c)))).cast("int"), F.lit(0)).alias(c) for c in colors]
    return shown.groupBy("sample_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("t", piece.alias("p"))))["p"], "").alias("text"),
        F.exp(F.avg("logprob")).alias("prob"), *means)


def color_presence(tokens: DataFrame, absent: str, present: str) -> DataFrame:
    """Whether more than half of the tokens of a sample say the colour is there."""
    share = F.avg((F.col(present) > F.col(absent)).cast("double"))
    return tokens.groupBy("sample_id").agg((share > 0.5).alias("has_color"))


def sequence_confidence(logprobs: Column) -> Column:
    """exp of the mean log-probability of a hypothesis."""
    total = F.aggregate(logprobs.cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return F.exp(total / F.size(logprobs))


def beam_step(hyps: DataFrame, candidates: DataFrame, k: int, end: int, max_finished: int = 2,
              finished: DataFrame | None = None) -> DataFrame:
    """Extend every hypothesis, rank per sample and decide who stays.

    ``hyps``: sample_id, hyp_id, tokens, logprobs; ``candidates``: sample_id,
    hyp_id, token, logprob; ``finished``: sample_id and the number done before.
    Of the best k+1 extensions those that end are ``finished``; up to k others
    are ``live`` unless the sample has enough finished ones.
    """
    ext = hyps.join(candidates, ["sample_id", "hyp_id"]).select(
        "sample_id", "hyp_id", "token",
        F.concat("tokens", F.array("token")).alias("tokens"),
        F.concat("logprobs", F.array("logprob")).alias("logprobs"))
    mean = F.aggregate("logprobs", F.lit(0.0), lambda a, x: a + x) / F.size("logprobs")
    order = Window.partitionBy("sample_id").orderBy(F.desc("mean"), "hyp_id", "token")
    top = ext.withColumn("mean", mean).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    if finished is not None:
        top = top.join(finished, "sample_id", "left")
        prior = F.coalesce("finished", F.lit(0))
    else:
        prior = F.lit(0)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.col("token") == end
    done = F.sum(ended.cast("int")).over(upto) + prior
    live = F.sum((~ended).cast("int")).over(upto)
    top = top.withColumns({"_done": done, "_live": live})
    full = F.max("_done").over(Window.partitionBy("sample_id")) >= max_finished
    before = F.col("_done") - ended.cast("int") < max_finished
    top = top.withColumn("state", F.when(ended & before, F.lit("finished"))
                         .when(~ended & ~full & (F.col("_live") <= k), F.lit("live")))
    return top.where("state IS NOT NULL").select("sample_id", "hyp_id", "tokens", "logprobs", "mean", "rank", "state")


def best_hypothesis(hyps: DataFrame) -> DataFrame:
    """The hypothesis with the highest mean log-probability per sample."""
    mean = F.aggregate("logprobs", F.lit(0.0), lambda a, x: a + x) / F.size("logprobs")
    return hyps.withColumn("mean", mean).groupBy("sample_id").agg(
        F.max(F.struct("mean", (-F.col("hyp_id")).alias("h"), "tokens")).alias("b")).select(
        "sample_id", (-F.col("b.h")).alias("hyp_id"), F.col("b.tokens").alias("tokens"), F.exp("b.mean").alias("prob"))
