"""Numeric normalisers on arrays and single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(v: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))


def symmetric(v: Column) -> Column:
    """0..255 to -1..1 by division first."""
    return v / F.lit(127.5) - F.lit(1.0)


def centred(v: Column) -> Column:
    """0..255 to -1..1 by subtraction first."""
    return (v - F.lit(127.5)) / F.lit(127.5)


def unit(v: Column) -> Column:
    return v / F.lit(255.0)


def standardise(v: Column, norm: float, mean: float) -> Column:
    return v * F.lit(norm) - F.lit(mean * norm)


def log_sum_exp(scores: Column) -> Column:
    """max + ln(sum(exp(x - max))) over an array of doubles."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return top + F.log(total)


def log_softmax(scores: Column) -> Column:
    bound = F.transform(F.array(F.struct(scores.alias("s"), log_sum_exp(scores).alias("z"))),
                        lambda q: F.transform(q["s"], lambda x: x - q["z"])).getItem(0)
    return bound


def argmax_first(scores: Column) -> Column:
    """Zero-based index of the largest score, the first one on a tie."""
    return F.array_position(scores, F.array_max(scores)) - F.lit(1)


def argmax_last(scores: Column) -> Column:
    """Zero-based index of the largest score, the last one on a tie."""
    return F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores))


def progress_percent(current: Column, total: Column) -> Column:
    """min(100, round(100 * current / total)), 0 for an empty job."""
    share = F.least(F.lit(100.0), F.round(current * 100.0 / total))
    return F.when(total == 0, F.lit(0)).otherwise(share.cast("bigint"))
