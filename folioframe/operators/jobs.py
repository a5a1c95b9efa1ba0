"""Page jobs with a status per page, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import numeric as N
from folioframe.operators import filters, regions, translate
from folioframe.operators.ranking import ranked
from folioframe.session import cut_lineage
from folioframe.sources import tables


def latest_status(items: DataFrame, key: list[str]) -> DataFrame:
    """Last message per input wins; folded before the shuffle."""
    return items.groupBy(*key).agg(F.max(F.struct("seq", "status", "message")).alias("l")).select(
        *key, "l.status", "l.message", "l.seq")


def job_rollup(items: DataFrame, key: str = "job_id") -> DataFrame:
    """Counts per state; a job with failures is partial."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = items.groupBy(key).agg(n("done"), n("failed"), n("skipped"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("status", F.when(F.col("failed") > 0, F.lit("partial")).otherwise(F.lit("done")))


def progress(items: DataFrame, key: str = "job_id") -> DataFrame:
    """Percent of a job after each of its items, in order of ``seq``."""
    total = items.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    numbered = ranked(items, [key], ["seq"], "current").join(total, key)
    return numbered.withColumn("percent", N.progress_percent(F.col("current"), F.col("total")))


def run_pages(pages: DataFrame, stages: list[tuple[str, Column, Column]]) -> DataFrame:
    """Per-page job: each stage has an error and an emptiness test.

    ``stages`` lists ``(name, error, empty)``; ``error`` is a nullable message.
    The first stage that fails or finds nothing decides the page, so one bad
    page never fails the job.
    """
    status, message, stage = F.lit("done"), F.lit("finished"), F.lit(None).cast("string")
    for name, error, empty in reversed(stages):
        status = F.when(error.isNotNull(), F.lit("failed")).when(empty, F.lit("skipped")).otherwise(status)
        message = F.when(error.isNotNull(), error).when(empty, F.lit("nothing found")).otherwise(message)
        stage = F.when(error.isNotNull() | empty, F.lit(name)).otherwise(stage)
    return pages.withColumns({"status": status, "message": message, "stage": stage})


def translate_pages(lines: DataFrame, profiles: DataFrame, skip_languages: list[str], routes: DataFrame, glossaries: dict, pre_rules=(), post_rules=(),
                    translators: dict | None = None, joined: bool = False) -> DataFrame:
    """Recognised lines to translated blocks: merge, language and skip flag, translation.

    With ``joined`` all blocks of a page are taken to be of the language that
    their texts have together.
    """
    blocks = cut_lineage(regions.merge_regions(lines, profiles=profiles, skip_languages=skip_languages))
    if joined:
        blocks = filters.flag_skip_language(translate.with_joined_language(blocks, profiles, ["page_id"], ["block_id"]), skip_languages)
    return translate.translate_blocks(blocks, routes, glossaries, pre_rules, post_rules, translators)


def page_results(pages: DataFrame, lines: DataFrame, blocks: DataFrame, mask: DataFrame) -> DataFrame:
    """Every page with its ordered blocks, its mask runs, and the status the stages give it.

    ``lines`` are what recognition found, ``blocks`` what is left of them after
    the merge and translation, ``mask`` the runs of their lettering.
    """
    n = lambda df, name: df.groupBy("page_id").agg(F.count(F.lit(1)).alias(name))
    area = mask.groupBy("page_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("mask_area"))
    full = tables.page_export(blocks, pages).join(n(lines, "_lines"), "page_id", "left").join(area, "page_id", "left")
    empty = lambda c: F.col(c).isNull()
    done = run_pages(full, [("detection", F.lit(None).cast("string"), empty("_lines")), ("translation", F.lit(None).cast("string"), empty("blocks")),
                            ("mask", F.lit(None).cast("string"), empty("mask_area"))])
    return done.drop("_lines")
