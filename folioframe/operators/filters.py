"""Quality filters; each keeps or flags rows with a native predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.functions import text as T


def above(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Binarize: values strictly above the threshold."""
    return df.where(F.col(column) > threshold)


def min_side(df: DataFrame, w: str, h: str, size: float) -> DataFrame:
    return df.where(F.least(w, h) >= size)


def box_threshold(df: DataFrame, threshold: float, score: str = "score", strict: bool = False) -> DataFrame:
    """Drop boxes below the threshold; the strict form also drops equality."""
    return df.where(F.col(score) > threshold if strict else ~(F.lit(threshold) > F.col(score)))


def non_zero(df: DataFrame, pts: str = "pts") -> DataFrame:
    total = sum((x + y for x, y in G.corners(F.col(pts))), F.lit(0))
    return df.where(total > 0)


def min_area(df: DataFrame, area: float = 16.0, pts: str = "pts") -> DataFrame:
    return df.where(G.hull_area(pts) >= area)


def finite_score(df: DataFrame, score: str = "score") -> DataFrame:
    return df.where(F.col(score) != float("inf"))


def min_probability(df: DataFrame, threshold: float = 0.2) -> DataFrame:
    """A missing probability counts as certain."""
    return df.where(F.coalesce(F.col("prob"), F.lit(1.0)) >= threshold)


def long_enough(text: Column, n: int) -> Column:
    """Length in UTF-8 bytes."""
    return F.octet_length(text) >= n


def unwanted(text: Column, remove: list[str] | None, mode: str = "exact") -> Column:
    if not remove:
        return F.lit(False)
    if mode == "regex":
        return text.rlike("|".join(f"(?:{p})" for p in remove))
    return text.isin(*remove)


def drop_reason(text: Column, n: int, remove: list[str] | None = None, mode: str = "exact") -> Column:
    """Why a text is dropped, null when it stays."""
    return (
        F.when(~long_enough(text, n), F.lit("too short"))
        .when(~T.is_valuable(text), F.lit("not valuable"))
        .when(unwanted(text, remove, mode), F.lit("unwanted"))
    )


def flag_skip_language(df: DataFrame, languages: list[str]) -> DataFrame:
    """Flag rows that need no translation; the rows stay."""
    skip = F.col("language").isin(*languages) if languages else F.lit(False)
    return df.withColumn("skip_translate", F.coalesce(skip, F.lit(False)))


def split_translatable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(~F.col("skip_translate")), df.where(F.col("skip_translate"))


def is_small(w: Column, h: Column, page_w, page_h, ratio: float, extra: float = 1.0) -> Column:
    return (w < page_w * (ratio * extra)) | (h < page_h * (ratio * extra))


def short_circuit(pages: DataFrame, rows: DataFrame, stage: str) -> DataFrame:
    """Status rows of the pages that have nothing left at a stage."""
    return pages.join(rows.select("page_id"), "page_id", "left_anti").select(
        "page_id", F.lit(stage).alias("stage"), F.lit("skipped").alias("status"))


def large_components(df: DataFrame, min_area: int = 9) -> DataFrame:
    """Bitmap components worth keeping: more than ``min_area`` pixels, box of 3 or more."""
    return df.where((F.col("area") > min_area) & (F.col("w") * F.col("h") >= 3))
