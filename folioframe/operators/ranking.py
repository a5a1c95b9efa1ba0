"""Row numbers that survive a key with very many rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.session import cut_lineage


def ranked(df: DataFrame, keys: list[str], order: list, name: str, total_of: str | None = None, total: str = "total") -> DataFrame:
    """Add ``name``: 1, 2, ... per key in the given (total) order, as BIGINT.

    With ``total_of`` also ``total``, the sum of that column up to and with the row.

    Rows are range-partitioned by key and order, numbered inside the parts, and
    shifted by the sizes of the parts before. A large group so spreads over many
    tasks; a null key is a key like any other.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("count"), *([F.sum(total_of).alias("_sum")] if total_of else []))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    shift = sizes.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of"), before("count").alias("_shift"),
                         *([before("_sum").alias("_ahead")] if total_of else []))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_of")]
    place = Window.partitionBy(*keys, "_part").orderBy(*order)
    numbered = parts.withColumn("_inside", F.row_number().over(place))
    if total_of:
        numbered = numbered.withColumn(total, F.sum(total_of).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    out = (
        numbered.join(shift, reduce(lambda a, b: a & b, same))
        .withColumn(name, (F.col("_inside") + F.col("_shift")).cast("bigint")).drop("_inside", "_part", "_shift", "_of", *[f"_key{i}" for i in range(len(keys))])
    )
    return out.withColumn(total, F.col(total) + F.col("_ahead")).drop("_ahead") if total_of else out
