"""Choosing one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest values of order; equal ones are settled by the remaining columns' hash.

    An aggregation with map-side combine, so that a key with many deliveries doesn't gather in one task. Rows with a null
    key are left out. Columns other than the keys keep their names.
    """
    rest = [c for c in df.columns if c not in keys]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    rank = F.struct(*[F.col(f"`{c}`") for c in order], tie)
    kept = df
    for k in keys:
        kept = kept.filter(F.col(f"`{k}`").isNotNull())
    if not rest:
        return kept.dropDuplicates(keys)
    best = kept.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)
