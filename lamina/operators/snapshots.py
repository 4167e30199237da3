"""What changed between two snapshots of the same items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one aggregation with map-side combine, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return best.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*df.columns)


def unchanged(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of now that stand in before with the same key and times."""
    return now.join(before.select(*keys).distinct(), keys, "left_semi")


def changed(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    return now.join(before.select(*keys).distinct(), keys, "left_anti")


def status(now: DataFrame, before: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """key, status: new, deleted, changed or unchanged."""
    a = now.select(key, F.struct(*compare).alias("_now"))
    b = before.select(F.col(key).alias("_key"), F.struct(*compare).alias("_before"))
    both = a.join(b, a[key] == b["_key"], "full_outer")
    what = F.when(F.col("_key").isNull(), "new").when(F.col(key).isNull(), "deleted").when(F.col("_now").eqNullSafe(F.col("_before")), "unchanged").otherwise("changed")
    return both.select(F.coalesce(key, "_key").alias(key), what.alias("status"))
