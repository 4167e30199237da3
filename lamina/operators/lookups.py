"""Range and as-of lookups, forward fill, and resolution of references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def containing(points: DataFrame, ranges: DataFrame, point: str, start: str, length: str, bucket: int) -> DataFrame:
    """points with the range [start, start + length) that holds them: an equality on buckets and a residual test."""
    last = F.col(start) + F.greatest(F.col(length) - 1, F.lit(0))
    wide = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(last / bucket))))
    return points.withColumn("_b", F.floor(F.col(point) / bucket)).join(wide, "_b").filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + F.col(length))).drop("_b")


def as_of(points: DataFrame, marks: DataFrame, point: str, at: str, value: str, buckets: int = 256) -> DataFrame:
    """points with the value of the last mark at or before them.

    Marks and points are merged in ranges of the order; a range whose points come before its first mark takes the
    last mark of the ranges before, of which there is one row each.
    """
    span = marks.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    width = max(1, (hi - lo + buckets) // buckets)
    rest = [c for c in points.columns if c != point]
    both = marks.select(F.col(at).alias("_at"), F.struct(F.col(value).alias("v")).alias("_v"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_p"))
    both = both.unionByName(points.select(F.col(point).alias("_at"), F.lit(None).cast(both.schema["_v"].dataType).alias("_v"), F.struct(*points.columns).alias("_p")))
    both = both.withColumn("_b", F.greatest(F.lit(-1), F.least(F.lit(buckets), F.floor((F.col("_at") - lo) / width))))
    w = W.partitionBy("_b").orderBy("_at", F.col("_p").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    filled = both.withColumn("_f", F.last("_v", ignorenulls=True).over(w))
    tops = both.groupBy("_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_t"))
    tops = tops.select("_b", F.last("_t", ignorenulls=True).over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_t"))
    out = filled.filter("_p is not null").join(F.broadcast(tops), "_b")
    return out.select(F.col(f"_p.{point}").alias(point), *[F.col(f"_p.{c}").alias(c) for c in rest], F.coalesce("_f", "_t")["v"].alias(value))


def forward_fill(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def changes_only(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    return df.withColumn("_prev", F.lag(value).over(W.partitionBy(*keys).orderBy(order))).filter(~F.col(value).eqNullSafe(F.col("_prev"))).drop("_prev")


def resolve_roots(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root of each node by pointer jumping: the depth halves with each join. links: node, ref (null at a root)."""
    from lamina.plans.workspace import save

    now = links.select("node", F.coalesce("ref", "node").alias("root"))
    for _ in range(rounds):
        jump = now.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        nxt = save(now.join(jump, now["root"] == jump["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"), (F.coalesce("_r", "root") != F.col("root")).alias("_moved")), "resolve")
        now = nxt.select("node", "root")
        if not nxt.filter("_moved").limit(1).count():
            return now
    raise ValueError("the references hold a cycle")
