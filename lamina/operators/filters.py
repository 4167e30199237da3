"""Which items take part: exclusions, types, predicates, extensions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.paths import ancestors, within

# Extensions of file types that do not compress.
HIGH_ENTROPY = ["jpg", "mp4", "mpeg", "wmv", "jpeg", "png", "avi", "mov", "flv", "aac", "ogg", "mp3", "webp", "mkv"]


def exclude(items: DataFrame, excludes: DataFrame, path: str = "path") -> DataFrame:
    """items without the excluded paths and all below them. excludes: path.

    A prefix is an equality with one of the item's ancestors, so this is a hash join, not a nested loop.
    """
    key = next(n for n in ("_item", *(f"_item{i}" for i in range(99))) if n not in items.columns)
    keyed = items.withColumn(key, F.monotonically_increasing_id())
    hit = keyed.select(key, F.explode(ancestors(F.col(path))).alias("_p")).join(excludes.select(F.col("path").alias("_p")).distinct(), "_p", "left_semi").select(key).distinct()
    return keyed.join(hit, key, "left_anti").drop(key)


def exclude_few(items: DataFrame, paths: list[str], path: str = "path") -> DataFrame:
    """The same for a short list: a filter in the scan, without any exchange."""
    keep = F.lit(True)
    for p in paths:
        keep = keep & ~within(F.col(path), F.lit(p))
    return items.filter(keep)


def route_types(items: DataFrame, follow_links: bool = False, pipes: bool = False, kind: str = "type") -> DataFrame:
    """Files, links and directories; links as files if followed; pipes only if wanted; sockets never."""
    typed = items.withColumn(kind, F.when(F.lit(follow_links) & (F.col(kind) == "symlink"), "file").otherwise(F.col(kind)))
    return typed.filter(F.col(kind).isin("file", "symlink", "dir", *(["pipe"] if pipes else [])))


def top_level_only(items: DataFrame, path: str = "path") -> DataFrame:
    return items.filter(F.size(F.split(path, "/")) <= 1)


def predicate_columns(items: DataFrame, size: str = "size", time: str | None = None) -> DataFrame:
    """items with the columns that predicates see; months count from 1, day is the day of the month, dow 0 is Sunday."""
    from lamina.functions.paths import extension, name_of

    out = items.withColumns({"name": name_of(F.col("path")), "ext": extension(F.col("path")), "size": F.col(size)})
    if time:
        t = F.col(time)
        out = out.withColumns({"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "dow": F.dayofweek(t) - 1, "hour": F.hour(t), "min": F.minute(t), "sec": F.second(t)})
    return out


def where(items: DataFrame, predicate: str | Column | Callable[[pd.DataFrame], pd.Series], on_error: str = "fail") -> DataFrame:
    """Rows for which a predicate holds: SQL text, a column, or a function of a batch of rows. A null is no.

    on_error, for functions: "fail" ends the job with the function's own error; "drop" and "keep" leave out or keep just
    the rows on which it fails (a batch that fails is asked row by row).
    """
    if on_error not in ("fail", "drop", "keep"):
        raise ValueError(f"on_error is fail, drop or keep, not {on_error!r}")
    if isinstance(predicate, str):
        predicate = F.expr(predicate)
    if isinstance(predicate, Column):
        return items.filter(F.coalesce(predicate, F.lit(False)))
    columns = items.columns

    def asked(rows: pd.DataFrame) -> pd.Series:
        return predicate(rows).fillna(False).astype(bool)

    @F.pandas_udf("boolean")
    def test(rows: pd.DataFrame) -> pd.Series:
        try:
            return asked(rows)
        except Exception:
            if on_error == "fail":
                raise
            out = []
            for i in range(len(rows)):
                try:
                    out.append(bool(asked(rows.iloc[i : i + 1]).iloc[0]))
                except Exception:
                    out.append(on_error == "keep")
            return pd.Series(out, dtype=bool)

    return items.filter(test(F.struct(*columns)))


def high_entropy_name(path: Column, more: tuple[str, ...] = ()) -> Column:
    out = F.lit(False)
    for e in [*HIGH_ENTROPY, *more]:
        out = out | path.endswith(f".{e}")
    return out


def select_paths(items: DataFrame, wanted: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(items that a wanted path names or holds, wanted paths that match none). wanted: path."""
    asked = wanted.select(F.col("path").alias("_p")).distinct()
    each = items.withColumn("_p", F.explode(ancestors(F.col(path))))
    hit = each.join(asked, "_p", "left_semi").drop("_p").dropDuplicates([path])
    return hit, asked.join(each.select("_p").distinct(), "_p", "left_anti").withColumnRenamed("_p", "path")
