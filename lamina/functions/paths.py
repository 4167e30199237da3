"""Paths: names, extensions, parents, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(name_of(path), r"\.([^.]*)$", 1)


def tidy(path: Column) -> Column:
    """One slash for backslashes and runs, without ./ in front or / at the end."""
    p = F.regexp_replace(path, r"[/\\]+", "/")
    p = F.regexp_replace(p, r"^(\./)+", "")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/$", ""))


def relative(path: Column) -> Column:
    """The path, or an error if it is absolute."""
    return F.when(path.startswith("/"), F.raise_error(F.concat(F.lit("absolute path: "), path))).otherwise(path)


def within(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def ancestors(path: Column) -> Column:
    """The path and all its parents: what a prefix test is as an equality."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def common_parent(df: DataFrame, path: str) -> DataFrame:
    """One row: the longest common parent of all paths, from the least and the greatest alone."""
    ends = df.agg(F.min(path).alias("a"), F.max(path).alias("b"))
    pa, pb = F.slice(F.split("a", "/"), 1, F.size(F.split("a", "/")) - 1), F.slice(F.split("b", "/"), 1, F.size(F.split("b", "/")) - 1)
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(pa), F.size(pb)), F.lit(1))), lambda n: F.slice(pa, F.lit(1), n) == F.slice(pb, F.lit(1), n))
    return ends.select(F.array_join(F.slice(pa, F.lit(1), F.when((F.size(pa) > 0) & (F.size(pb) > 0), F.coalesce(F.array_max(same), F.lit(0))).otherwise(0)), "/").alias("parent"))


def absolute(path: Column, base: str) -> Column:
    """The tidied path, below base if it is relative."""
    p = tidy(path)
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))


def same(a: Column, b: Column, base: str = "") -> Column:
    """Whether two paths name one place, by their tidied text."""
    return absolute(a, base) == absolute(b, base)


def without_delimiter(path: Column, where: str = "both") -> Column:
    """Without delimiters at the start, the end, or both."""
    out = F.regexp_replace(path, r"^[/\\]+", "") if where in ("start", "both") else path
    return F.regexp_replace(out, r"[/\\]+$", "") if where in ("end", "both") else out


def identity_case(path: Column, sensitive: bool = True) -> Column:
    """The path as file systems compare it."""
    return path if sensitive else F.lower(path)
