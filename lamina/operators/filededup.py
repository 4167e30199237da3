"""Whole items: identical contents, hard links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = 1024


def exact(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, size, hash, canonical (least key of the same content), is_duplicate. Only hashes are exchanged."""
    rows = items.select(key, "size", F.md5("content").alias("hash"))
    first = rows.groupBy("size", "hash").agg(F.min(key).alias("canonical"))
    return rows.join(first, ["size", "hash"]).select(key, "size", "hash", "canonical", (F.col(key) != F.col("canonical")).alias("is_duplicate"))


def progressive(items: DataFrame, key: str = "doc_id", stored: bool = True) -> DataFrame:
    """The same answer; full contents are hashed only where size, head hash and tail byte agree with another item's."""
    head = F.xxhash64(F.substring(F.col("content"), 1, HEAD))
    tail = F.pmod(F.xxhash64(F.substring(F.col("content"), F.greatest(F.col("size") - HEAD + 1, F.lit(1)).cast("int"), F.lit(HEAD))), F.lit(256))
    marks = items.select(key, "size", head.alias("first"), tail.alias("last"))
    shared = marks.groupBy("size", "first", "last").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    maybe = marks.join(shared, ["size", "first", "last"], "left_semi").select(key)
    full = items.join(maybe, key, "left_semi").select(key, "size", F.md5("content").alias("hash"))
    first = full.groupBy("size", "hash").agg(F.min(key).alias("canonical"))
    found = full.join(first, ["size", "hash"]).select(F.col(key).alias("_k"), "canonical")
    out = marks.select(key, "size").join(found, F.col(key) == F.col("_k"), "left")
    return out.select(key, "size", F.coalesce("canonical", key).alias("canonical"))


def savings(items: DataFrame, group: str, key: str = "doc_id") -> DataFrame:
    """Files and bytes by group, and how many of them are duplicates of an earlier item anywhere."""
    marked = exact(items, key).join(items.select(key, group), key)
    dup = F.col("is_duplicate")
    return marked.groupBy(group).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(dup).alias("duplicate_files"), F.coalesce(F.sum(F.when(dup, F.col("size"))), F.lit(0)).alias("duplicate_bytes"))


def hard_links(items: DataFrame, device: str, inode: str, order: list[str]) -> DataFrame:
    """One row for each (device, inode): its first item owns the payload; the others are links."""
    return items.groupBy(device, inode).agg(F.min(F.struct(*order)).alias("owner"), F.count(F.lit(1)).alias("members"))


def relink(selected: DataFrame, key: str, group: str, owner: str) -> DataFrame:
    """Hard links of a selection: the group's owner if selected, else the least selected member becomes owner."""
    first = selected.groupBy(group).agg(F.min(F.when(F.col(key) == F.col(owner), F.col(key))).alias("_own"), F.min(key).alias("_least"))
    return selected.join(first, group).withColumn("restored_owner", F.coalesce("_own", "_least")).drop("_own", "_least")
