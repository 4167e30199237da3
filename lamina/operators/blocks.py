"""The payload space, its chunks, and repeats of aligned blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.plans.workspace import save

SMALL, LARGE, CHUNK = 4096, 131072, 1 << 20


def payload_offsets(items: DataFrame, order: str, size: str = "size", base: int = 0, buckets: int = 256, name: str = "payload") -> DataFrame:
    """items with the running sum of the sizes before them in the order of a whole-number column.

    Two levels: items are cut into equal ranges of the order; sums of ranges (as many as buckets) are summed up and
    added to the running sums inside ranges, so no window holds all rows.
    """
    span = items.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = (span["lo"] or 0), (span["hi"] or 0)
    bucket = F.least(F.floor((F.col(order) - lo) * F.lit(float(buckets)) / F.lit(float(hi - lo + 1))), F.lit(buckets - 1)).cast("int")
    rows = items.withColumn("_bucket", bucket)
    sums = rows.groupBy("_bucket").agg(F.sum(size).alias("_sum"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return rows.join(F.broadcast(sums), "_bucket").withColumn(name, F.col("_in") + F.col("_base") + F.lit(base)).drop("_bucket", "_in", "_base")


def chunk_of(offset: Column, chunk: int = CHUNK) -> Column:
    return F.floor(offset / F.lit(chunk)).cast("long")


def chunk_assignment(items: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """items with first and last chunk and whether they straddle; an empty item lies in the chunk of its offset."""
    first = chunk_of(F.col("payload"), chunk)
    last = chunk_of(F.col("payload") + F.greatest(F.col("size") - 1, F.lit(0)), chunk)
    return items.withColumns({"first_chunk": first, "last_chunk": last, "straddles": first != last})


def blocks(items: DataFrame, block: int = SMALL, keep: tuple[str, ...] = ("doc_id",), offsets: DataFrame | None = None) -> DataFrame:
    """The full aligned blocks of each item: keep, block_no, offset (payload + place), hash.

    offsets: the payload of each item by the first of keep, where items do not carry it. Contents are cut and hashed where
    they are read; only hashes move.
    """
    n = F.floor(F.col("size") / block).cast("int")
    own = ["payload"] if offsets is None else []
    rows = items.filter(F.col("size") >= block).select(*keep, *own, "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("block_no"))
    rows = rows.select(*keep, *own, "block_no", F.md5(F.substring(F.col("content"), F.col("block_no") * block + 1, F.lit(block))).alias("hash"))
    if offsets is not None:
        rows = rows.join(offsets.select(keep[0], "payload"), keep[0])
    return rows.select(*keep, "block_no", (F.col("payload") + F.col("block_no").cast("long") * block).alias("offset"), "hash")


def block_index(rows: DataFrame) -> DataFrame:
    """hash, first offset, number of blocks: one row for each distinct block, however often it repeats."""
    return rows.groupBy("hash").agg(F.min("offset").alias("min_offset"), F.count(F.lit(1)).alias("n"))


def capped_index(rows: DataFrame, slots: int = 8, buckets: int = 1 << 16) -> DataFrame:
    """The bounded form: in each bucket only the last `slots` distinct blocks by offset."""
    index = block_index(rows).withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("min_offset")))
    return index.withColumn("slot", rank).filter(F.col("slot") <= slots)


def large_blocks(rows: DataFrame, fan: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Hash of the hashes of each full group of `fan` successive small blocks of an item."""
    group = F.floor(F.col("block_no") / fan).cast("int")
    parts = rows.groupBy(*keep, group.alias("large_no")).agg(F.array_sort(F.collect_list(F.struct("block_no", "hash", "offset"))).alias("b")).filter(F.size("b") == fan)
    return parts.select(*keep, "large_no", F.col("b")[0]["offset"].alias("offset"), F.md5(F.array_join(F.transform("b", lambda x: x["hash"]), "")).alias("hash"))


def prior_matches(rows: DataFrame, block: int, chunk: int = CHUNK) -> DataFrame:
    """rows whose block stands earlier, wholly before the row's own chunk: with ref, its least offset."""
    rows = save(rows, "blocks")  # cut and hashed once
    index = block_index(rows).filter("n > 1").select("hash", F.col("min_offset").alias("ref"))
    start = chunk_of(F.col("offset"), chunk) * chunk
    return rows.join(index, "hash").filter(F.col("ref") + block < start)


def match_runs(matches: DataFrame, block: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Successive matches whose references follow each other, as one reference: keep, offset, ref, length."""
    order = W.partitionBy(*keep).orderBy("offset")
    rows = matches.withColumn("_island", F.col("offset") - F.row_number().over(order) * block).withColumn("_shift", F.col("ref") - F.col("offset"))
    return rows.groupBy(*keep, "_island", "_shift").agg(F.min("offset").alias("offset"), F.min("ref").alias("ref"), (F.count(F.lit(1)) * block).alias("length")).drop("_island", "_shift")


def shared_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks that stand in both collections: hash, how often in each. Repeats are counted before the join."""
    x = a.groupBy("hash").agg(F.count(F.lit(1)).alias("n_a"))
    return x.join(b.groupBy("hash").agg(F.count(F.lit(1)).alias("n_b")), "hash")


def fill_ratio(rows: DataFrame, buckets: int, slots: int = 8) -> DataFrame:
    """Share of the used buckets that hold more distinct blocks than slots; the bucket is the first hex digits of the hash."""
    bucket = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % buckets
    full = rows.select("hash").distinct().groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return full.agg(F.count(F.lit(1)).alias("buckets"), F.count_if(F.col("n") > slots).alias("overfull"), F.round(F.avg((F.col("n") > slots).cast("double")), 6).alias("ratio"))


def zero_runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Gaps and islands: maximal runs of one value, by key in order: start, end, length."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_g", F.row_number().over(w) - F.row_number().over(W.partitionBy(*keys, value).orderBy(order)))
    return rows.groupBy(*keys, value, "_g").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("run_length")).drop("_g")
