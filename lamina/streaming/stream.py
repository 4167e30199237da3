"""Backup and restore as streams: each micro-batch is a snapshot; a restore reads packets in the order they come."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.plans.archive import Archive, _joined
from lamina.plans.workspace import new_folder

PACKET = "ord long, kind string, file_id long, path string, size long, mtime timestamp, hash string, body long, blocks int, no int, codec string, bytes binary, length int"


def stream_backup(stream: DataFrame, archive: Archive, checkpoint: str) -> None:
    """Write every batch of items (path, size, mtime, content) as a snapshot until the source is drained.

    The manifest of a snapshot names the stream (its checkpoint) and the batch, so a batch that is met again after a
    failure is not stored again, however many sets there were; an empty batch makes no snapshot.
    """
    name = hashlib.md5(checkpoint.encode()).hexdigest()

    def put(batch: DataFrame, number: int) -> None:
        if f"{name}:{number}" not in archive.batches() and not batch.isEmpty():
            archive.backup(batch, datetime(2000, 1, 1), [f"batch {number}"], batch=f"{name}:{number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def packet_stream(archive: Archive, set_no: int) -> DataFrame:
    """A snapshot as the rows of a single pass: an item row for each file, and each distinct file's blocks, in order.

    Files with the contents of another one in the snapshot (duplicates, hard links) have no blocks; body names the file
    whose blocks are theirs.
    """
    rows = archive.contents(set_no).filter("type = 'file'").withColumn("_owner", F.coalesce("hard_link_of", "file_id"))
    bodies = archive.items().select(F.col("file_id").alias("_owner"), F.col("hash").alias("_hash"), F.col("size").alias("_size"), F.size("blocks").alias("_n"))
    rows = rows.join(bodies, "_owner").withColumn("hash", F.col("_hash"))
    least = rows.groupBy("hash", "_size").agg(F.min("file_id").alias("body"))
    rows = rows.join(least, ["hash", "_size"])
    head = rows.select((F.col("body") * 2).alias("ord"), F.lit("item").alias("kind"), "file_id", "path", "size", "mtime", "hash", "body", F.col("_n").alias("blocks"))
    first = rows.filter("file_id = body").select("file_id", "_owner")
    blocks = archive.items().select(F.col("file_id").alias("_owner"), F.posexplode("blocks").alias("no", "block")).join(first, "_owner")
    packets = archive.packets().select(F.col("hash").alias("block"), "codec", "bytes", "length")
    body = blocks.join(packets, "block").select((F.col("file_id") * 2 + 1).alias("ord"), F.lit("packet").alias("kind"), F.col("file_id").alias("body"), "no", "codec", "bytes", "length")
    return head.unionByName(body, allowMissingColumns=True).orderBy("ord", "file_id", "no")


def stream_restore(stream: DataFrame, spark: SparkSession, label: str = "restored") -> DataFrame:
    """path, size, mtime, content of the files of a drained packet stream.

    Each batch is stored by its number (a batch that comes again replaces itself), and every file whose blocks have all
    come is given out then; what shares another file's contents waits for the end of the stream. State is the packets of
    files that are not complete.
    """
    root, mark = new_folder(spark, label), new_folder(spark, f"{label}-checkpoint")
    schema = stream.schema
    state = f"{root}/state"
    spark.createDataFrame([], schema).write.parquet(f"{state}/start")
    held: dict[str, str] = {"last": "start"}

    def put(batch: DataFrame, number: int) -> None:
        before = f"batch-{number - 1}" if number and held["last"] != f"batch-{number}" else held.get("before", "start")
        rows = spark.read.schema(schema).parquet(f"{state}/{before}").unionByName(batch)
        items = rows.filter("kind = 'item' and file_id = body")
        packets = rows.filter("kind = 'packet'")
        come = packets.groupBy("body").agg(F.count(F.lit(1)).alias("_come"))
        ready = items.join(come, "body", "left").filter("coalesce(_come, 0) = blocks").drop("_come")
        parts = packets.groupBy("body").agg(F.collect_list(F.struct("no", "codec", "bytes", "length")).alias("parts"))
        whole = ready.join(parts, "body", "left").select("file_id", "hash", "path", "parts").mapInArrow(_joined(True), "_f long, content binary")
        out = ready.join(whole, ready["file_id"] == whole["_f"]).select("file_id", "path", "size", "mtime", "content")
        out.write.mode("overwrite").parquet(f"{root}/files/batch={number}")
        done = ready.select("body")
        left = rows.filter("kind = 'packet' or file_id = body").join(done, "body", "left_anti")
        left.unionByName(rows.filter("kind = 'item' and file_id <> body")).write.mode("overwrite").parquet(f"{state}/batch-{number}")
        held["before"], held["last"] = before, f"batch-{number}"

    stream.writeStream.foreachBatch(put).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    columns = "file_id long, path string, size long, mtime timestamp, content binary"
    if held["last"] == "start":
        return spark.createDataFrame([], columns).drop("file_id")
    files = spark.read.schema(columns).option("recursiveFileLookup", True).parquet(f"{root}/files")
    late = spark.read.schema(schema).parquet(f"{state}/{held['last']}")
    if missing := [r[0] for r in late.filter("kind = 'packet' or file_id = body").select(F.coalesce("path", F.col("body").cast("string"))).limit(5).collect()]:
        raise ValueError(f"the stream ended before all blocks came: {missing}")
    others = late.select("path", "size", "mtime", "body").join(files.select(F.col("file_id").alias("body"), "content"), "body").select("path", "size", "mtime", "content")
    return files.drop("file_id").unionByName(others)


def stream_copy(stream: DataFrame, spark: SparkSession, label: str = "stream") -> DataFrame:
    """Append a drained stream to a table through the exactly-once file sink, and read it again."""
    out, mark = new_folder(spark, label), new_folder(spark, f"{label}-checkpoint")
    schema = stream.schema
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


def file_stream(spark: SparkSession, folder: str, name: str, schema, per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)


def latest_in_stream(stream: DataFrame, key: str, order: str, spark: SparkSession) -> DataFrame:
    """The last row of each key of a drained stream: state is one row for each key; every batch writes what it changed."""
    rest = [c for c in stream.columns if c != key]
    agg = stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last"))
    out, mark = new_folder(spark, "latest"), new_folder(spark, "latest-checkpoint")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch-{number}")

    agg.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(out)
    last = rows.groupBy(key).agg(F.max_by("last", "_batch").alias("last"))
    return last.select(key, *[F.col(f"last.{c}").alias(c) for c in rest])
