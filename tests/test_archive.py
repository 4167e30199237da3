import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lamina.plans.archive import Archive
from lamina.streaming.stream import file_stream, stream_backup

SCHEMA = "path string, size long, mtime timestamp, content binary"
DAY = datetime(2024, 1, 1)


def items(spark, files, mtime=DAY):
    return spark.createDataFrame([(p, len(c), mtime, bytearray(c)) for p, c in files.items()], SCHEMA)


def back(archive, n, wanted=None):
    return {r["path"]: bytes(r["content"]) for r in archive.restore(n, wanted).collect()}


def test_round_trip_and_increment(spark, tmp_path):
    r = random.Random(1)
    files = {f"d{i % 3}/f{i}": bytes(r.randrange(256) for _ in range(r.choice([0, 1, 511, 512, 513, 4000]))) for i in range(25)}
    files["d0/copy"] = files["d1/f1"]
    files["zeros"] = b"\0" * 5000
    a = Archive(spark, f"file://{tmp_path}/arc", block=512)
    assert a.backup(items(spark, files), DAY) == 1
    assert back(a, 1) == files
    changed = dict(files, new=b"new") | {"d0/f0": b"other"}
    later = items(spark, changed).withColumn("mtime", F.when(F.col("path").isin("new", "d0/f0"), F.lit(datetime(2024, 2, 1))).otherwise(F.col("mtime")))
    assert a.backup(later, datetime(2024, 2, 1)) == 2
    assert back(a, 2) == changed and back(a, 1) == files
    s = {x["set_no"]: x for x in a.snapshots().collect()}
    assert s[2]["added_files"] == 2 and s[2]["stored_bytes"] == len(b"new") + len(b"other")
    assert s[1]["stored_bytes"] < s[1]["bytes"]
    only = back(a, 2, spark.createDataFrame([("d1",)], "path string"))
    assert only == {p: c for p, c in changed.items() if p.startswith("d1/")}
    with pytest.raises(ValueError):
        a.restore(2, spark.createDataFrame([("nothing",)], "path string"))
    with pytest.raises(ValueError):
        a.restore(3)
    assert [x["files"] for x in a.list_snapshots().orderBy("set_no").collect()] == [len(files), len(changed)]


def test_uncommitted_snapshot_is_invisible(spark, tmp_path):
    a = Archive(spark, f"file://{tmp_path}/arc", block=512)
    a._commit, kept = (lambda *_: (_ for _ in ()).throw(RuntimeError("killed"))), a._commit
    with pytest.raises(RuntimeError):
        a.backup(items(spark, {"x": b"1"}), DAY)
    a._commit = kept
    assert a.committed() == [] and a.items().count() == 0
    assert a.backup(items(spark, {"x": b"1"}), DAY) == 1 and back(a, 1) == {"x": b"1"}


def test_streamed_backup(spark, tmp_path):
    items(spark, {"s/a": b"aaa", "s/b": b""}).write.parquet(f"{tmp_path}/in")
    a = Archive(spark, f"file://{tmp_path}/arc", block=512)
    stream_backup(file_stream(spark, f"{tmp_path}/in", "*.parquet", items(spark, {"x": b""}).schema), a, f"{tmp_path}/mark")
    assert back(a, 1) == {"s/a": b"aaa", "s/b": b""}
