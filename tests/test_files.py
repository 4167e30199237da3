"""Trees of real files through scan, backup and restore."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lamina.operators import filters
from lamina.plans import options as O
from lamina.plans.archive import Archive, ChecksumError, content_cuts
from lamina.plans.restore import extents, restore_files
from lamina.sources import scan
from lamina.streaming.stream import file_stream, latest_in_stream, packet_stream, stream_backup, stream_restore

DAY = datetime(2024, 1, 1)
SCHEMA = "path string, size long, mtime timestamp, content binary"


def tree(root):
    r = random.Random(3)
    os.makedirs(f"{root}/d/e")
    files = {"plain": b"hello", "d/empty": b"", "d/e/noise.bin": r.randbytes(70_000), "d/holes": b"a" * 4096 + b"\0" * 40_960 + b"z"}
    for name, data in files.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    os.chmod(f"{root}/plain", 0o640)
    os.utime(f"{root}/plain", (1_600_000_000, 1_600_000_000))
    os.link(f"{root}/plain", f"{root}/zz_hard")
    os.link(f"{root}/plain", f"{root}/d/hard")
    os.symlink("plain", f"{root}/to_file")
    os.symlink("d", f"{root}/to_dir")
    os.symlink("nowhere", f"{root}/broken")
    os.symlink("nowhere/", f"{root}/broken_dir")
    return files


def backed_up(spark, tmp_path, **kw):
    files = tree(f"{tmp_path}/in")
    items = scan.with_contents(scan.scan_tree(spark, [f"{tmp_path}/in"], relative=True))
    a = Archive(spark, f"file://{tmp_path}/arc", block=512, **kw)
    a.backup(items, DAY, ["in"])
    return a, files


def test_all_types_round_trip(spark, tmp_path):
    a, files = backed_up(spark, tmp_path)
    out = f"{tmp_path}/out"
    done = restore_files(a, 1, out)
    assert done["files"] == len(files) and done["hard_links"] == 2 and done["links"] == 4 and done["dirs"] == 2
    for name, data in files.items():
        with open(f"{out}/{name}", "rb") as f:
            assert f.read() == data
    assert os.stat(f"{out}/plain").st_ino == os.stat(f"{out}/zz_hard").st_ino == os.stat(f"{out}/d/hard").st_ino
    assert {n: os.readlink(f"{out}/{n}") for n in ("to_file", "to_dir", "broken", "broken_dir")} == {"to_file": "plain", "to_dir": "d", "broken": "nowhere", "broken_dir": "nowhere/"}
    assert os.stat(f"{out}/plain").st_mode & 0o777 == 0o640 and os.stat(f"{out}/plain").st_mtime == 1_600_000_000
    assert done["written"] < done["bytes"] and os.stat(f"{out}/d/holes").st_blocks * 512 < 40_960
    with pytest.raises(FileExistsError):
        restore_files(a, 1, out)
    restore_files(a, 1, out, overwrite=True)
    d = a.details().first()
    assert (d["dirs"], d["links"], d["hard_links"]) == (2, 4, 2)
    assert {r["path"]: r["type"] for r in a.contents(1).collect()}["to_dir"] == "symlink"
    assert a.backup(scan.with_contents(scan.scan_tree(spark, [f"{tmp_path}/in"], relative=True)), DAY) == 2
    assert a.snapshots().filter("set_no = 2").first()["added_files"] == 0


def test_hard_link_without_its_owner(spark, tmp_path):
    a, files = backed_up(spark, tmp_path)
    wanted = spark.createDataFrame([("zz_hard",), ("plain",)], "path string")
    restore_files(a, 1, f"{tmp_path}/two", wanted)
    assert os.stat(f"{tmp_path}/two/plain").st_ino == os.stat(f"{tmp_path}/two/zz_hard").st_ino
    with open(f"{tmp_path}/two/plain", "rb") as f:
        assert f.read() == files["plain"]
    rows = {r["path"]: bytes(r["content"]) for r in a.restore(1, wanted).collect()}
    assert rows == {"zz_hard": b"hello", "plain": b"hello"}


def test_paths_outside_are_refused(spark, tmp_path):
    a = Archive(spark, f"file://{tmp_path}/arc", block=512)
    a.backup(spark.createDataFrame([("/etc/x", 1, DAY, bytearray(b"1")), ("a/../../y", 1, DAY, bytearray(b"2"))], SCHEMA), DAY)
    with pytest.raises(Exception, match="not a path below"):
        restore_files(a, 1, f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out/etc")


def test_scan(spark, tmp_path):
    tree(f"{tmp_path}/in")
    rows = {r["path"]: r for r in scan.scan_tree(spark, [f"{tmp_path}/in"], relative=True, excludes=[f"{tmp_path}/in/d/e"], xattrs="user").collect()}
    assert set(rows) == {"plain", "zz_hard", "to_file", "to_dir", "broken", "broken_dir", "d", "d/empty", "d/holes", "d/hard"}
    assert rows["plain"]["inode"] == rows["d/hard"]["inode"] and rows["to_dir"]["type"] == "symlink" and rows["plain"]["mode"] & 0o777 == 0o640
    order = [r["path"] for r in scan.scan_order(scan.scan_tree(spark, [f"{tmp_path}/in"], relative=True)).collect()]
    assert order[:2] == ["plain", "zz_hard"] and order.index("to_file") < order.index("d") < order.index("d/empty")
    assert sorted(r["path"] for r in scan.scan_tree(spark, [f"{tmp_path}/in/to_*", f"{tmp_path}/in/plain"], relative=True).collect()) == ["plain", "to_dir", "to_file"]
    with pytest.raises(O.SkippedItems):
        scan.scan_tree(spark, [f"{tmp_path}/none"])
    assert scan.scan_tree(spark, [f"{tmp_path}/none"], skip_unreadable=True).count() == 0
    got = scan.binary_files(spark, f"{tmp_path}/in/d", "h*").select("size").collect()
    assert sorted(r[0] for r in got) == [5, 45_057]
    assert scan.stream_item(spark, b"abc").select("path", "size").first() == ("stdin", 3)
    kinds = spark.createDataFrame([("file",), ("symlink",), ("pipe",), ("socket",), ("dir",)], "type string")
    assert sorted(r[0] for r in filters.route_types(kinds, follow_links=True, pipes=True).collect()) == ["dir", "file", "file", "pipe"]
    assert filters.top_level_only(spark.createDataFrame([("a",), ("a/b",)], "path string")).count() == 1


def test_the_archive_is_not_part_of_itself(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    a = Archive(spark, f"file://{tmp_path}/in/arc", block=512)
    for _ in range(2):
        with open(f"{tmp_path}/in/x", "w") as f:
            f.write("1")
        a.backup(scan.with_contents(scan.scan_tree(spark, [f"{tmp_path}/in"])), DAY)
    assert [r["path"] for r in a.contents(2).collect()] == [f"{tmp_path}/in/x"]


def test_shifted_contents_are_found_again(spark, tmp_path):
    r = random.Random(9)
    data = r.randbytes(65_811)
    rows = spark.createDataFrame([("a", len(data), DAY, bytearray(data)), ("b", len(data) + 1, DAY, bytearray(b"!" + data))], SCHEMA)
    stored = {}
    for cut in ("aligned", "content"):
        a = Archive(spark, f"file://{tmp_path}/{cut}", block=1024, cut=cut)
        a.backup(rows, DAY)
        assert {x["path"]: bytes(x["content"]) for x in a.restore(1).collect()} == {"a": data, "b": b"!" + data}
        stored[cut] = a.statistics().first()["stored_bytes"]
    assert stored["aligned"] > 1.9 * len(data) and stored["content"] < 1.1 * len(data)
    import numpy as np

    for x in (b"", b"\0" * 100_000, data):
        ends = content_cuts(np.frombuffer(x, np.uint8), 1024)
        sizes = np.diff([0, *ends])
        assert (ends[-1] if ends else 0) == len(x) and (len(sizes) < 2 or sizes[:-1].min() >= 256) and (len(sizes) == 0 or sizes.max() <= 4096)


def test_levels_and_checksums(spark, tmp_path):
    noise, prose = random.Random(1).randbytes(200_000), b"all work and no play " * 9000
    rows = spark.createDataFrame([("n.bin", len(noise), DAY, bytearray(noise)), ("p.txt", len(prose), DAY, bytearray(prose)), ("p.jpg", len(prose) + 1, DAY, bytearray(prose + b"."))], SCHEMA)
    sizes = []
    for level in range(5):
        a = Archive(spark, f"file://{tmp_path}/{level}", block=65536, level=level)
        a.backup(rows, DAY)
        assert {x["path"]: bytes(x["content"]) for x in a.restore(1).collect()} == {"n.bin": noise, "p.txt": prose, "p.jpg": prose + b"."}
        d = a.details().first()
        assert d["raw_files"] == 2 and d["stored_bytes"] >= d["compressed_bytes"] >= len(noise)
        sizes.append(d["compressed_bytes"])
    assert sizes[0] == max(sizes) and sizes[2] < sizes[0]
    chunks = a.chunks().agg(F.sum("payload_length"), F.sum("compressed_length")).first()
    assert tuple(chunks) == (a.details().first()["stored_bytes"], sizes[4])
    assert a.index().count() == a.packets().count()
    a._known[1] = a.manifest(1) | {"index": "0-0"}
    with pytest.raises(ChecksumError):
        a.index()


def test_options():
    assert O.Options(O.FULL, "a", ("x",)).level == 2
    wrong = [
        dict(mode="x", archive="a"), dict(mode=O.FULL, archive="", sources=("x",)), dict(mode=O.FULL, archive="a"), dict(mode=O.RESTORE, archive="a"),
        dict(mode=O.FULL, archive="a", sources=("x",), level=9), dict(mode=O.FULL, archive="a", sources=("x",), block=100), dict(mode=O.LIST, archive="a", sources=("x",)),
        dict(mode=O.FULL, archive="a", sources=("x", "./x/")), dict(mode=O.INCREMENT, archive="a", sources=(O.STDIN,)), dict(mode=O.FULL, archive="a", sources=(O.STDIN, "x")),
        dict(mode=O.RESTORE, archive="a", target="t", predicate="size > 1"), dict(mode=O.RESTORE, archive="a", target="t", wanted=("/etc",)), dict(mode=O.FULL, archive="a", sources=("x",), xattrs="some"),
        dict(mode=O.FULL, archive="a", sources=("x",), set_no=1), dict(mode=O.LIST, archive="a", overwrite=True), dict(mode=O.LIST, archive="a", set_no=0),
    ]
    for w in wrong:
        with pytest.raises(O.OptionError):
            O.Options(**w)
    with pytest.raises(O.ArchiveExists):
        O.Options(O.FULL, "a", ("x",)).check_archive(True)
    with pytest.raises(O.ArchiveMissing):
        O.Options(O.LIST, "a").check_archive(False)
    assert O.argument_order(["b/c", "a", "./d"]) == ["a", "./d", "b/c"]
    assert O.Options(O.FULL, "a", ("x",), excludes=("/nowhere", "/tmp/")).existing_excludes() == ("/tmp",)


def test_extents():
    assert extents(b"\0" * 8192) == [] and extents(b"a" + b"\0" * 8191, 4096) == [(0, 4096)]
    r = random.Random(4)
    for _ in range(50):
        data = b"".join((b"\0" if r.random() < 0.5 else b"x") * r.randrange(9000) for _ in range(6))
        back = bytearray(len(data))
        for a, n in extents(data):
            back[a : a + n] = data[a : a + n]
        assert bytes(back) == data


def small(spark, files):
    return spark.createDataFrame([(p, len(c), DAY, bytearray(c)) for p, c in files.items()], SCHEMA)


def test_a_batch_is_stored_once(spark, tmp_path):
    for i in range(3):
        small(spark, {f"s/{i}": b"x" * i}).coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    a = Archive(spark, f"file://{tmp_path}/arc", block=512)

    def run():
        stream_backup(file_stream(spark, f"{tmp_path}/in/*", "*.parquet", small(spark, {"x": b""}).schema, per_batch=1), a, f"{tmp_path}/mark")

    run()
    assert len(a.committed()) == 3
    last = sorted(os.listdir(f"{tmp_path}/mark/commits"), key=lambda n: n.lstrip("."))[-1]
    for n in os.listdir(f"{tmp_path}/mark/commits"):
        if n.strip(".").removesuffix(".crc") == last:
            os.unlink(f"{tmp_path}/mark/commits/{n}")
    run()
    assert len(a.committed()) == 3 and a.items().count() == 3


def test_restore_from_a_stream(spark, tmp_path):
    r = random.Random(8)
    files = {f"d/{i}": r.randbytes(r.choice([0, 5, 700, 5000])) for i in range(12)}
    files |= {"copy": files["d/3"], "none": b""}
    a = Archive(spark, f"file://{tmp_path}/arc", block=512)
    a.backup(small(spark, files), DAY)
    packet_stream(a, 1).repartition(7).write.parquet(f"{tmp_path}/packets")
    stream = file_stream(spark, f"{tmp_path}/packets", "*.parquet", spark.read.parquet(f"{tmp_path}/packets").schema, per_batch=2)
    assert {x["path"]: bytes(x["content"]) for x in stream_restore(stream, spark).collect()} == files


def test_latest_in_stream(spark, tmp_path):
    spark.createDataFrame([(i % 3, i) for i in range(20)], "k long, at long").repartition(3).write.parquet(f"{tmp_path}/in")
    out = latest_in_stream(file_stream(spark, f"{tmp_path}/in", "*.parquet", "k long, at long", per_batch=1), "k", "at", spark)
    assert sorted(map(tuple, out.collect())) == [(0, 18), (1, 19), (2, 17)]
