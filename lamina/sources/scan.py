"""Items: the typed metadata relation that everything else works on."""

from __future__ import annotations

import glob
import os
import re
import stat
import sys
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.paths import extension, name_of, tidy
from lamina.plans.options import STDIN, SkippedItems, argument_order

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "map": T.MapType(T.StringType(), T.BinaryType())}
_FIELDS = "path string, type string, link string, size long, mtime timestamp, mtime_ms long, ctime_ms long, mode int, device long, inode long, sparse boolean, xattrs map, full_path string, error string"
ITEM = T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split(" ") for f in _FIELDS.split(", "))])
TYPE_RANK = {"file": 0, "symlink": 1, "dir": 2}
BATCH = 2000
_XATTRS = {"user": re.compile(r"^user\."), "all": re.compile("")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_items(docs: DataFrame, *more: str) -> DataFrame:
    """Documents as files source/lang/doc_id.txt with their bytes; more: columns to keep."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    content = F.encode("text", "UTF-8")
    return docs.select("doc_id", path.alias("path"), name_of(path).alias("name"), extension(path).alias("ext"), F.octet_length(content).cast("long").alias("size"), content.alias("content"), *more)


def binary_files(spark: SparkSession, root: str, pattern: str | None = None, skip_unreadable: bool = False) -> DataFrame:
    """path, mtime, size, content of all files under a root; content is only read if it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", skip_unreadable).option("ignoreCorruptFiles", skip_unreadable)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select(tidy("path").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def stream_item(spark: SparkSession, data: bytes | None = None) -> DataFrame:
    """Standard input (or the bytes given) as one anonymous item named stdin."""
    body = sys.stdin.buffer.read() if data is None else data
    return spark.createDataFrame([("stdin", len(body), datetime(1970, 1, 1, tzinfo=timezone.utc), bytearray(body), "file")], "path string, size long, mtime timestamp, content binary, type string")


def _kind(mode: int) -> str:
    for test, kind in ((stat.S_ISLNK, "symlink"), (stat.S_ISDIR, "dir"), (stat.S_ISREG, "file"), (stat.S_ISFIFO, "pipe"), (stat.S_ISSOCK, "socket")):
        if test(mode):
            return kind
    return "other"


def _xattr(path: str, which: str | None) -> list[tuple[str, bytes]] | None:
    if which is None:
        return None
    try:
        return [(n, os.getxattr(path, n, follow_symlinks=False)) for n in os.listxattr(path, follow_symlinks=False) if _XATTRS[which].search(n)]
    except OSError:
        return None


def _entry(path: str, base: str, which: str | None) -> tuple:
    short = os.path.relpath(path, base) if base else path
    try:
        s = os.lstat(path)
        kind = _kind(s.st_mode)
        to = os.readlink(path) if kind == "symlink" else None
        if kind == "file" and not os.access(path, os.R_OK):
            raise PermissionError(13, "cannot be read", path)
    except OSError as e:
        return (short, None, None, None, None, None, None, None, None, None, None, None, path, str(e))
    at = datetime.fromtimestamp(s.st_mtime_ns // 1000 / 1e6, timezone.utc)
    return (short, kind, to, s.st_size if kind == "file" else 0, at, s.st_mtime_ns // 10**6, s.st_ctime_ns // 10**6, s.st_mode, s.st_dev, s.st_ino, kind == "file" and s.st_blocks * 512 < s.st_size, _xattr(path, which), path, None)


def _walk(which: str | None, deep: bool):
    """Items of folders (whole trees if deep, else their entries), a batch at a time."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.map_(pa.string(), pa.binary()), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [f.name for f in ITEM.fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: list[tuple] = []
            for folder, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for at, dirs, files in os.walk(folder, followlinks=False):
                    for n in [*files, *dirs]:
                        rows.append(_entry(os.path.join(at, n), base, which))
                        if len(rows) >= BATCH:
                            yield batch(rows)
                            rows = []
                    if not deep:
                        break
            yield batch(rows)

    return run


def expand(sources: list[str]) -> list[str]:
    """Sources with their wildcards replaced by what matches, names without a delimiter first."""
    out: list[str] = []
    for s in argument_order(sources):
        hits = sorted(glob.glob(s)) if any(c in s for c in "*?[") else [s]
        out += [h for h in hits if h not in out]
    return out


def scan_tree(spark: SparkSession, roots: list[str], relative: bool = False, xattrs: str | None = None, skip_unreadable: bool = False, excludes: list[str] | None = None, never: str | None = None) -> DataFrame:
    """Metadata of all items under roots that every executor can reach.

    The driver lists the first level only; each folder found there is a task of its own. relative: paths below the root.
    What cannot be read raises SkippedItems, or is left out with skip_unreadable. excludes and never: left out with all below.
    """
    roots = expand([r for r in roots if r != STDIN])
    tops: list[tuple[str, str]] = []
    here: list[tuple[str, str]] = []
    for r in roots:
        base = r if relative else ""
        if os.path.isdir(r) and not os.path.islink(r):
            here.append((r, base))
            tops += [(os.path.join(r, n), base) for n in os.listdir(r) if os.path.isdir(os.path.join(r, n)) and not os.path.islink(os.path.join(r, n))]
    each = spark.createDataFrame(tops, "folder string, base string").repartition(max(1, len(tops))) if tops else spark.createDataFrame([], "folder string, base string")
    out = spark.createDataFrame(here, "folder string, base string").mapInArrow(_walk(xattrs, False), ITEM).unionByName(each.mapInArrow(_walk(xattrs, True), ITEM))
    single = [_entry(r, os.path.dirname(r) if relative else "", xattrs) for r in roots if not os.path.isdir(r) or os.path.islink(r)]
    if single:
        out = out.unionByName(spark.createDataFrame([(*x[:11], dict(x[11]) if x[11] else None, *x[12:]) for x in single], ITEM))
    for p in [*(excludes or []), *([never] if never else [])]:
        out = out.filter((F.col("full_path") != p) & ~F.col("full_path").startswith(p.rstrip("/") + "/"))
    if not skip_unreadable and (bad := out.filter("error is not null").select("full_path", "error").limit(20).collect()):
        raise SkippedItems(str([tuple(r) for r in bad]))
    return out.filter("error is null").drop("error")


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        paths, kinds = b.column(b.schema.get_field_index("full_path")).to_pylist(), b.column(b.schema.get_field_index("type")).to_pylist()
        for i, (path, kind) in enumerate(zip(paths, kinds, strict=True)):
            data = None
            if kind == "file":
                with open(path, "rb") as f:
                    data = f.read()
            yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in b.columns], pa.array([data], pa.binary())], [*b.schema.names, "content"])


def with_contents(items: DataFrame) -> DataFrame:
    """Items of scan_tree with the bytes of files; read only where a later filter or column pruning leaves them."""
    return items.mapInArrow(_read, T.StructType([*items.schema.fields, T.StructField("content", T.BinaryType())]))


def scan_order(items: DataFrame) -> DataFrame:
    """items by directory, files before links before directories, then by name."""
    rank = F.create_map(*[x for k, v in TYPE_RANK.items() for x in (F.lit(k), F.lit(v))])
    return items.withColumn("type_rank", F.coalesce(rank[F.col("type")], F.lit(9))).orderBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "type_rank", "path")
