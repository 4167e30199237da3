"""Restored items as files: directories, contents with their holes, hard links, symbolic links, times and modes.

Every executor must reach the target folder. What exists is found before anything is written (and refused, unless it
may be overwritten), so a task that runs again after a lost executor meets only its own files: contents go to a
temporary name first and get theirs by a rename.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from datetime import timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.plans.archive import Archive, unpack

HOLE = 4096  # runs of zero bytes from here on are not written


def extents(content: bytes, least: int = HOLE) -> list[tuple[int, int]]:
    """(start, length) of the data between runs of at least `least` zero bytes (at multiples of it)."""
    out: list[list[int]] = []
    for at in range(0, len(content), least):
        piece = content[at : at + least]
        if piece.count(0) == len(piece):
            continue
        if out and out[-1][0] + out[-1][1] == at:
            out[-1][1] += len(piece)
        else:
            out.append([at, len(piece)])
    return [(a, n) for a, n in out]


def safe_paths(rows: DataFrame, absolute: bool = False) -> DataFrame:
    """rows, with an error for paths that are absolute (unless allowed) or climb out of the target."""
    bad = F.concat(F.lit("/"), F.col("path"), F.lit("/")).contains("/../")
    if not absolute:
        bad = bad | F.col("path").startswith("/")
    return rows.withColumn("path", F.when(bad, F.raise_error(F.concat(F.lit("not a path below the target: "), F.col("path")))).otherwise(F.col("path")))


def _place(target: str, path: str) -> str:
    return os.path.join(target, path.lstrip("/"))


def _existing(target: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            there = [p for p, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if os.path.lexists(_place(target, p)) and not (kind == "dir" and os.path.isdir(_place(target, p)))]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.string())], ["path"])

    return run


def _meta(place: str, mode: int | None, mtime, xattrs: list | None, link: bool = False) -> None:
    if not link and mode is not None:
        os.chmod(place, mode & 0o7777)
    for name, value in xattrs or []:
        try:
            os.setxattr(place, name, value, follow_symlinks=False)
        except OSError:  # the target's file system has none
            pass
    if mtime is not None:
        at = int(mtime.replace(tzinfo=timezone.utc).timestamp() * 1e9) if mtime.tzinfo is None else int(mtime.timestamp() * 1e9)
        os.utime(place, ns=(at, at), follow_symlinks=not link)


def _write(target: str, sparse: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for path, mode, mtime, xattrs, parts, size in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                place = _place(target, path)
                os.makedirs(os.path.dirname(place) or ".", exist_ok=True)
                temp = f"{place}.{uuid.uuid4().hex}.part"
                written = at = 0
                with open(temp, "wb") as f:
                    for x in sorted(parts or [], key=lambda x: x["no"]):
                        data = unpack(x["codec"], x["bytes"], x["length"])
                        for a, n in extents(data) if sparse else [(0, len(data))]:
                            f.seek(at + a)
                            f.write(data[a : a + n])
                            written += n
                        at += len(data)
                    f.truncate(at)
                os.replace(temp, place)
                _meta(place, mode, mtime, xattrs)
                out.append((path, "file", at, written))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["path", "type", "size", "written"])

    return run


def _links(target: str):
    """Hard links to files that are there, and symbolic links."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for path, kind, to, mtime in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                place = _place(target, path)
                os.makedirs(os.path.dirname(place) or ".", exist_ok=True)
                temp = f"{place}.{uuid.uuid4().hex}.part"
                if kind == "symlink":
                    os.symlink(to, temp)
                else:
                    os.link(_place(target, to), temp)
                os.replace(temp, place)
                if os.path.lexists(temp):  # both names were one file already
                    os.unlink(temp)
                if kind == "symlink":
                    _meta(place, None, mtime, None, link=True)
                out.append((path, kind, 0, 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["path", "type", "size", "written"])

    return run


def restore_files(archive: Archive, set_no: int, target: str, wanted: DataFrame | None = None, overwrite: bool = False, absolute: bool = False, sparse: bool = True) -> dict[str, int]:
    """Write a snapshot, or what the wanted paths name or hold, below target; how many items of each type, and bytes.

    A hard link whose owner is not selected becomes a file of its own; others of its group link to that one."""
    rows = archive._selected(set_no, wanted)
    rows = safe_paths(rows, absolute).select("path", "type", "link", "mode", "mtime", "xattrs", "size", "file_id", F.coalesce("hard_link_of", "file_id").alias("group"))
    found = [r[0] for r in rows.select("path", "type").mapInArrow(_existing(target), "path string").limit(20).collect()]
    if found and not overwrite:
        raise FileExistsError(f"in {target}: {sorted(found)}")
    os.makedirs(target, exist_ok=True)
    files = rows.filter("type = 'file'")
    # the group's owner if it is selected, else the least path of the group, has the contents
    heads = files.groupBy("group").agg(F.min(F.struct((F.col("file_id") != F.col("group")).alias("other"), "path")).alias("head")).select("group", F.col("head.path").alias("head"))
    files = files.join(heads, "group")
    bodies = files.filter("path = head")
    blocks = archive.items().select(F.col("file_id").alias("group"), F.posexplode("blocks").alias("no", "block"))
    parts = bodies.select("group").join(blocks, "group").join(archive.packets().select(F.col("hash").alias("block"), "codec", "bytes", "length"), "block")
    parts = parts.groupBy("group").agg(F.collect_list(F.struct("no", "codec", "bytes", "length")).alias("parts"))
    whole = bodies.join(parts, "group", "left").select("path", "mode", "mtime", "xattrs", "parts", "size")
    done = "path string, type string, size long, written long"

    def count(df: DataFrame) -> tuple[int, int, int]:
        r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("written"), F.lit(0))).first()
        return r[0], r[1], r[2]

    n_files, size, written = count(whole.mapInArrow(_write(target, sparse), done))
    hard = files.filter("path <> head").select("path", F.lit("hard").alias("type"), F.col("head").alias("link"), "mtime")
    n_hard, *_ = count(hard.mapInArrow(_links(target), done))
    n_links, *_ = count(rows.filter("type = 'symlink'").select("path", "type", "link", "mtime").mapInArrow(_links(target), done))
    dirs = rows.filter("type = 'dir'").select("path", "mode", "mtime", "xattrs")
    n_dirs = 0
    for r in dirs.orderBy(F.desc(F.length("path"))).toLocalIterator():  # last and deepest first: contents change a directory's time
        place = _place(target, r["path"])
        os.makedirs(place, exist_ok=True)
        _meta(place, r["mode"], r["mtime"], list((r["xattrs"] or {}).items()))
        n_dirs += 1
    return {"files": n_files, "hard_links": n_hard, "links": n_links, "dirs": n_dirs, "bytes": size, "written": written}
