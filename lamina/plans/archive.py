"""The archive: Parquet tables and a manifest of committed snapshots.

Tables: items (what a snapshot added: files, links, directories), packets (the bytes of distinct blocks, each once),
chunks and index (where packets lie in the payload space), members (which items a snapshot holds) and snapshots. A
snapshot's rows lie in folders of its own; it counts from the moment its manifest file has its name, which is given by
a rename, so a job that dies leaves nothing visible behind. The manifest holds a checksum of the index.

Blocks are cut at multiples of the block size, or (cut="content") where the bytes themselves say so: then bytes put in
front of a file move no cut but the first, and the rest is found again. A packet is stored as its level says: 0 as it
is, 1 by the word codec, 2 to 4 zstd at 1, 10 and 19, and as it is wherever that is no smaller or the file's name or samples of its
bytes say that it does not compress.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import wordlz
from lamina.operators.entropy import sampled_compressible
from lamina.operators.filters import HIGH_ENTROPY, select_paths
from lamina.plans.options import ChecksumError
from lamina.plans.workspace import save

FORMAT = 2
META = "type string, link string, mode int, xattrs map<string,binary>"
ITEMS = f"set_no int, file_id long, path string, size long, mtime timestamp, {META}, hash string, duplicate_of long, hard_link_of long, stored_raw boolean, blocks array<string>"
MEMBERS = "set_no int, ord long, file_id long"
PACKETS = "set_no int, hash string, codec string, bytes binary, length int, stored int"
INDEX = "set_no int, hash string, payload long, length int, chunk_id int"
CHUNKS = "set_no int, chunk_id int, payload long, payload_length long, compressed_length long"
SNAPSHOTS = "set_no int, date timestamp, files long, bytes long, added_files long, unchanged_files long, duplicate_files long, added_bytes long, stored_bytes long, sources array<string>, dirs long, links long, hard_links long, raw_files long, raw_bytes long, compressed_bytes long"
CODECS = {0: ("raw", None), 1: ("words", None), 2: ("zstd", 1), 3: ("zstd", 10), 4: ("zstd", 19)}
BUCKETS = 256
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000
_SAMPLED = 131072  # contents from here on are sampled for entropy


def content_cuts(data: np.ndarray, block: int) -> list[int]:
    """Ends of the blocks: after the last of 32 bytes whose rolling sum of scrambled bytes has log2(block) low zero bits,
    a quarter of the block size apart at least and four times at most."""
    n = len(data)
    if n == 0:
        return []
    table = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint64)
    sums = np.cumsum(table[data] * np.uint64(0x9E3779B97F4A7C15))
    window = sums.copy()
    window[32:] -= sums[:-32]
    window ^= window >> np.uint64(29)
    window *= np.uint64(0xBF58476D1CE4E5B9)
    hits = np.flatnonzero((window >> np.uint64(40)) % np.uint64(block) == 0) + 1
    out, last = [], 0
    for h in hits[hits >= 32].tolist():
        while h - last > 4 * block:
            last += 4 * block
            out.append(last)
        if h - last >= block // 4:
            out.append(h)
            last = h
    while n - last > 4 * block:
        last += 4 * block
        out.append(last)
    return out if last == n else [*out, n]


def _record(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _cut(block: int, by_content: bool):
    """(path, hash, compressible, blocks, parts) of (path, content)."""

    types = (pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.binary()))
    names = ["path", "hash", "compressible", "blocks", "parts"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in it:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                data = content.as_py() or b""
                ends = content_cuts(np.frombuffer(data, np.uint8), block) if by_content else [min(len(data), i + block) for i in range(0, len(data), block)]
                parts = [data[a:z] for a, z in zip([0, *ends], ends)]  # noqa: B905
                rows.append((path.as_py(), hashlib.md5(data).hexdigest(), sampled_compressible(data, _SAMPLED), [hashlib.md5(p).hexdigest() for p in parts], parts))
                held += len(data)
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _record(rows, types, names)
                    rows, held = [], 0
        if rows:
            yield _record(rows, types, names)

    return run


def _pack(level: int):
    name, strength = CODECS[level]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = wordlz.compress if name == "words" else None if name == "raw" else (lambda x, c=pa.Codec(name, compression_level=strength): c.compress(x, asbytes=True))
        for b in it:
            out = []
            for data, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                small = None if press is None or raw or not data else press(data)
                out.append(("raw", data) if small is None or len(small) >= len(data) else (name, small))
            cols = [pa.array([c for c, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary()), pa.array([len(x) for x in b.column(1).to_pylist()], pa.int32()), pa.array([len(x) for _, x in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["hash", "codec", "bytes", "length", "stored"])

    return run


def unpack(codec: str, data: bytes, length: int) -> bytes:
    return data if codec == "raw" else wordlz.decompress(data) if codec == "words" else pa.Codec(codec).decompress(data, length, asbytes=True)


def _joined(check: bool):
    """(file_id, content) of (file_id, hash, path, parts): blocks in order, unpacked and joined once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        types, names = (pa.int64(), pa.binary()), ["_f", "content"]
        for b in it:
            for i in range(b.num_rows):
                file_id, md5, path, parts = (b.column(k)[i].as_py() for k in range(4))
                content = b"".join(unpack(x["codec"], x["bytes"], x["length"]) for x in sorted(parts or [], key=lambda x: x["no"]))
                if check and hashlib.md5(content).hexdigest() != md5:
                    raise ChecksumError(f"checksum of {path}")
                rows.append((file_id, content))
                held += len(content)
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _record(rows, types, names)
                    rows, held = [], 0
        if rows:
            yield _record(rows, types, names)

    return run


@dataclass
class Archive:
    """backup() adds a snapshot of items (path, size, mtime, content and, if there, type, link, mode, xattrs, device, inode)."""

    spark: SparkSession
    root: str
    block: int = 4096
    level: int = 2
    cut: str = "aligned"
    _known: dict[int, dict] = field(default_factory=dict)

    # ------------------------------------------------------------ files

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def committed(self) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.root}/_manifest")
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return sorted(int(n[4:-5]) for n in names if n.startswith("set-") and n.endswith(".json"))

    def manifest(self, set_no: int) -> dict:
        """What a commit wrote; it never changes, so it is read once."""
        if set_no not in self._known:
            fs, path = self._fs()
            stream = fs.open(path(f"{self.root}/_manifest/set-{set_no}.json"))
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            out = json.loads(text)
            if out["format"] != FORMAT:
                raise ValueError(f"archive format {out['format']}, this code reads {FORMAT}")
            self._known[set_no] = out
        return self._known[set_no]

    def _commit(self, set_no: int, run: str, more: dict | None = None) -> None:
        fs, path = self._fs()
        temp = path(f"{self.root}/_manifest/.{run}")
        stream = fs.create(temp, False)
        stream.write(bytearray(json.dumps({"format": FORMAT, "set_no": set_no, "run": run, "block": self.block} | (more or {})).encode()))
        stream.close()
        if fs.exists(path(f"{self.root}/_manifest/set-{set_no}.json")) or not fs.rename(temp, path(f"{self.root}/_manifest/set-{set_no}.json")):
            raise RuntimeError(f"snapshot {set_no} was committed by another job")

    def _table(self, name: str, schema: str, sets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{name}/{self.manifest(n)['run']}" for n in (self.committed() if sets is None else sets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], T.StructType.fromDDL(schema))

    def items(self) -> DataFrame:
        return self._table("items", ITEMS)

    def packets(self) -> DataFrame:
        return self._table("packets", PACKETS)

    def chunks(self) -> DataFrame:
        return self._table("chunks", CHUNKS)

    def snapshots(self) -> DataFrame:
        return self._table("snapshots", SNAPSHOTS)

    def payload(self) -> int:
        """Bytes of the payload space of all snapshots."""
        return self.chunks().agg(F.coalesce(F.sum("payload_length"), F.lit(0))).first()[0]

    def index(self, set_no: int | None = None) -> DataFrame:
        """The block index of one snapshot or all, after a test of its checksums."""
        sets = self.committed() if set_no is None else [set_no]
        for n in sets:
            if checksum(self._table("index", INDEX, [n])) != self.manifest(n)["index"]:
                raise ChecksumError(f"the index of snapshot {n}")
        return self._table("index", INDEX, sets)

    # ------------------------------------------------------------ backup

    def _rows(self, items: DataFrame) -> DataFrame:
        """items with the columns of META, device and inode, never the archive itself."""
        spare = {"type": F.lit("file"), "link": F.lit(None).cast("string"), "mode": F.lit(None).cast("int"), "xattrs": F.lit(None).cast("map<string,binary>"), "device": F.lit(None).cast("long"), "inode": F.lit(None).cast("long")}
        own = self.root.removeprefix("file://").rstrip("/")
        inside = (F.col("path") == own) | F.col("path").startswith(own + "/")
        return items.select("path", "size", "mtime", "content", *[F.col(c) if c in items.columns else v.alias(c) for c, v in spare.items()]).filter(~inside)

    def backup(self, items: DataFrame, date, sources: list[str] | None = None, batch: str | None = None) -> int:
        """Add a snapshot and return its number. Unchanged items (path, size and mtime as in the last one) are not read."""
        done = self.committed()
        set_no, run = (done[-1] if done else 0) + 1, uuid.uuid4().hex
        known = self.items()
        top = known.agg(F.coalesce(F.max("file_id"), F.lit(-1))).first()[0]
        same = ["path", "size", "mtime", "type"]
        last = (self._table("members", MEMBERS, [done[-1]]).join(known, "file_id") if done else known).select(*same, F.col("file_id").alias("old_id"))
        rows = self._rows(items)
        meta = rows.drop("content")
        kept = save(meta.join(last, same).select("path", "old_id"), "archive-kept")
        fresh = save(self._numbered(meta.join(kept, "path", "left_anti"), top), "archive-fresh")
        # of hard links only the least path has contents
        bodies = fresh.filter((F.col("type") == "file") & F.col("owner").isNull()).select("path")
        cut = rows.join(bodies, "path", "left_semi").select("path", "content").mapInArrow(_cut(self.block, self.cut == "content"), "path string, hash string, compressible boolean, blocks array<string>, parts array<binary>")
        cut = save(cut, "archive-cut")
        whole = fresh.join(cut.select("path", "hash", "compressible", "blocks"), "path", "left")
        first = whole.filter("hash is not null").select("hash", "size", "file_id").unionByName(known.filter("hash is not null").select("hash", "size", "file_id")).groupBy("hash", "size").agg(F.min("file_id").alias("_first"))
        named = F.regexp_extract("path", r"\.([^./]*)$", 1).isin(*HIGH_ENTROPY) & (F.col("size") >= _SAMPLED)
        whole = whole.join(first, ["hash", "size"], "left").withColumn("duplicate_of", F.when(F.col("_first") != F.col("file_id"), F.col("_first"))).withColumn("stored_raw", F.coalesce(named | ~F.col("compressible"), F.lit(False)))
        owners = whole.select(F.col("path").alias("owner"), F.col("file_id").alias("hard_link_of"))
        whole = whole.join(owners, "owner", "left")
        whole.select(F.lit(set_no).alias("set_no"), "file_id", "path", "size", "mtime", "type", "link", "mode", "xattrs", "hash", "duplicate_of", "hard_link_of", "stored_raw", F.coalesce("blocks", F.expr("cast(array() as array<string>)")).alias("blocks")).write.parquet(f"{self.root}/items/{run}")
        added = self.spark.read.schema(ITEMS).parquet(f"{self.root}/items/{run}")
        # only blocks of items that are not whole duplicates, each once, unless an earlier snapshot has them
        single = added.filter("duplicate_of is null and size(blocks) > 0").select("path", "stored_raw")
        new = cut.select("path", F.explode(F.arrays_zip("blocks", "parts")).alias("x")).join(single, "path")
        new = new.select(F.col("x.blocks").alias("hash"), F.col("x.parts").alias("bytes"), "stored_raw").dropDuplicates(["hash"])
        new = new.join(self.packets().select("hash"), "hash", "left_anti")
        new.mapInArrow(_pack(self.level), "hash string, codec string, bytes binary, length int, stored int").select(F.lit(set_no).alias("set_no"), "*").write.parquet(f"{self.root}/packets/{run}")
        packets = self.spark.read.schema(PACKETS).parquet(f"{self.root}/packets/{run}")
        self._write_index(packets, set_no, run)
        ids = kept.select("path", F.col("old_id").alias("file_id")).unionByName(added.select("path", "file_id"))
        ids.select(F.lit(set_no).alias("set_no"), F.xxhash64("path").alias("ord"), "file_id").write.parquet(f"{self.root}/members/{run}")

        def total(c: Column) -> Column:
            return F.coalesce(F.sum(c), F.lit(0)).cast("long")

        a = added.agg(F.count(F.lit(1)).alias("added_files"), F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicate_files"), total(F.col("size")).alias("added_bytes"), F.count_if(F.col("type") == "dir").alias("dirs"), F.count_if(F.col("type") == "symlink").alias("links"), F.count_if(F.col("hard_link_of").isNotNull()).alias("hard_links"), F.count_if("stored_raw").alias("raw_files"), total(F.when(F.col("stored_raw"), F.col("size"))).alias("raw_bytes")).first()
        s = packets.agg(total(F.col("length")).alias("stored_bytes"), total(F.col("stored")).alias("compressed_bytes")).first()
        t = meta.agg(F.count(F.lit(1)).alias("files"), total(F.col("size")).alias("bytes")).first()
        row = (set_no, date, t["files"], t["bytes"], a["added_files"], t["files"] - a["added_files"], a["duplicate_files"], a["added_bytes"], s["stored_bytes"], sources or [], a["dirs"], a["links"], a["hard_links"], a["raw_files"], a["raw_bytes"], s["compressed_bytes"])
        self.spark.createDataFrame([row], SNAPSHOTS).write.parquet(f"{self.root}/snapshots/{run}")
        index = self.spark.read.schema(INDEX).parquet(f"{self.root}/index/{run}")
        self._commit(set_no, run, {"index": checksum(index)} | ({"batch": batch} if batch is not None else {}))
        return set_no

    def batches(self) -> set[str]:
        return {self.manifest(n)["batch"] for n in self.committed() if "batch" in self.manifest(n)}

    def _numbered(self, meta: DataFrame, top: int) -> DataFrame:
        """Metadata rows with file_id (ranks inside hash buckets, the buckets' bases summed up) and owner, the least path of a hard link's group."""
        rows = meta.withColumn("_b", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)))
        bases = rows.groupBy("_b").count().withColumn("_base", F.coalesce(F.sum("count").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("path"))).join(F.broadcast(bases), "_b")
        rows = rows.withColumn("file_id", F.lit(top) + F.col("_base") + F.col("_r")).drop("_b", "_r", "_base")
        groups = meta.filter("type = 'file' and device is not null and inode is not null").groupBy("device", "inode").agg(F.min("path").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        rows = rows.join(groups, ["device", "inode"], "left")
        return rows.withColumn("owner", F.when(F.col("owner") != F.col("path"), F.col("owner")))

    def _write_index(self, packets: DataFrame, set_no: int, run: str) -> None:
        """Where packets lie in the payload space of the snapshot: in the order of their hashes, a chunk for each bucket."""
        rows = packets.select("hash", "length", "stored", F.conv(F.substring("hash", 1, 2), 16, 10).cast("int").alias("chunk_id"))
        sums = rows.groupBy("chunk_id").agg(F.sum("length").alias("payload_length"), F.sum("stored").alias("compressed_length"))
        sums = sums.withColumn("payload", F.coalesce(F.sum("payload_length").over(W.orderBy("chunk_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        sums.select(F.lit(set_no).alias("set_no"), "chunk_id", "payload", "payload_length", "compressed_length").write.parquet(f"{self.root}/chunks/{run}")
        sums = self.spark.read.schema(CHUNKS).parquet(f"{self.root}/chunks/{run}").select("chunk_id", F.col("payload").alias("_base"))
        inside = F.coalesce(F.sum("length").over(W.partitionBy("chunk_id").orderBy("hash").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("_in", inside).join(F.broadcast(sums), "chunk_id")
        rows.select(F.lit(set_no).alias("set_no"), "hash", (F.col("_base") + F.col("_in")).alias("payload"), "length", "chunk_id").write.parquet(f"{self.root}/index/{run}")

    # ------------------------------------------------------------ lists, restore

    def list_snapshots(self) -> DataFrame:
        """set_no, date, files, size in MB (0 is 0, under half a MB is 1), stored MB, sources cut to 80 characters."""

        def mb(c: str):
            return F.when(F.col(c) == 0, 0).when(F.col(c) < 524288, 1).otherwise(F.round(F.col(c) / 1048576).cast("long")).cast("long")

        return self.snapshots().select("set_no", "date", "files", mb("bytes").alias("size_mb"), mb("stored_bytes").alias("stored_mb"), F.substring(F.array_join("sources", " "), 1, 80).alias("sources"))

    def contents(self, set_no: int) -> DataFrame:
        self._need(set_no)
        return self._table("members", MEMBERS, [set_no]).select("ord", "file_id").join(self.items().drop("set_no"), "file_id").select("path", "size", "mtime", "hash", "file_id", "ord", "type", "link", "mode", "xattrs", "hard_link_of")

    def _need(self, set_no: int) -> None:
        if set_no not in self.committed():
            raise ValueError(f"no snapshot {set_no}")

    def _selected(self, set_no: int, wanted: DataFrame | None) -> DataFrame:
        rows = self.contents(set_no)
        if wanted is not None:
            rows, missing = select_paths(rows, wanted)
            if absent := [r[0] for r in missing.limit(20).collect()]:
                raise ValueError(f"not in snapshot {set_no}: {absent}")
        return rows

    def chunk_rows(self, set_no: int, wanted: DataFrame | None = None) -> DataFrame:
        """file_id, path, no, codec, bytes, length of every block of the selected files: for contents of any size, in order by no.

        A hard link has the blocks of its owner, also where the owner is not selected."""
        rows = self._selected(set_no, wanted).filter("type = 'file'").withColumn("_body", F.coalesce("hard_link_of", "file_id"))
        blocks = self.items().select(F.col("file_id").alias("_body"), F.posexplode("blocks").alias("no", "block"))
        each = rows.select("file_id", "path", "_body").join(blocks, "_body").drop("_body")
        return each.join(self.packets().select(F.col("hash").alias("block"), "codec", "bytes", "length"), "block").select("file_id", "path", "no", "codec", "bytes", "length")

    def restore(self, set_no: int, wanted: DataFrame | None = None, check: bool = True) -> DataFrame:
        """path, size, mtime, content, type, link, mode of a snapshot, or of what the wanted paths name or hold. Contents
        that do not have their hash raise an error when they are read. Larger contents than a row holds: chunk_rows."""
        rows = self._selected(set_no, wanted)
        body = self.items().select(F.col("file_id").alias("_o"), F.col("hash").alias("_h"))
        rows = rows.join(body, rows["hard_link_of"] == body["_o"], "left").withColumn("hash", F.coalesce("hash", "_h")).drop("_o", "_h")
        parts = self.chunk_rows(set_no, wanted).groupBy("file_id").agg(F.collect_list(F.struct("no", "codec", "bytes", "length")).alias("parts"))
        joined = rows.filter("type = 'file'").select("file_id", "hash", "path").join(parts, "file_id", "left").mapInArrow(_joined(check), "_f long, content binary")
        out = rows.join(joined, rows["file_id"] == joined["_f"], "left")
        return out.select("path", "size", "mtime", "content", "type", "link", "mode", "xattrs", "hard_link_of", "file_id")

    def statistics(self) -> DataFrame:
        s = self.snapshots()
        return s.agg(F.count(F.lit(1)).alias("sets"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum("unchanged_files").alias("unchanged_files"), F.sum("duplicate_files").alias("duplicate_files"), F.sum("stored_bytes").alias("stored_bytes"))

    def details(self) -> DataFrame:
        """statistics() and what the items are: directories, links, hard links, incompressible files, bytes after compression."""
        s = self.snapshots()
        more = ("dirs", "links", "hard_links", "raw_files", "raw_bytes", "compressed_bytes")
        return self.statistics().crossJoin(s.agg(*[F.sum(c).alias(c) for c in more]))  # one row and one row


def checksum(df: DataFrame) -> str:
    """64 bits over all rows, in any order, and their number."""
    r = df.agg(F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)), F.count(F.lit(1))).first()
    return f"{r[0] & (2**64 - 1):016x}-{r[1]}"
