"""Repeats at any byte position.

Exact mode: every byte position of one side is tested against the blocks of the other. Anchored mode: a block is
known by its first content-defined anchor; candidates are places of the other side that hold an anchor whose part has
an equal fingerprint, at whatever position it stands, and the block that begins as far before it as in the index is
compared by hash. Whether a place is an anchor depends on the bytes after it alone, so no repeat of a block that has
an anchor is missed; blocks without one are found by exact mode, or aligned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.plans.workspace import save

# How far from the top a square of sums may lie, and from what block size on the smaller slack holds.
SMALL_SLACK, LARGE_SLACK, LARGE_BLOCK = 256, 32, 131072
BROADCAST_BYTES = 64 << 20


def halves(length: int) -> tuple[int, int]:
    """(slide, block): how far an anchor may lie, and how much of the block it covers."""
    slide = min(length // 2, 65536)
    return slide, length - slide


def first_anchor(data: np.ndarray) -> int | None:
    """The first place whose two 16-bit words, 33 bytes short of a block apart, have a large enough square of sums."""
    slide, block = halves(len(data))
    if block < 33 or slide < 1:
        return None
    words = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << np.uint16(8))
    far = block - 33
    n = min(slide, len(words) - far)
    total = words[:n] + words[far : far + n]
    square = (total * total).view(np.int16)
    limit = 32767 - (LARGE_SLACK if len(data) >= LARGE_BLOCK else SMALL_SLACK)
    hit = np.flatnonzero(square > limit)
    return int(hit[0]) if len(hit) else None


def fingerprint(data: np.ndarray, anchor: int) -> int:
    """32 bits from four 64-bit words of the part that the anchor starts; never 0."""
    _, block = halves(len(data))
    part = data[anchor : anchor + block]
    n = block - 8
    places = (0, n // 3 - 1, 2 * (n // 3) - 2, n - 11)
    total = sum(int.from_bytes(part[max(0, p) : max(0, p) + 8].tobytes(), "little") for p in places) % 2**64
    return ((total & 0xFFFFFFFF) + (total >> 32)) % 2**32 + 1


def anchors(items: DataFrame, block: int, key: str = "doc_id") -> DataFrame:
    """key, block_no, anchor (null if none), fingerprint, of all full aligned blocks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple] = []
            for k, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = np.frombuffer(content or b"", np.uint8)
                for i in range(len(data) // block):
                    part = data[i * block : (i + 1) * block]
                    a = first_anchor(part)
                    out.append((k, i, a, None if a is None else fingerprint(part, a)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], [key, "block_no", "anchor", "fingerprint"])

    return items.select(key, "content").mapInArrow(run, f"{key} long, block_no int, anchor int, fingerprint long")


def anchor_places(data: np.ndarray, block: int) -> np.ndarray:
    """All places of a text that would be an anchor of a block which holds them in its first half."""
    _, part = halves(block)
    if part < 33 or len(data) < part:
        return np.empty(0, np.int64)
    words = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << np.uint16(8))
    far = part - 33
    n = min(len(words) - far, len(data) - part + 1)
    total = words[:n] + words[far : far + n]
    limit = 32767 - (LARGE_SLACK if block >= LARGE_BLOCK else SMALL_SLACK)
    return np.flatnonzero((total * total).view(np.int16) > limit)


def fingerprints(data: np.ndarray, places: np.ndarray, block: int) -> np.ndarray:
    """fingerprint() of the parts that begin at places."""
    _, part = halves(block)
    n = part - 8
    total = np.zeros(len(places), np.uint64)
    for p in (0, n // 3 - 1, 2 * (n // 3) - 2, n - 11):
        at = places[:, None] + max(0, p) + np.arange(8)[None, :]
        total += np.ascontiguousarray(data[at]).view("<u8").ravel()
    return (((total & np.uint64(0xFFFFFFFF)) + (total >> np.uint64(32))) % np.uint64(2**32) + np.uint64(1)).astype(np.int64)


def anchored_blocks(items: DataFrame, block: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, block_no, anchor, fingerprint, hash of the full aligned blocks that have an anchor: rows of the block index."""
    fields = [items.schema[k] for k in keep]
    out = T.StructType([*fields, *T.StructType.fromDDL("block_no int, anchor int, fingerprint long, hash string").fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, at = [], []
            for row, content in enumerate(b.column(len(keep)).to_pylist()):
                data = np.frombuffer(content or b"", np.uint8)
                for i in range(len(data) // block):
                    part = data[i * block : (i + 1) * block]
                    if (a := first_anchor(part)) is not None:
                        rows.append((i, a, fingerprint(part, a), hashlib.md5(part.tobytes()).hexdigest()))
                        at.append(row)
            cols = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))]], [*keep, "block_no", "anchor", "fingerprint", "hash"])

    return items.select(*keep, "content").mapInArrow(run, out)


def anchored_places(items: DataFrame, block: int, key: str) -> DataFrame:
    """key, place, fingerprint, before, near: every anchor of the items, with the bytes that a block around it can hold.

    near begins `before` bytes in front of the place. About one place in 256 is an anchor, so what is joined is small.
    """
    slide, part = halves(block)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple] = []
            for k, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = np.frombuffer(content or b"", np.uint8)
                places = anchor_places(data, block)
                for p, f in zip(places.tolist(), fingerprints(data, places, block).tolist(), strict=True):
                    lo = max(0, p - slide)
                    out.append((k, p, f, p - lo, content[lo : p + part + slide]))
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], [key, "place", "fingerprint", "before", "near"])

    return items.select(F.col(key).cast("long"), "content").mapInArrow(run, f"{key} long, place long, fingerprint long, before int, near binary")


def anchored_matches(index: DataFrame, hay: DataFrame, block: int, key: str) -> DataFrame:
    """key, position and the other columns of index: blocks of the index (fingerprint, hash, anchor, ..) at any byte
    position of hay. A join on the fingerprint, verified by the hash; each position and block once."""
    rest = [c for c in index.columns if c not in ("fingerprint", "anchor")]
    places = anchored_places(hay, block, key)
    both = places.join(index, "fingerprint").filter("anchor <= before")
    piece = F.substring("near", F.col("before") - F.col("anchor") + 1, F.lit(block))
    both = both.filter((F.octet_length(piece) == block) & (F.md5(piece) == F.col("hash")))
    return both.select(key, (F.col("place") - F.col("anchor")).alias("position"), *rest).distinct()


def self_matches(contents: DataFrame, offsets: DataFrame, block: int, chunk: int) -> DataFrame:
    """chunk, offset, length, ref: repeats, at any byte position, of an aligned block that lies wholly before the chunk.

    contents: chunk, content; offsets: chunk, payload. Offsets count in the payload space. Of equal blocks the first
    stands for all, so a block that repeats without end costs one row of the index. Contents stay where they are read.
    """
    offsets = offsets.select("chunk", "payload")
    rows = anchored_blocks(contents, block, ("chunk",)).join(offsets, "chunk")
    offset = F.col("payload") + F.col("block_no").cast("long") * block
    index = rows.groupBy("hash", "fingerprint").agg(F.min(offset).alias("ref"), F.min_by("anchor", offset).alias("anchor"))
    found = anchored_matches(index.select("fingerprint", "anchor", "hash", "ref"), contents, block, "chunk")
    found = found.join(offsets, "chunk").withColumn("offset", F.col("payload") + F.col("position"))
    start = F.floor(F.col("offset") / chunk) * chunk
    return found.filter(F.col("ref") + block < start).select("chunk", "offset", F.lit(block).cast("long").alias("length"), "ref")


def sliding_matches(needles: DataFrame, hay: DataFrame, block: int, needle_key: str, hay_key: str) -> DataFrame:
    """hay_key, position, needle_key, block_no: aligned blocks of needles at every byte position of hay.

    Blocks go out in rounds of about BROADCAST_BYTES of distinct ones; hay is never shuffled.
    """
    n = F.floor(F.octet_length("content") / block).cast("int")
    rows = needles.filter(F.octet_length("content") >= block).select(needle_key, "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("block_no"))
    rows = rows.select(needle_key, "block_no", F.substring(F.col("content"), F.col("block_no") * block + 1, F.lit(block)).alias("bytes"), F.md5(F.substring(F.col("content"), F.col("block_no") * block + 1, F.lit(block))).alias("hash"))
    distinct = rows.select("hash", "bytes").dropDuplicates(["hash"])
    rounds = max(1, -(-distinct.count() * block // BROADCAST_BYTES))
    found = None
    for i in range(rounds):
        part = [bytes(r["bytes"]) for r in (distinct.filter(F.pmod(F.xxhash64("hash"), F.lit(rounds)) == i) if rounds > 1 else distinct).collect()]
        hits = hay.select(hay_key, "content").mapInArrow(_slide(part, block, hay_key), f"{hay_key} long, position int, hash string")
        hits = save(hits, "sliding") if rounds > 1 else hits  # so that the next round's blocks replace this one's in the driver
        found = hits if found is None else found.unionByName(hits)
    return found.join(rows.select(needle_key, "block_no", "hash"), "hash").select(hay_key, "position", needle_key, "block_no")


def _slide(parts: list[bytes], block: int, key: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = set(parts)
        heads = np.array(sorted({int.from_bytes(p[:8], "little") for p in parts}), np.uint64)
        bits = np.zeros(1 << 20, bool)
        mix = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        bits[mix(heads)] = True
        for b in it:
            out: list[tuple] = []
            for k, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if content is None or len(content) < block:
                    continue
                data = np.frombuffer(content, np.uint8)
                n = len(data) - block + 1
                h = np.lib.stride_tricks.as_strided(np.frombuffer(content[: n + 7].ljust(n + 7, b"\0"), np.uint8), (n, 8), (1, 1)).copy().view("<u8").ravel()
                for p in np.flatnonzero(bits[mix(h)]).tolist():
                    piece = bytes(content[p : p + block])
                    if piece in whole:
                        out.append((k, p, hashlib.md5(piece).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string()))], [key, "position", "hash"])

    return run


def cover(candidates: list[tuple[int, int, int]], length: int) -> list[tuple[str, int, int, int | None]]:
    """A greedy cover of [0, length): packets (kind, start, length, ref). candidates: (start, length, ref).

    Longer matches first, then the earlier; what overlaps one already taken is left out; the rest is literal; matches
    that follow each other in both places are one reference.
    """
    taken: list[tuple[int, int, int]] = []
    used = np.zeros(length + 1, bool)
    for s, n, ref in sorted(candidates, key=lambda c: (-c[1], c[0], c[2])):
        if s >= 0 and s + n <= length and not used[s : s + n].any():
            used[s : s + n] = True
            taken.append((s, n, ref))
    merged: list[list[int]] = []
    for s, n, ref in sorted(taken):
        if merged and merged[-1][0] + merged[-1][1] == s and merged[-1][2] + merged[-1][1] == ref:
            merged[-1][1] += n
        else:
            merged.append([s, n, ref])
    out, at = [], 0
    for s, n, ref in merged:
        if s > at:
            out.append(("L", at, s - at, None))
        out.append(("R", s, n, ref))
        at = s + n
    if at < length:
        out.append(("L", at, length - at, None))
    return out


def cover_chunks(chunks: DataFrame, matches: DataFrame) -> DataFrame:
    """chunk, ord, kind, start, length, ref. chunks: chunk, payload, size; matches: chunk, offset, length, ref."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple] = []
            for c, payload, size, found in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                cand = [(m["offset"] - payload, m["length"], m["ref"]) for m in found or []]
                out += [(c, i, k, payload + s, n, ref) for i, (k, s, n, ref) in enumerate(cover(cand, size))]
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["chunk", "ord", "kind", "start", "length", "ref"])

    found = matches.groupBy("chunk").agg(F.collect_list(F.struct("offset", "length", "ref")).alias("found"))
    rows = chunks.select("chunk", "payload", "size").join(found, "chunk", "left")
    return rows.select("chunk", "payload", "size", "found").mapInArrow(run, "chunk long, ord int, kind string, start long, length long, ref long")
