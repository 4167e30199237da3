"""A fast word codec: words of 8 or 4 bytes that repeat the last word of their 16-bit hash are replaced by the hash.

Data are cut into sections; each takes the word size that makes it smaller, or is stored as it is where neither does.
Runs of four words or more that are equal are written once with their length. Everything is computed for all words
of a section at once: a word is a hit if the word before it in its hash's group is the same, and when reading, a hit is
the last literal of its group.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SECTION = 1 << 18
RUN = 4  # equal words from which on a run is written
MULTIPLIER = 0x9E3779B1  # odd, below 2**32
_HEAD = "<4sQQ"  # mark, length of the data, length of the whole
_PART = "<BIIII"  # word size (0: raw), words after runs, runs, hits, bytes of the section
_MARK = b"WLZ1"
_HEAD_SIZE, _PART_SIZE = struct.calcsize(_HEAD), struct.calcsize(_PART)


def hashes(words: np.ndarray) -> np.ndarray:
    return ((words.astype(np.uint64) * np.uint64(MULTIPLIER)) >> np.uint64(48 if words.dtype.itemsize == 8 else 24)).astype(np.uint64) & np.uint64(0xFFFF)


def hits_of(words: np.ndarray) -> np.ndarray:
    """Which words equal the last word before them with the same hash."""
    h = hashes(words)
    order = np.argsort(h, kind="stable")
    w, g = words[order], h[order]
    out = np.zeros(len(words), bool)
    out[order[1:]] = (g[1:] == g[:-1]) & (w[1:] == w[:-1])
    return out


def _without_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words with one for each run, places of the runs among them, their lengths)."""
    starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(words)])
    copies = np.where(sizes >= RUN, 1, sizes)
    kept = np.repeat(words[starts], copies) if len(words) else words
    places = (np.cumsum(copies) - copies)[sizes >= RUN]
    return kept, places.astype("<u4"), sizes[sizes >= RUN].astype("<u4")


def _section(data: bytes, size: int) -> bytes:
    whole = len(data) // size * size
    words, places, lengths = _without_runs(np.frombuffer(data[:whole], "<u8" if size == 8 else "<u4"))
    hit = hits_of(words)
    parts = [places.tobytes(), lengths.tobytes(), np.packbits(hit).tobytes(), hashes(words)[hit].astype("<u2").tobytes(), words[~hit].tobytes(), data[whole:]]
    return struct.pack(_PART, size, len(words), len(places), int(hit.sum()), len(data)) + b"".join(parts)


def compress(data: bytes) -> bytes:
    out = []
    for at in range(0, len(data), SECTION):
        piece = data[at : at + SECTION]
        best = min((_section(piece, 8), _section(piece, 4)), key=len)
        out.append(best if len(best) < len(piece) + _PART_SIZE else struct.pack(_PART, 0, 0, 0, 0, len(piece)) + piece)
    body = b"".join(out)
    return struct.pack(_HEAD, _MARK, len(data), _HEAD_SIZE + len(body)) + body


def decompressed_length(packed: bytes) -> int:
    mark, n, _ = struct.unpack_from(_HEAD, packed)
    if mark != _MARK:
        raise ValueError("not made by this codec")
    return n


def compressed_length(packed: bytes) -> int:
    decompressed_length(packed)
    return struct.unpack_from(_HEAD, packed)[2]


def longest_compressed(length: int) -> int:
    return _HEAD_SIZE + length + _PART_SIZE * -(-length // SECTION)


def decompress(packed: bytes) -> bytes:
    n, end = decompressed_length(packed), compressed_length(packed)
    if end != len(packed):
        raise ValueError("cut off")
    at, out = _HEAD_SIZE, []

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(packed, dtype, count, at)
        at += x.nbytes
        return x

    while at < end:
        size, words, runs, hits, length = struct.unpack_from(_PART, packed, at)
        at += _PART_SIZE
        if not size:
            out.append(packed[at : at + length])
            at += length
            continue
        kind = "<u8" if size == 8 else "<u4"
        places, lengths = take("<u4", runs), take("<u4", runs)
        hit = np.unpackbits(take("u1", -(-words // 8)), count=words).astype(bool)
        known, literal = take("<u2", hits), take(kind, words - hits)
        w, h = np.zeros(words, kind), np.zeros(words, np.uint64)
        w[~hit], h[~hit], h[hit] = literal, hashes(literal), known
        order = np.argsort(h, kind="stable")
        last = np.maximum.accumulate(np.where(hit[order], 0, np.arange(words))) if words else order
        w[order] = w[order][last]
        copies = np.ones(words, np.int64)
        copies[places] = lengths
        body = np.repeat(w, copies).tobytes()
        rest = length - len(body)
        out.append(body + packed[at : at + rest])
        at += rest
    data = b"".join(out)
    if len(data) != n:
        raise ValueError("not whole")
    return data


def ratio(content: Column) -> Column:
    """Length over compressed length; null for null, 1 for no bytes."""

    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else len(c) / len(compress(c)) if c else 1.0 for c in rows], dtype="float64")

    return run(content)


def hit_counts(content: Column) -> Column:
    """struct<words,hits>: 8-byte words, and those that repeat the last word of their hash."""

    @F.pandas_udf("words long, hits long")
    def run(rows: pd.Series) -> pd.DataFrame:
        out = []
        for c in rows:
            w = np.frombuffer((c or b"")[: len(c or b"") // 8 * 8], "<u8")
            out.append((len(w), int(hits_of(w).sum()) if len(w) else 0))
        return pd.DataFrame(out, columns=["words", "hits"])

    return run(content)
