"""Operator 2. Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Texts are compared as their words (lower case A-Z, split on white space) joined by single spaces. An item of n
characters may differ from its leak by MAX_EDITS * n edits. Windows begin at every word of a document and of an item.
A CGK walk reads a window by STEPS steps: each writes the character that the walk stands on, and a random bit of step
and character tells whether it moves on; two windows that differ by an edit soon walk in step again, so edit distance
becomes Hamming distance. Each of TABLES tables has a walk of its own and a key of SAMPLED sampled steps. Where keys of
an item's windows (one in SEVERAL, one at least) stand in a document on diagonals that lie within its edits of each
other, the least edit distance of the item to any substring of the surroundings is computed.

Windows are shorter than items, and an item has one at each word: walks over whole items agree at too few steps
(measured at 14% edits, 4 samples in 16 tables: recall 0.75, 0.51, 0.35 for items of 15, 30 and 60 words). TABLES and
SAMPLED are chosen for a recall of 0.95 of items of 15 words or more at MAX_EDITS; README has the recall measured
against full edit distances.

Items go to the tasks in blocks of at most ITEM_BLOCK, so what is broadcast is bounded; documents do not move.
Null and empty texts hold no passage and give no rows; items of fewer than MIN_WORDS words are compared by equality
of their words in a row, and items of fewer than GRAM words, which say too little to be a leak, are left out. Rows with
a null item_id or text are no items. A null doc_id is kept as null. Repeated rows give repeated finds; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, small_batches, words_of

MAX_EDITS = 0.15
GRAM = 3
MIN_WORDS = 8
STEPS = 16
SAMPLED = 11
TABLES = 10
ADVANCE = 0.8  # share of the bits that move a walk on
SEVERAL = 8  # of so many windows of an item one must be found
BITS = 20
SHIFT = 1 << 32  # makes places before the first text positive
BATCH = 1_000_000
ITEM_BLOCK = 20_000
_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_OUT = "doc_id long, item_id long, start int, end int, distance int, item_length int"


def normal(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "surrogatepass")


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _walks() -> list[tuple[np.ndarray, list[bool]]]:
    """(moves by step and letter, sampled steps) of each table."""
    rng = np.random.default_rng(2)
    out = []
    for _ in range(TABLES):
        moves = (rng.random((STEPS, 256)) < ADVANCE).astype(np.int64)
        chosen = set(rng.choice(STEPS, SAMPLED, replace=False).tolist())
        out.append((moves, [t in chosen for t in range(STEPS)]))
    return out


def letters(c: np.ndarray) -> np.ndarray:
    """Code points hashed to 256 letters, and room for the walks of the last windows."""
    small = ((c.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
    return np.r_[small, np.zeros(STEPS, np.uint8)]


def window_keys(c: np.ndarray, starts: np.ndarray, walk: tuple[np.ndarray, list[bool]]) -> tuple[np.ndarray, np.ndarray]:
    """(key, end) of the walk from each start; windows by thousands, so that they stay in the cache."""
    moves, sampled = walk
    keys, ends = np.zeros(len(starts), np.uint64), np.empty(len(starts), np.int64)
    for a in range(0, len(starts), 16_384):
        at, key = starts[a : a + 16_384].copy(), keys[a : a + 16_384]
        for t in range(len(sampled)):
            now = c.take(at)
            if sampled[t]:
                key *= np.uint64(0x9E3779B97F4A7C15)
                key += now
            at += moves[t].take(now)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        ends[a : a + 16_384] = at
    return keys, ends


def least_distance(item: str, region: str) -> int:
    """The least edit distance of item to a substring of region, bit-parallel."""
    same: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        same[c] |= 1 << i
    every, last = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, now = every, 0, len(item)
    best = now
    for c in region:
        eq = same.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq
        more, less = down | (every & ~(flat | up)), up & flat
        now += bool(more & last) - bool(less & last)
        best = min(best, now)
        more, less = (more << 1) & every, (less << 1) & every
        level = eq | down
        up, down = less | (every & ~(level | more)), more & level
    return best


def closest(item: str, region: str) -> tuple[int, int, int]:
    """(least edit distance of item to a substring of region, its start, its end), the leftmost shortest such end."""
    at = region.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    a, b = codes(item), codes(region)
    n = len(b)
    d = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    ramp = np.arange(n + 1)
    for i, c in enumerate(a, 1):
        diag = np.r_[i, d[:-1] + (b != c)]
        up = d + 1
        best = np.minimum(diag, up)
        src = np.where(diag <= up, np.r_[0, start[:-1]], start)
        low = np.minimum.accumulate(best - ramp)
        new = low + ramp
        origin = np.maximum.accumulate(np.where(best - ramp == low, ramp, 0))
        start, d = src[origin], new
    e = int(np.argmin(d))
    return int(d[e]), int(start[e]), e


class Items:
    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in rows]
        self.words = [words_of(t) for _, t in rows]
        self.text = [normal(w) for w in self.words]
        sizes = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.array([int(MAX_EDITS * n) if len(w) >= MIN_WORDS else 0 for n, w in zip(sizes.tolist(), self.words, strict=True)], np.int64)
        self.walks = _walks()
        places = [np.flatnonzero(np.r_[True, codes(t)[:-1] == 32]) for t in self.text]
        least = min((len(t) for t in self.text), default=STEPS)
        if least < STEPS:  # items that a walk may leave have a table of their own, of as many steps as they have characters
            self.walks.append((self.walks[0][0][:least], [True] * least))
        self.need = np.array([max(1, len(x) // SEVERAL) for x in places], np.int64)
        self.tables = []
        for number, walk in enumerate(self.walks):
            keys, item, off = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, (t, starts) in enumerate(zip(self.text, places, strict=True)):
                if (len(t) < STEPS) != (number == TABLES):
                    continue
                k, end = window_keys(letters(codes(t)), starts, walk)
                good = end <= len(t)
                keys.append(k[good])
                item.append(np.full(int(good.sum()), i))
                off.append(starts[good])
            k, item, off = np.concatenate(keys), np.concatenate(item), np.concatenate(off)
            order = np.argsort(k, kind="stable")
            keys, at, count = np.unique(k[order], return_index=True, return_counts=True)
            bits = np.zeros(1 << BITS, bool)
            bits[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.tables.append((keys, at, count, item[order], off[order], bits))

    def candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place in text) such that a leak of the item starts, give or take the item's edits, at place to place + edits."""
        c = letters(text)
        starts = np.flatnonzero(np.r_[True, (text[:-1] == 32) | (text[:-1] == 10)])
        items, places, offs = [], [], []
        for walk, (keys, first, count, item, off, bits) in zip(self.walks, self.tables, strict=True):
            if not len(keys):
                continue
            g, _ = window_keys(c, starts, walk)
            hit = np.flatnonzero(bits[(g >> np.uint64(64 - BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, g[hit]), len(keys) - 1)
            good = keys[at] == g[hit]
            hit, at = hit[good], at[good]
            n = count[at]
            which = np.repeat(first[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
            items.append(item[which])
            offs.append(off[which])
            places.append(np.repeat(starts[hit], n) - off[which] + SHIFT)
        none = np.empty(0, np.int64)
        item, place, off = np.concatenate([none, *items]), np.concatenate([none, *places]), np.concatenate([none, *offs])
        order = np.lexsort((off, place, item))
        item, place, off = item[order], place[order], off[order]
        new = np.r_[True, (item[1:] != item[:-1]) | (place[1:] != place[:-1]) | (off[1:] != off[:-1])] if len(item) else np.empty(0, bool)
        item, place = item[new], place[new]  # one window found by several tables counts once
        to = np.arange(len(item)) + self.need[item] - 1
        last = np.minimum(to, max(0, len(item) - 1))
        ok = (to < len(item)) & (item[last] == item) & (place[last] - place <= self.edits[item])
        return item[ok], place[ok] - SHIFT


def _verify(items: Items, i: int, text: str, place: int) -> tuple[int, int, int] | None:
    """(distance, first word, past the last word) or None."""
    allowed, size = int(items.edits[i]), len(items.text[i])
    lo, hi = max(0, place - allowed), min(len(text), place + size + 3 * allowed)
    while lo > 0 and text[lo - 1] != " ":  # whole words
        lo -= 1
    while hi < len(text) and text[hi] != " ":
        hi += 1
    region = text[lo:hi]
    if region.startswith(" "):
        lo, region = lo + 1, region[1:]
    if items.text[i] not in region and (not allowed or least_distance(items.text[i], region) > allowed):
        return None
    w = len(items.words[i])
    if w < MIN_WORDS:
        s = f" {region} ".find(f" {items.text[i]} ")
        if s < 0:
            return None
        d, e = 0, s + size
    else:
        d, s, e = closest(items.text[i], region)
    before = text[:lo].count(" ")
    return d, before + region[:s].count(" "), before + region[:e].rstrip(" ").count(" ") + 1


def _scan(rows: list[tuple[int, str]]):
    made: list[Items] = []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Items(rows))
        items = made[0]
        batch = max(50_000, BATCH * 200 // max(200, len(rows)))  # a piece then stands in more items
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32()), ("item_length", pa.int32())])

        def settle(texts: list) -> pa.RecordBatch:
            found: dict[tuple[int, int], list] = defaultdict(list)
            starts = np.cumsum([0, *(len(t[2]) + 1 for t in texts)])
            which, place = items.candidates(codes("\n".join(t[2] for t in texts)))
            done = (-1, -1, -1)  # item, text, last place that the region just verified stands for
            for i, p in zip(which.tolist(), place.tolist(), strict=True):
                e = int(items.edits[i])
                first, last = (min(len(texts) - 1, max(0, int(np.searchsorted(starts, x, "right")) - 1)) for x in (p - e, p + len(items.text[i]) + 2 * e))
                if (i, first) == done[:2] and p <= done[2]:
                    continue
                done = (i, first, p + e)
                for d in range(first, last + 1):
                    if (hit := _verify(items, i, texts[d][2], p - int(starts[d]))) is not None:
                        found[d, i].append(hit)
            out = []
            for (d, i), hits in sorted(found.items()):
                doc_id, text, _ = texts[d]
                spots = [m.span() for m in _WORD.finditer(text)]
                taken: list[tuple[int, int]] = []
                for dist, a, b in sorted(set(hits)):
                    if all(b <= x or a >= y for x, y in taken):
                        taken.append((a, b))
                        out.append((doc_id, items.ids[i], spots[a][0], spots[min(b, len(spots)) - 1][1], dist, len(items.text[i])))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in range(6)], schema=schema)

        texts, held = [], 0
        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                texts.append((doc_id, text, normal(words)))
                held += len(text)
                if held > batch:
                    yield settle(texts)
                    texts, held = [], 0
        if texts:
            yield settle(texts)

    return run


def _blocks(benchmark: DataFrame) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """(number of blocks, items) of each block of about ITEM_BLOCK items, one in the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    n = max(1, -(-items.count() // ITEM_BLOCK))
    for i in range(n):
        rows = (items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items).collect()
        if rows := sorted((r[0], r[1]) for r in rows if len(words_of(r[1])) >= GRAM):
            yield n, rows


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (code points), distance, item_length of every passage found."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for n, rows in _blocks(benchmark):
        part = narrow.mapInArrow(_scan(rows), _OUT)
        part = save(part, "leaks") if n > 1 else part
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], _OUT)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark, with docs' columns: a pass for each block of items, row by row.

    Texts are not shuffled, and doc_id plays no part."""
    small_batches(docs.sparkSession)
    for n, rows in _blocks(benchmark):
        docs = _clean_rows(docs, rows)
        docs = save(docs, "leaks-left") if n > 1 else docs
    return docs


def _clean_rows(docs: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    columns = docs.columns
    taken = {c.lower() for c in columns}
    row = next(n for n in ("_row", *(f"_row{i}" for i in range(len(taken) + 1))) if n not in taken)
    scan = _scan(rows)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = pa.array(range(b.num_rows), pa.int64())
            bad = {x for out in scan(iter([pa.RecordBatch.from_arrays([at, b.column(b.schema.get_field_index("text"))], ["doc_id", "text"])])) for x in out.column(0).to_pylist()}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([i in bad for i in range(b.num_rows)], pa.bool_())], [*b.schema.names, row])

    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(row, T.BooleanType())]))
    return marked.filter(~F.col(row)).select(*columns)
