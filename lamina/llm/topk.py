"""Operator 3. Exact top-k by inner product with a three-phase uniform threshold.

Components x become floor(256 x). The dimensions are cut into LISTS lists; a vector's score for a query is the
sum of its partial scores, one from each list.
Phase 1: each task takes, for each query and list, the k vectors of the largest partial scores, completes their
scores, and sends the k best; the k-th best of all, tau, is a safe cutoff (it is at most the k-th best score).
Phase 2: tau goes to all tasks; an entry whose every partial score is below tau / LISTS cannot reach tau, so each
task collects only entries with some partial score at or above it.
Phase 3: the missing partial scores of those entries are resolved exactly; at most k of each task and query that
reach tau go on to the merge.

Queries go out in broadcasts of at most QUERY_BLOCK vectors; more queries take more rounds, so what is broadcast
never grows with the data. Vectors that are null, empty or hold null or non-finite components take no part.
Vectors of fewer components than others count as zero in those that they lack. A null vec_id takes no part.
Candidates with the query's own vec_id are left out, so a repeated vec_id never answers itself; apart from that
repeated rows are candidates of their own. Ties go to the smaller vec_id. Scores beyond 64 bits are refused with
an OverflowError. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save

LISTS = 4
QUERY_BLOCK = 4096
QUERY_CHUNK = 512  # with ROWS and LISTS, what a task holds of partial scores: 16 MB
ROWS = 1024
_OUT = "query_id long, vec_id long, score long"


def quantise(vectors: list[list[float]], width: int | None = None) -> np.ndarray:
    """Rows of floor(256 x) as float64 integers, or Python integers where products might pass 2**53."""
    width = max((len(v) for v in vectors), default=0) if width is None else width
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:width]
    return np.floor(out * 256.0)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64 if every sum of products stays below 2**53, else as Python integers."""
    top = (np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return a, b
    whole = np.vectorize(int, otypes=[object])
    return (whole(a) if a.size else a.astype(object)), (whole(b) if b.size else b.astype(object))


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list]]:
    for batch in it:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), part.column(1).to_pylist()


def _out(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    if s.dtype == object and len(s) and max(abs(int(x)) for x in s) >= 2**63:
        raise OverflowError("a score does not fit into 64 bits")
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s.astype(np.int64), pa.int64())], ["query_id", "vec_id", "score"])


class _Best:
    """The k best of each query so far, ties to the smaller vec_id. Holds k entries for each query of the block."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.rows = k, [np.empty(0, np.int64)] * 3
        self.wide = False

    def add(self, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        if s.dtype == object:
            self.rows[2] = self.rows[2].astype(object)
        q, v, s = (np.concatenate([a, b]) for a, b in zip(self.rows, (q, v, s), strict=True))
        order = np.lexsort((v, -s if s.dtype != object else np.array([-int(x) for x in s], dtype=object).astype(np.float64), q)) if s.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(s[i]), v[i])), dtype=np.int64)
        q, v, s = q[order], v[order], s[order]
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.empty(0, np.int64)
        keep = rank < self.k
        self.rows = [q[keep], v[keep], s[keep]]


def _parts(x: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Partial scores (vectors by queries), one array for each list of dimensions."""
    return [x[:, cut] @ q[:, cut].T for cut in np.array_split(np.arange(q.shape[1]), min(LISTS, max(1, q.shape[1])))]


def _phase(queries: tuple[np.ndarray, np.ndarray], k: int, tau: dict[int, int] | None):
    ids, q = queries

    def block(vec: np.ndarray, x: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of what a phase sends of some vectors and the queries at `at`."""
        own = ids[at : at + QUERY_CHUNK]
        parts = _parts(*_exact(x, q[at : at + QUERY_CHUNK]))
        low = None if tau is None else [tau.get(int(i)) for i in own]
        take = np.zeros((len(vec), len(own)), bool)
        if low is None:  # phase 1: the tops of the local lists
            n = min(len(vec), k + 1)  # one more, for the query's own entry
            for p in parts:
                top = np.argpartition(-p.astype(np.float64), n - 1, axis=0)[:n] if n < len(vec) else np.tile(np.arange(len(vec))[:, None], (1, len(own)))
                np.put_along_axis(take, top, True, axis=0)
        else:  # phase 2: the uniform threshold
            bar = np.array([-np.inf if t is None else t / len(parts) for t in low])
            for p in parts:
                take |= p >= bar[None, :]
        take &= vec[:, None] != own[None, :]
        v, j = np.nonzero(take)
        score = sum((p[v, j] for p in parts[1:]), parts[0][v, j])  # phase 3: the missing partial scores, of these entries only
        if low is not None:
            reach = np.array([low[c] is None or s >= low[c] for c, s in zip(j, score, strict=True)], bool) if score.dtype == object else score >= np.array([-np.inf if t is None else t for t in low])[j]
            v, j, score = v[reach], j[reach], score[reach]
        return own[j], vec[v], score if score.dtype == object else score.astype(np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(ids), k)
        for vec, raw in _batches(it):
            x = quantise(raw, max(q.shape[1], max((len(r) for r in raw), default=0)))[:, : q.shape[1]]
            found = [block(vec, x, at) for at in range(0, len(ids), QUERY_CHUNK)]
            wide = any(s.dtype == object for _, _, s in found)
            best.add(*(np.concatenate([f[i].astype(object) if wide and i == 2 else f[i] for f in found]) for i in range(3)))
        if len(best.rows[0]):
            yield _out(*best.rows)

    return run


def _merge(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable(embeddings: DataFrame) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter(F.col("vec_id").isNotNull() & fine)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each vec_id of queries (both vec_id, embedding)."""
    spark = vectors.sparkSession
    vectors = usable(vectors)
    queries = usable(queries).dropDuplicates(["vec_id"])
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    parts = []
    if blocks > 1:  # hash blocks of about QUERY_BLOCK; each is read on its own
        queries = save(queries.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition("_block"), "topk-queries")
    for i in range(blocks):
        rows = (queries.filter(F.col("_block") == i) if blocks > 1 else queries).select("vec_id", "embedding").collect()
        rows.sort(key=lambda r: r["vec_id"])
        if not rows:
            continue
        block = (np.array([r["vec_id"] for r in rows], np.int64), quantise([r["embedding"] for r in rows]))
        first = vectors.mapInArrow(_phase(block, k, None), _OUT)
        tau = {r[0]: r[1] for r in _merge(first, k).filter(F.col("rank") == k).select("query_id", "score").collect()}
        last = vectors.mapInArrow(_phase(block, k, tau), _OUT)
        parts.append(_merge(last, k) if blocks == 1 else save(_merge(last, k), "topk-part"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_neighbours(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    return search(embeddings, embeddings.filter(F.col("vec_id") % every == 0), k)
