"""Operator 5. Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over the hashed presence of words and stems are trained in numpy from confirmed toxic texts (positives) and
unlabelled texts (rows of documents outside the held-out fold, labelled or not; a label stays hidden) with the non-negative
risk  pi R_P(+) + max(0, R_U(-) - pi R_P(-))  under the logistic loss, pi being the class prior. The score of a
text is the mean probability of the classifiers.

Training sees a bounded sample: at most MAX_POSITIVES and MAX_UNLABELLED rows, those of the smallest hash of
doc_id, once each, and at most MAX_IDS features of a text. Rows whose crc32(doc_id as text) mod 5 is 0 are held out: their labels are never read. The prior is the
share of toxic rows among the labelled training rows. Scores come from whole texts alone; label, lang, source and
doc_id are no inputs.

A null text is an empty one; empty texts get the score of no words. Rows with a null doc_id are scored, held out
(their text of doc_id is empty, crc32 0) and never trained on. A doc_id with several labels is toxic if one says
so. Repeated rows stay as they are. Without any positive (or an empty table) all scores are the prior, 0 if
unknown. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

MAX_POSITIVES = 4_000
MAX_UNLABELLED = 8_000
BITS = 20
STEMS = (4, 5, 6)  # bytes
FOLDS = 5
CLASSIFIERS = 3
MAX_IDS = 8_192
WORDS_KEPT = 100_000
_MASK = (1 << BITS) - 1
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if (97 <= b <= 122 or b >= 128 or 48 <= b <= 57) else 32 for b in range(256))


class Words(dict):
    """word -> the ids of its features that are in use, kept for the words met last."""

    def __init__(self, used: set[int] | None = None) -> None:
        self.used = used

    def __missing__(self, w: bytes) -> tuple[int, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        ids = [crc32(w) & _MASK, *(crc32(w[:n] + b"\x01") & _MASK for n in STEMS if len(w) > n)]
        self[w] = out = tuple(i for i in ids if self.used is None or i in self.used)
        return out

    def of(self, text: str | None) -> list[int]:
        """The distinct features of the words (lower case; letters, digits and all beyond ASCII) and of their beginnings,
        which stand for stems that endings vary, sorted."""
        words = set((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())
        return sorted(set().union(*map(self.__getitem__, words)))


@dataclass
class Model:
    weights: np.ndarray  # classifiers by 2**BITS
    bias: np.ndarray

    def used(self) -> np.ndarray:
        return np.flatnonzero(np.any(self.weights != 0, axis=0))

    def score(self, ids: list[int]) -> float:
        z = self.weights[:, ids].sum(axis=1, dtype=np.float64) + self.bias
        return float(np.mean(_sigmoid(z)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
    return ids, np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def informative(positives: list[np.ndarray], unlabelled: list[np.ndarray], keep: int) -> np.ndarray:
    """The keep features that differ most between positive and unlabelled texts (G statistic of presence)."""
    p = np.bincount(np.concatenate(positives), minlength=1 << BITS).astype(np.float64)
    u = np.bincount(np.concatenate([*unlabelled, np.empty(0, np.int32)]), minlength=1 << BITS).astype(np.float64)
    a, b = len(positives), len(unlabelled)

    def part(x, n, q):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / (n * q)), 0.0) + np.where(n - x > 0, (n - x) * np.log((n - x) / (n * (1 - q))), 0.0)

    q = (p + u) / (a + b)
    g = np.where((q > 0) & (q < 1) & (p >= min(3, a)), part(p, a, q) + part(u, b, q), 0.0)
    best = np.argsort(-g, kind="stable")[:keep]
    return np.sort(best[g[best] > 0])


def train(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, classifiers: int = CLASSIFIERS, epochs: int = 200, rate: float = 0.1, decay: float = 1e-5, batches: int = 2, keep: int = 2048, seed: int = 5) -> Model:
    size = 1 << BITS
    prior = float(np.clip(prior, 1e-3, 0.9))
    out = Model(np.zeros((classifiers, size), np.float32), np.full(classifiers, np.log(prior / (1 - prior))))
    if not positives or not unlabelled:
        return out
    used = informative(positives, unlabelled, keep)
    place = np.full(size, -1, np.int64)
    place[used] = np.arange(len(used))
    pos = [x[x >= 0] for x in (place[r] for r in positives)]
    unl = [x[x >= 0] for x in (place[r] for r in unlabelled)]
    gain = np.ones(len(used))
    for c in range(classifiers):
        rng = np.random.default_rng(seed + c)
        w, b = np.zeros(len(used)), out.bias[c]
        m, v, mb, vb, t = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, 0
        for _ in range(epochs):
            po, uo = np.array_split(rng.permutation(len(pos)), min(batches, len(pos))), np.array_split(rng.permutation(len(unl)), min(batches, len(pos), len(unl)))
            for pi, ui in zip(po, uo, strict=False):
                (pid, prow), (uid, urow) = _flat([pos[i] for i in pi]), _flat([unl[i] for i in ui])
                zp = np.bincount(prow, w[pid] * gain[pid], len(pi)) + b
                zu = np.bincount(urow, w[uid] * gain[uid], len(ui)) + b
                sp, su = _sigmoid(zp), _sigmoid(zu)
                negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
                gp = -prior * (1 - sp) / len(pi)
                if negative >= 0:
                    gp = gp - prior * sp / len(pi)
                    gu = su / len(ui)
                else:  # the part is clipped at 0: only the risk of the positives is left
                    gu = np.zeros(len(ui))
                g = (np.bincount(pid, gp[prow], len(used)) + np.bincount(uid, gu[urow], len(used))) * gain + decay * w
                gb = gp.sum() + gu.sum()
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
        out.weights[c, used] = w * gain
        out.bias[c] = b
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0


def _some(ids: list[int]) -> np.ndarray:
    """At most MAX_IDS of the features, evenly over the hashes."""
    return np.array(ids[:: -(-len(ids) // MAX_IDS)] if len(ids) > MAX_IDS else ids, "<i4")


def _featured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in it:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_some(words.of(t)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["toxic", "ids"])


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    small_batches(docs.sparkSession)
    order = F.xxhash64(F.lit(11), "doc_id")
    marks = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    shares = marks.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    if prior is None:
        prior = (shares[0] or 0) / shares[1] if shares[1] else 0.0
    small = Model(np.zeros((1, 1 << BITS), np.float32), np.array([np.log(prior / (1 - prior)) if 0 < prior < 1 else -50.0]))
    if not shares[0]:
        return small
    chosen = marks.filter("toxic = 1").orderBy(order).limit(MAX_POSITIVES).withColumn("part", F.lit(1))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    hidden = ids.orderBy(F.xxhash64(F.lit(12), "doc_id")).limit(MAX_UNLABELLED).withColumn("part", F.lit(0))
    wanted = chosen.select("doc_id", "part").unionByName(hidden)
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id", "part"]).select("part", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.mapInArrow(_featured, "toxic int, ids binary").collect()
    found, hidden_ids = ([np.frombuffer(r["ids"], "<i4") for r in rows if r["toxic"] == k] for k in (1, 0))
    return train(found, hidden_ids, prior)


def _free(name: str, docs: DataFrame) -> str:
    """name, or name with a number, that no column of docs has in either case."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (name, *(f"{name}{i}" for i in range(len(taken) + 1))) if n not in taken)


def score_toxicity(docs: DataFrame, model: Model, keep: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; keep: instead all columns of docs and the score by this name."""
    spark = docs.sparkSession
    small_batches(spark)
    used = model.used()
    packed = spark.sparkContext.broadcast((used, model.weights[:, used], model.bias))  # at most 2**BITS words
    name = _free("_score", docs)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, w, bias = packed.value
        size = 1 << BITS
        full = np.zeros((w.shape[0], size), np.float32)
        full[:, where] = w
        own, words = Model(full, bias), Words(set(where.tolist()))
        for b in it:
            col = b.column(b.schema.get_field_index("text"))
            scores = pa.array([own.score(words.of(t)) for t in col.to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, name])

    rows = docs if keep else docs.select("doc_id", "text")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    out = rows.mapInArrow(run, schema)
    if keep:
        return out.withColumnRenamed(name, keep)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, fit(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below 0.5, with docs' columns."""
    score = _free("_score", docs)
    return score_toxicity(docs, fit(docs, labels), keep=score).filter(F.col(score) < 0.5).drop(score)
