"""Helpers that the operators of this subpackage share: tables, durable scratch tables, native span search, word hashes."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_MADE: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of BATCH_ROWS from here on in this session, unless it has a size of its own:
    whole texts of 10,000 rows, as Arrow, strings and arrays of hashes, would take most of a worker's memory."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, each: int = 64 << 20) -> int:
    """Parts for what a task gathers in Python: spark.sql.shuffle.partitions, or more, so that each has at most `each` bytes of df's files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()) if leaves.apply(i).nodeName().startswith("LogicalRelation")]
    return max(shuffle_partitions(df.sparkSession), min(sum(sizes) // each, 1_000_000))


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def save(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read back. The files stay until the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = []
        atexit.register(_sweep, spark, app)
    _MADE[app].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by save() that nothing will read again."""
    drop_path(df.sparkSession, df._lamina_path)


def collect(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that are done: they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _sweep(spark: SparkSession, app: str) -> None:
    try:
        for path in _MADE.pop(app, []):
            drop_path(spark, path)
    except Exception:  # the session may have ended before
        pass


# ---------------------------------------------------------------- native span search


def bound(f: Callable, *args) -> Callable[[Column], Column]:
    """f of an element and args, as the one-argument function that higher-order functions want."""
    return lambda x: f(x, *args)


def spans(text: Column, matches: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """array<struct<s:int,e:int,v:string>> in code points, end exclusive, of the matches that are valid.

    matches is the column that holds regexp_extract_all(text, pattern, 0). The pieces between matches
    (split by the same pattern) give the offsets; texts without a valid match are not split.
    """
    empty = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")
    pieces = F.split(text, pattern, -1)
    paired = F.arrays_zip(pieces.alias("p"), matches.alias("m"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        out = F.when(valid(x["m"]), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v"))))).otherwise(acc["out"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(e.alias("at"), out.alias("out")))

    return F.when(F.exists(matches, valid), F.aggregate(paired, start, step, lambda acc: acc["out"])).otherwise(empty)


def spans_text(kinds: list[tuple[str, Column]]) -> Column:
    """kind:start:end by start, then kind in the order given, comma-joined."""
    parts = [F.transform(c, bound(lambda x, i, k: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"), F.lit(k).alias("n")), i, k)) for i, (k, c) in enumerate(kinds)]
    rows = F.array_sort(F.concat(*parts))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["n"], x["s"].cast("string"), x["e"].cast("string"))), ",")


# ---------------------------------------------------------------- words and hashes in numpy

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z only, split on space and \\x09-\\x0d: bytes.lower and bytes.split do just that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of n successive words at each position; empty if there are fewer words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + h[i : len(h) - n + 1 + i] * _ODD[i % len(_ODD)] + np.uint64(i))
    return out


def shingles(h: np.ndarray, n: int = 5) -> np.ndarray:
    """The sorted set of n-word shingles; the whole sequence as one where there are fewer words; none without words."""
    if len(h) == 0:
        return np.empty(0, np.uint64)
    return np.unique(grams(h, n) if len(h) >= n else mix(grams(h, len(h)) + _ODD[7] + np.uint64(len(h))))
