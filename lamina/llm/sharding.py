"""Operator 8. Sharding by a hypergeometric communication matrix.

A uniform random shuffle with exact shard sizes: rows lie in input blocks (one or more input tasks each); the driver
draws how many rows each block sends to each target cell (rows of the matrix sum to block sizes, columns to cell sizes,
every matrix as likely as a uniform permutation makes it); each block is permuted locally, so ranks decide the cell;
rows are exchanged, once; each cell is permuted again. Cells subdivide shards, so the second permutation has as many
tasks as wanted, not as many as shards. The local permutation is a keyed Feistel network over the places in the block,
so a row's rank follows from its place alone and nothing moves for it. Blocks are made so large that the matrix has at
most EDGES entries, whatever the number of tasks.

Law: ``rows`` (counts of the shards at most one apart). Nulls in any column, empty and repeated rows are rows
like others (a null text has size 1 and crc32 0); an empty table gives an empty result. Columns of the input
named like an added one are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save, shuffle_partitions

LAW = "rows"
EDGES = 400_000
ROUNDS = 8
WALK = 40


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact draw of any population size: inversion over a window of 40 deviations about the mode, from mass ratios."""
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    p = good / total
    spread = int(40 * math.sqrt(draws * p * (1 - p) * (total - draws) / (total - 1)) + 40)
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1))])
    mass = np.exp(logs - logs.max())
    return a + int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum()))


def communication_matrix(blocks: list[int], cells: list[int], seed: int) -> list[list[int]]:
    """Rows: what each block sends to each cell. The sums by row and by column are exact."""
    rng = np.random.default_rng(seed)
    left, out = list(cells), []
    for n in blocks:
        rest, todo, row = sum(left), n, []
        for j, room in enumerate(left):
            x = hypergeometric(rng, room, rest - room, todo)
            row.append(x)
            rest -= room
            todo -= x
            left[j] -= x
        out.append(row)
    return out


def cell_sizes(total: int, shards: int, cells_per_shard: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, size) of every cell; shard sizes are at most one apart."""
    out = []
    for s in range(shards):
        size = total // shards + (s < total % shards)
        for c in range(cells_per_shard):
            first = size * c // cells_per_shard
            out.append((s, first, size * (c + 1) // cells_per_shard - first))
    return out


def permuted(place: Column, n: Column, key: Column) -> Column:
    """The rank of a place under a pseudo-random permutation of 0 to n - 1 that the key chooses.

    A Feistel network over a grid of about sqrt(n) by sqrt(n); what falls on the grid's few spare cells walks on. There
    are fewer than sqrt(n) + 1 of those, so WALK steps are enough up to n = 1600, and beyond each step fails with a
    probability below 1 / 40.
    """
    wide = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    high = F.ceil(n / wide).cast("long")

    def once(x: Column) -> Column:
        left, right = x % wide, F.floor(x / wide).cast("long")
        state = F.struct(left.alias("l"), right.alias("r"))

        def turn(acc, i):
            left = (acc["l"] + F.pmod(F.xxhash64(acc["r"], i, key), wide)) % wide
            return F.struct(left.alias("l"), ((acc["r"] + F.pmod(F.xxhash64(left, i, key, F.lit(1)), high)) % high).alias("r"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, turn, lambda acc: acc["r"] * wide + acc["l"])

    def step(x, i):
        return F.when((x < n) & (i > 0), x).otherwise(once(x))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), place.cast("long"), step)
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("the permutation walked too long")).cast("long"))


def shuffle_shards(df: DataFrame, shards: int = 8, seed: int = 17, stable: bool = False) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    stable: df reads stored files without an exchange, so a second pass sees the same rows in the same tasks;
    other inputs are first written to the shared folder.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    taken = {c.lower() for c in df.columns}
    row, task, rank, cell = (next(n for n in (f"_{x}", *(f"_{x}{i}" for i in range(len(taken) + 1))) if n not in taken) for x in ("row", "task", "rank", "cell"))
    if not stable:
        df = save(df, "sharding-in")
    number = F.monotonically_increasing_id()  # the task, and the place in it
    df = df.withColumn(row, number).withColumn(task, F.shiftright(row, 33).cast("int"))
    counts = sorted((r[0], r[1]) for r in df.groupBy(task).count().collect())  # one row for each input task
    total = sum(n for _, n in counts)
    plan = cell_sizes(total, shards, max(1, math.ceil(shuffle_partitions(spark) / shards)))
    each = max(1, math.ceil(len(counts) * len(plan) / EDGES))  # tasks in a block
    blocks = [counts[i : i + each] for i in range(0, len(counts), each)]
    sizes = [sum(n for _, n in b) for b in blocks]
    matrix = communication_matrix(sizes, [size for _, _, size in plan], seed)
    fan = max(1, math.isqrt(len(plan)))
    rows = []
    for number, (tasks, size, sent) in enumerate(zip(blocks, sizes, matrix, strict=True)):
        ends = np.cumsum([0, *sent[:-1]])
        cells = [(int(at), j, plan[j][0], plan[j][1]) for j, at in enumerate(ends) if sent[j]]
        # two levels of search: the last group that begins at or before a rank, and in it the last cell
        groups = [(cells[i][0], cells[i : i + fan]) for i in range(0, len(cells), fan)]
        before = np.cumsum([0, *(n for _, n in tasks[:-1])]).tolist()
        rows += [(t, number, int(at), size, groups) for (t, _), at in zip(tasks, before, strict=True)]
    lookup = spark.createDataFrame(rows, f"{task} int, _block int, _first long, _size long, _groups array<struct<at:long,cells:array<struct<at:long,cell:int,shard:int,first:long>>>>")
    place = F.col(row) - F.shiftleft(F.col(task).cast("long"), 33) + F.col(f"{cell}.first")
    side = lookup.select(task, F.struct(F.col("_block").alias("block"), F.col("_first").alias("first"), F.col("_size").alias("size"), F.col("_groups").alias("groups")).alias(cell))
    sent = df.join(F.broadcast(side), task)  # at most EDGES cells, and a row for each task
    sent = sent.withColumn(rank, permuted(place, F.col(f"{cell}.size"), F.xxhash64(F.lit(seed), F.col(f"{cell}.block"))))
    group = F.element_at(f"{cell}.groups", F.size(F.filter(f"{cell}.groups", lambda x: x["at"] <= F.col(rank))))["cells"]
    sent = sent.withColumn(cell, group)
    sent = sent.withColumn(cell, F.element_at(cell, F.size(F.filter(cell, lambda x: x["at"] <= F.col(rank)))))
    again = W.partitionBy(f"{cell}.cell").orderBy(F.xxhash64(F.lit(seed + 1), row), row)
    sent = sent.withColumn("slot", F.col(f"{cell}.first") + F.row_number().over(again) - 1).withColumn("shard", F.col(f"{cell}.shard"))
    return sent.drop(row, task, cell, rank)


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 17, stable: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law does not grow by moving few rows)."""
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    narrow = docs.select("doc_id", (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = shuffle_shards(narrow, shards, seed, stable)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
