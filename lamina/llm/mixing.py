"""Operator 1. Mixing sources to target weights.

Token shares p of the sources are raised to an exponent a in [0, 1] and normalised (a = 1: as in the corpus,
a = 0: uniform). The exponent is found by bisection: the smallest that keeps the entropy of the weights at or
below a target, or that keeps every source at or below a number of passes; an entropy that no exponent reaches is
refused with a ValueError. The weights are then realised as
budgeted block permutations: each source is cut into hash blocks of bounded size, each block has the same
budget of passes (budget_s / tokens_s), whole passes take every row, and the part pass takes rows in a
permuted order until the block's budget is met (to the nearest row).

The default budget lets the source with the fewest passes have exactly one, so no row is left out; the others
are repeated. Null and empty texts have no tokens and take part in whole passes only; a null source is a
source of its own; repeated rows are rows; an empty table gives an empty result. Columns of the input named
like an added one are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
MAX_SOURCES = 1_000_000  # sources, not rows, come to the driver; more are refused


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tempered(shares: list[float], a: float) -> list[float]:
    top = max((math.log(p) for p in shares if p > 0), default=0.0)
    w = [math.exp(a * (math.log(p) - top)) if p > 0 else 0.0 for p in shares]
    total = math.fsum(w) or 1.0
    return [x / total for x in w]


def entropy(w: list[float]) -> float:
    return -math.fsum(x * math.log2(x) for x in w if x > 0)


def passes(shares: list[float], a: float) -> list[float]:
    """Passes over each source when the one with the fewest gets exactly one."""
    w = tempered(shares, a)
    rate = [x / p if p > 0 else 0.0 for x, p in zip(w, shares, strict=True)]
    least = min((r for r in rate if r > 0), default=1.0)
    return [r / least for r in rate]


def find_exponent(shares: list[float], target_entropy: float | None = None, max_passes: float | None = None, steps: int = 60) -> float:
    """The smallest exponent in [0, 1] that keeps both limits; both fall as the exponent grows."""

    def kept(a: float) -> bool:
        return (target_entropy is None or entropy(tempered(shares, a)) <= target_entropy + 1e-12) and (max_passes is None or max(passes(shares, a), default=0.0) <= max_passes + 1e-12)

    low, high = 0.0, 1.0
    if kept(low):
        return low
    if target_entropy is not None and entropy(tempered(shares, high)) > target_entropy + 1e-12:
        raise ValueError(f"the corpus itself has an entropy of {entropy(tempered(shares, high)):.4f} bits, above the target")
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if kept(mid) else (mid, high)
    return high


@dataclass(frozen=True)
class Mixture:
    exponent: float
    rows: list[tuple]  # source, rows, tokens, weight, passes


def plan(df: DataFrame, target_entropy: float | None = None, max_passes: float | None = 2.0, budget_tokens: int | None = None) -> Mixture:
    stats = df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(token_count(F.col("text"))).alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    stats.sort(key=lambda r: (r["source"] is not None, r["source"]))
    total = sum(r["t"] for r in stats)
    shares = [r["t"] / total if total else 0.0 for r in stats]
    a = find_exponent(shares, target_entropy, max_passes)
    weights, turns = tempered(shares, a), passes(shares, a)
    if budget_tokens is not None:
        turns = [budget_tokens * w / r["t"] if r["t"] else 0.0 for w, r in zip(weights, stats, strict=True)]
    return Mixture(a, [(r["source"], r["n"], r["t"], w, e if r["t"] else 1.0) for r, w, e in zip(stats, weights, turns, strict=True)])


ADDED = ("tokens", "weight", "mix_block", "epoch", "mix_key")


def _mixed(df: DataFrame, mixture: Mixture, seed: int, block_rows: int) -> tuple[DataFrame, dict[str, str]]:
    """df's columns and the added ones, under names that df does not have; those names by what they hold."""
    spark = df.sparkSession
    taken = {c.lower() for c in df.columns}
    name = {x: next(n for n in (f"_{x}", *(f"_{x}{i}" for i in range(len(taken) + 1))) if n not in taken) for x in (*ADDED, "source", "passes", "blocks", "rank", "before", "all", "copies")}
    col = {k: F.col(v) for k, v in name.items()}
    columns = df.columns
    blocks = [(s, float(w), float(e), max(1, math.ceil(n / block_rows))) for s, n, _, w, e in mixture.rows]
    side = spark.createDataFrame(blocks, f"{name['source']} {df.schema['source'].dataType.simpleString()}, {name['weight']} double, {name['passes']} double, {name['blocks']} int")
    side = F.broadcast(side) if len(blocks) < 100_000 else side
    ident = [F.col(c) for c in ("doc_id",) if c in df.columns]
    out = df.join(side, df["source"].eqNullSafe(side[name["source"]]))
    out = out.withColumn(name["tokens"], token_count(F.col("text")))
    row = F.monotonically_increasing_id()  # ties of equal keys are cut by place, so repeated rows differ
    out = out.withColumn(name["rank"], F.xxhash64(F.lit(seed), *ident, row))
    out = out.withColumn(name["mix_block"], F.pmod(F.xxhash64(F.lit(seed + 1), col["rank"]), col["blocks"]).cast("int"))
    part_of = ("source", name["mix_block"])
    w = W.partitionBy(*part_of).orderBy(name["rank"], *ident)
    out = out.withColumn(name["before"], F.coalesce(F.sum(name["tokens"]).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn(name["all"], F.sum(name["tokens"]).over(W.partitionBy(*part_of)))
    whole = F.floor(col["passes"])
    part = col["passes"] - whole
    extra = (col["tokens"] > 0) & (col["before"] + col["tokens"] / 2 <= part * col["all"])
    out = out.withColumn(name["copies"], (whole + extra.cast("int")).cast("int")).filter(col["copies"] > 0)
    out = out.withColumn(name["epoch"], F.explode(F.sequence(F.lit(0), col["copies"] - 1)))
    out = out.withColumn(name["mix_key"], F.xxhash64(F.lit(seed + 2), col["epoch"], col["rank"]))
    return out.select(*columns, *[col[x] for x in ADDED]), {x: name[x] for x in ADDED}


def mix_sources(df: DataFrame, target_entropy: float | None = None, max_passes: float | None = 2.0, budget_tokens: int | None = None, seed: int = 29, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df's rows as often as the mixture takes them, with tokens, weight, mix_block, epoch (from 0) and mix_key (order inside a block and epoch)."""
    out, names = _mixed(df, plan(df, target_entropy, max_passes, budget_tokens), seed, block_rows)
    return out.select(*[c for c in df.columns if c.lower() not in ADDED], *[F.col(names[x]).alias(x) for x in ADDED])


def repeated_rows(df: DataFrame, target_entropy: float | None = None, max_passes: float | None = 2.0, budget_tokens: int | None = None, seed: int = 29, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same rows with df's own columns only, whatever their names."""
    return _mixed(df, plan(df, target_entropy, max_passes, budget_tokens), seed, block_rows)[0].select(*df.columns)
