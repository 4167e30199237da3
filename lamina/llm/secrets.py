"""Operator 7. Secret scans through a trigram inverted index.

Each rule's regex is parsed into a Boolean query over the trigrams that any match must hold (alternatives of
sets of trigrams, in lower case). The index has a posting (trigram, row key) for every trigram of the rules'
queries that a text holds; intersecting the postings of an alternative gives the candidate texts, and only
these are searched with the regex. Rules without mandatory trigrams scan all texts.

Spans are (kind, start, end) in code points, end exclusive, leftmost non-overlapping for each kind. Null and
empty texts have none. Rows with equal doc_id and equal text get the same spans; repeated rows stay as they
are; a null doc_id is a key like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, spans, spans_text

try:  # the parser's name differs between Python versions
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p

MAX_STRINGS = 64
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # common to Java and Python
    valid: Callable[[Column], Column]
    base: bool = False


def _any(_: Column) -> Column:
    return F.lit(True)


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = [
    Rule("assign", ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", _any, True),  # 20 characters or more; a shorter run has no longer one inside
    Rule("hex", r"[0-9a-f]{24,}", _any, True),  # runs are maximal, so this drops just the short ones
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", _any),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", _any),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", _any),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", _any),
]


# ---------------------------------------------------------------- from a regex to trigrams


def _strings(node) -> set[str] | None:
    """All strings that a parsed item can match, in lower case, if they are few."""
    op, arg = node
    if op is _c.LITERAL:
        return {chr(arg).lower()}
    if op is _c.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is _c.LITERAL:
                out.add(chr(x).lower())
            elif kind is _c.RANGE and x[1] - x[0] < MAX_STRINGS:
                out |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is _c.SUBPATTERN:
        return _joined(arg[-1])
    if op is _c.BRANCH:
        parts = [_joined(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] <= 1:
        inner = _joined(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if op is _c.AT:
        return {""}
    return None


def _joined(items) -> set[str] | None:
    out = {""}
    for x in items:
        s = _strings(x)
        if s is None or len(out) * len(s) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def _of(strings: set[str]) -> list[frozenset[str]]:
    """One alternative for each string: the trigrams it holds. Nothing is known if a string is short."""
    if any(len(s) < 3 for s in strings):
        return []
    return [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]


def _and(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    if not a or not b:
        return a or b
    return [x | y for x in a for y in b] if len(a) * len(b) <= MAX_STRINGS else min(a, b, key=len)


def _query(items) -> list[frozenset[str]]:
    known: list[frozenset[str]] = []
    run = {""}
    for node in items:
        s = _strings(node)
        if s is not None and len(run) * len(s) <= MAX_STRINGS:
            run = {a + b for a in run for b in s}
            continue
        known, run = _and(known, _of(run)), {""}
        op, arg = node
        if s is not None:
            run = s
        elif op is _c.SUBPATTERN:
            known = _and(known, _query(arg[-1]))
        elif op is _c.BRANCH:
            parts = [_query(x) for x in arg[1]]
            if all(parts):
                known = _and(known, [y for p in parts for y in p])
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1:
            known = _and(known, _query(arg[2]))
    return _and(known, _of(run))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigram sets, one of which each text with a match holds whole (in lower case); [] if none is mandatory."""
    found = _query(_p.parse(pattern))
    return [a for a in found if not any(b < a for b in found)]


# ---------------------------------------------------------------- the index


def _key(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that rows with equal doc_id and text share."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.struct(F.col("doc_id").alias("d"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("n")).alias("key"))


def build_index(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Postings (trigram, key), one for each trigram of the rules' queries that a text holds."""
    grams = sorted({g for r in rules for a in trigram_query(r.pattern) for g in a})
    lower = _key(docs).select("key", F.lower("text").alias("low"))
    # lower() also folds letters beyond ASCII, some of them into ASCII ones; that only adds candidates
    found = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]), lambda x: x.isNotNull()) if grams else F.expr("cast(array() as array<string>)")
    return lower.select("key", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(key, kinds): the rules of which some alternative has the key in all its postings."""
    spark = index.sparkSession
    terms = [(r.kind, j, len(a), g) for r in rules for j, a in enumerate(trigram_query(r.pattern)) for g in sorted(a)]
    wanted = spark.createDataFrame(terms, "kind string, alternative int, need int, trigram string")
    hits = index.join(F.broadcast(wanted), "trigram").groupBy("key", "kind", "alternative", "need").agg(F.count_distinct("trigram").alias("n"))
    return hits.filter("n = need").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _find(rows: DataFrame, rules: list[Rule], when: Callable[[Rule], Column] | None = None) -> DataFrame:
    for r in rules:
        found = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        rows = rows.withColumn(f"_m_{r.kind}", found if when is None else F.when(when(r), found))
    return rows.select("doc_id", "key", *[spans(F.col("text"), F.coalesce(F.col(f"_m_{r.kind}"), F.expr("cast(array() as array<string>)")), r.pattern, r.valid).alias(r.kind) for r in rules])


def scan_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id and for each rule a column of its kind: array<struct<s,e,v>>. Texts do not move: the index's answers come to them."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    scanned = [r for r in rules if not trigram_query(r.pattern)]
    keyed = _key(docs)
    out = _find(keyed, scanned) if scanned else keyed.select("doc_id", "key")
    if indexed:
        cand = save(candidates(build_index(docs, indexed), indexed), "secret-candidates")
        few = cand.count() <= BROADCAST_ROWS
        side = F.broadcast(cand) if few else cand
        texts = keyed.join(side, keyed["key"] == side["key"]).drop(side["key"])  # keys are structs: never null, and nulls inside are equal
        held = _find(texts, indexed, lambda r: F.array_contains("kinds", r.kind)).drop("doc_id").withColumnRenamed("key", "_k")
        held = held.filter(reduce(lambda a, b: a | b, [F.size(r.kind) > 0 for r in indexed])).dropDuplicates(["_k"])
        out = out.join(held, out["key"] == held["_k"], "left").drop("_k")
        none = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")
        for r in indexed:
            out = out.withColumn(r.kind, F.coalesce(F.col(r.kind), none))
    return out.select("doc_id", *[r.kind for r in rules])


def secret_digest(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    base = [r for r in rules if r.base]
    rows = scan_secrets(docs, rules)
    return rows.select("doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in base], F.sha2(spans_text([(r.kind, F.col(r.kind)) for r in base]), 256).alias("base_sha256"), spans_text([(r.kind, F.col(r.kind)) for r in rules]).alias("spans"))


def find_in_python(text: str | None, rules: list[Rule] = RULES) -> dict[str, list[tuple[int, int]]]:
    """The plain meaning, for tests: every regex over the whole text."""
    out = {}
    for r in rules:
        hits = [m for m in re.finditer(r.pattern, text or "", re.ASCII)]
        out[r.kind] = [m.span() for m in hits if r.kind != "assign" or len(m[2]) >= 6]
    return out
