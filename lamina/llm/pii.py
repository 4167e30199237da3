"""Operator 4. Personal data and the terms that disclose it.

Base finds: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers, leftmost non-overlapping
for each kind, over whole texts. Each distinct value is a protected entity e. The terms t of the texts that hold it
may reveal it. Over the whole corpus, with documents as the unit, IC(e) = -log2(n(e) / N) and
PMI(t; e) = log2(n(t, e) N / (n(t) n(e))), where n(t, e) counts the documents with a text that holds both, wherever
they stand in it, and n(t) those that hold t at all. A term that stands with e in MIN_TOGETHER documents or more
discloses it in the ratio PMI / IC: from GENERALISE on it is generalised to [TERM], from REMOVE on it is removed, at
every place in every text that holds e.

Terms are words of three code points or more. A word that touches a base find is part of it, and goes with it.

Nulls count as empty texts; they have no spans. Rows with equal doc_id count as one document in the corpus
counts; each row gets its own spans. A null doc_id is a document of its own. An empty table gives an empty
result; other columns are not read, but sanitise() keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, save, spans, spans_text

MIN_TOGETHER = 2
GENERALISE = 0.8
REMOVE = 0.98
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20

# Possessive runs and "start of a run, or end of the last match" keep long runs linear without changing what is found.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
COVER = "\ufdd0"  # stands for each code point of a base find; no character
WORD = r"[\p{L}\p{N}]{3,}+"
FREE = rf"(?<![\p{{L}}\p{{N}}{COVER}]){WORD}(?!{COVER})"  # a word that touches no find


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))

    def add(acc, i):
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _ip_ok(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda x: F.when(F.length(F.ltrim(F.lit("0"), x)) > 3, False).otherwise(F.coalesce(F.try_to_number(F.concat(F.lit("0"), F.right(x, F.lit(3))), F.lit("9999")), F.lit(0)) <= 255))


def _card_ok(v: Column) -> Column:
    return F.when(F.length(_digits(v)).between(14, 19), luhn(v)).otherwise(False)


def _phone_ok(v: Column) -> Column:
    return F.length(_digits(v)).between(10, 15)


#: kind, pattern, test of a match, a cheap test that texts with a match pass
KINDS = [
    ("email", EMAIL, lambda v: F.lit(True), lambda t: F.contains(t, F.lit("@"))),
    ("ip", IP, _ip_ok, lambda t: F.lit(True)),
    ("card", CARD, _card_ok, lambda t: F.lit(True)),
    ("phone", PHONE, _phone_ok, lambda t: F.contains(t, F.lit("+"))),
]
_NONE = "cast(array() as array<struct<s:int,e:int,v:string>>)"


def find_base(docs: DataFrame) -> DataFrame:
    """docs with a column of spans for each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("text", text)
    for kind, pattern, _, quick in KINDS:
        rows = rows.withColumn(f"_m_{kind}", F.when(quick(F.col("text")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    for kind, pattern, ok, _ in KINDS:
        rows = rows.withColumn(kind, spans(F.col("text"), F.coalesce(F.col(f"_m_{kind}"), F.expr("cast(array() as array<string>)")), pattern, ok))
    return rows.drop(*[f"_m_{k}" for k, *_ in KINDS])


def _words(text: Column, pattern: str) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def _covered(text: Column, held: Column) -> Column:
    """text, of the same length, with COVER at each place of a find; held: array<struct<s,e,...>>."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        s = F.greatest(x["s"], acc["at"])
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s - acc["at"]), F.repeat(F.lit(COVER), x["e"] - s))
        return F.when(x["e"] <= acc["at"], acc).otherwise(F.struct(x["e"].alias("at"), out.alias("out")))

    done = F.aggregate(F.array_sort(F.transform(held, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))), start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def _shared(docs: DataFrame) -> tuple[int, DataFrame | None]:
    """How many documents there are (rows of one doc_id are one, each row without one is one), and the doc_ids of several rows, if any."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    total, several = ids.agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(1)), F.count_if(F.col("doc_id").isNotNull() & (F.col("n") > 1))).first()
    if not several:
        return total or 0, None
    shared = save(ids.filter(F.col("doc_id").isNotNull() & (F.col("n") > 1)).select("doc_id"), "pii-shared")
    return total, F.broadcast(shared) if several <= BROADCAST_ROWS else shared


def _count(rows: DataFrame, shared: DataFrame | None, each: Callable[[DataFrame], DataFrame], keys: list[str], name: str) -> DataFrame:
    """keys and in how many documents they stand; each() gives the keys of rows, with doc_id, once a row.

    Only rows that share their doc_id are compared with each other; those of all other rows are counted where they are read.
    """
    one = each(rows if shared is None else rows.join(shared, "doc_id", "left_anti")).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    if shared is None:
        return one
    many = each(rows.join(shared, "doc_id", "left_semi")).select("doc_id", *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return one.unionByName(many).groupBy(*keys).agg(F.sum(name).alias(name))


def _pairs(holders: DataFrame) -> DataFrame:
    return holders.select("row", "doc_id", F.explode("entities").alias("entity"), "words").select("row", "doc_id", "entity", F.explode("words").alias("term"))


def disclosures(docs: DataFrame, holders: DataFrame, entities: DataFrame, total: int, shared: DataFrame | None) -> DataFrame:
    """(entity, term, pmi, ic, ratio) of the terms that disclose, from corpus counts.

    holders: row, doc_id, entities, words (the distinct ones of the whole text), one row for each text that holds one of
    entities (entity, n_e). Documents, not rows, are counted in all four numbers.
    """
    pairs = save(_count(holders, shared, _pairs, ["entity", "term"], "n_te").filter(F.col("n_te") >= MIN_TOGETHER), "pii-pairs")
    wanted = pairs.select("term").distinct()
    n, size = wanted.agg(F.count(F.lit(1)), F.sum(F.octet_length("term"))).first()
    few = n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES

    def held(rows: DataFrame) -> DataFrame:
        terms = rows.select("doc_id", F.explode(_words(F.coalesce("text", F.lit("")), WORD)).alias("term"))
        return terms.join(F.broadcast(wanted), "term", "left_semi") if few else terms

    counts = _count(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shared, held, ["term"], "n_t")
    ic = -F.log2(F.col("n_e") / F.lit(float(total or 1)))
    pmi = F.log2(F.col("n_te") * F.lit(float(total or 1)) / (F.greatest("n_t", "n_te") * F.col("n_e")))
    out = pairs.join(counts, "term").join(entities, "entity").select("entity", "term", pmi.alias("pmi"), ic.alias("ic"))
    return out.withColumn("ratio", F.when(F.col("ic") > 0, F.col("pmi") / F.col("ic")).otherwise(F.lit(0.0))).filter(F.col("ratio") >= GENERALISE)


def _scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, a column of spans for each base kind, and term, of docs (row, doc_id, text)."""
    base = find_base(docs)
    kinds = [k for k, *_ in KINDS]
    occurrences = F.concat(*[F.transform(k, bound(lambda x, k: F.struct(F.concat(F.lit(k + ":"), F.lower(x["v"])).alias("entity"), x["s"].alias("s"), x["e"].alias("e")), k)) for k in kinds])
    rows = base.withColumn("held", occurrences).select("row", "doc_id", *kinds, "held", F.when(F.size("held") > 0, F.col("text")).alias("text"))
    rows = save(rows, "pii-base")
    ids = F.col("doc_id").cast("long").alias("doc_id")
    total, shared = _shared(docs)
    found = rows.filter(F.size("held") > 0)

    def each(df: DataFrame) -> DataFrame:
        return df.select("row", "doc_id", F.explode(F.array_distinct(F.transform("held", lambda x: x["entity"]))).alias("entity"))

    entities = _count(found.select("row", ids, "held"), shared, each, ["entity"], "n_e")
    entities = save(entities.filter(F.col("n_e") >= MIN_TOGETHER), "pii-entities")
    asked = each(found).join(entities, "entity").groupBy("row").agg(F.collect_list("entity").alias("entities"))
    holders = found.select("row", ids, "text", "held").join(asked, "row").select("row", "doc_id", "entities", _covered(F.translate("text", COVER, " "), F.col("held")).alias("text"))
    holders = save(holders.withColumn("words", _words(F.col("text"), FREE)), "pii-holders")
    bad = disclosures(docs, holders, entities, total, shared)
    hits = _pairs(holders).join(bad, ["entity", "term"]).groupBy("row", "term").agg(F.max("ratio").alias("ratio"))
    act = F.when(F.col("ratio") >= REMOVE, "remove").otherwise("generalise")
    hits = hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", act))).alias("acts"))
    marked = holders.select("row", "text").join(hits, "row").withColumn("terms", F.map_keys("acts"))
    places = spans(F.col("text"), F.regexp_extract_all("text", F.lit(FREE), F.lit(0)), FREE, lambda v: F.array_contains(F.col("terms"), F.lower(v)))
    terms = marked.select(F.col("row").alias("_row"), "acts", places.alias("places"))
    terms = terms.select("_row", F.transform("places", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lower(x["v"]).alias("v"), F.element_at("acts", F.lower(x["v"])).alias("act"))).alias("term"))
    out = rows.join(terms, rows["row"] == terms["_row"], "left")
    return out.select("row", "doc_id", *kinds, F.coalesce("term", F.expr("cast(array() as array<struct<s:int,e:int,v:string,act:string>>)")).alias("term"))


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id, a column of spans for each base kind, and term: spans of disclosing words with act generalise or remove.

    Every row is read. Texts with a find are written once, and those that share a value with another document again,
    with their words.
    """
    return _scan(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")).drop("row")


def pii_digest(docs: DataFrame) -> DataFrame:
    kinds = [k for k, *_ in KINDS]
    rows = scan_pii(docs)
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(spans_text([(k, F.col(k)) for k in kinds]), 256).alias("base_sha256"), spans_text([*((k, F.col(k)) for k in kinds), ("term", F.col("term"))]).alias("spans"))


def redact(text: Column, marks: Column) -> Column:
    """text with the spans of marks (array<struct<s,e,with>>) replaced; where spans overlap, the first to start covers the rest."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["with"])
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), piece.alias("out")))

    done = F.aggregate(F.array_sort(marks), start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with text sanitised: base finds become [KIND], disclosing terms [TERM] or nothing. Texts without a find stay.

    Row by row, whatever doc_id says: docs are written once with a number for each row, and only rows with a find move.
    """
    columns, taken = docs.columns, {c.lower() for c in docs.columns}
    row, marks_name = (next(n for n in (f"_{x}", *(f"_{x}{i}" for i in range(len(taken) + 1))) if n not in taken) for x in ("row", "marks"))
    docs = save(docs.withColumn(row, F.monotonically_increasing_id()), "pii-docs")
    found = _scan(docs.select(F.col(row).alias("row"), "doc_id" if "doc_id" in columns else F.lit(None).cast("long").alias("doc_id"), "text"))
    marks = [F.transform(k, bound(lambda x, k: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{k.upper()}]").alias("with")), k)) for k, *_ in KINDS]
    terms = F.transform("term", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["act"] == "remove", "").otherwise("[TERM]").alias("with")))
    found = found.select(F.col("row").alias(row), F.concat(*marks, terms).alias(marks_name)).filter(F.size(marks_name) > 0)
    found = save(found, "pii-marks")
    hit = docs.join(found, row).withColumn("text", redact(F.col("text"), F.col(marks_name)))
    return docs.join(found.select(row), row, "left_anti").select(*columns).unionByName(hit.select(*columns))
