"""The registered queries of the library and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.functions import paths as P
from lamina.functions import text as X
from lamina.functions import wordlz
from lamina.operators import anchors, blocks, entropy, filededup, filters, lookups, snapshots
from lamina.plans.archive import Archive
from lamina.plans.workspace import new_folder
from lamina.sources.scan import document_items, table
from lamina.streaming.stream import file_stream, packet_stream, stream_copy, stream_restore

B, L, CHUNK = 64, 512, 65536
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# pieces of SQL that several oracles share
DOCS = "docs AS (SELECT doc_id, lang, source, text, encode(text) AS b, CAST(octet_length(encode(text)) AS BIGINT) AS n, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents)"
PAY = DOCS + ", pay AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS payload FROM docs)"
BLK = PAY + f", blk AS (SELECT doc_id, lang, CAST(i AS INTEGER) AS block_no, CAST(payload + i * {B} AS BIGINT) AS off, md5(b[CAST(i * {B} + 1 AS BIGINT):CAST(i * {B} + {B} AS BIGINT)]) AS hash FROM pay, unnest(range(n // {B})) AS t(i))"
MATCH = BLK + f", idx AS (SELECT hash, min(off) AS ref, count(*) AS n FROM blk GROUP BY hash), mat AS (SELECT blk.*, ref FROM blk JOIN idx USING (hash) WHERE ref + {B} < (off // {CHUNK}) * {CHUNK})"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _items(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return document_items(_docs(spark, d), *more)


def _payload(spark: SparkSession, d: str) -> DataFrame:
    return blocks.payload_offsets(_items(spark, d).drop("content"), "doc_id")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.blocks(_items(spark, d), B, offsets=_payload(spark, d))


# ---------------------------------------------------------------- scans and filters


@query(f"WITH {DOCS} SELECT path, doc_id || '.txt' AS name, 'txt' AS ext, n AS size FROM docs")
def scan_items(spark, d):
    return _items(spark, d).select("path", "name", "ext", "size")


@query("WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages) SELECT page_id, regexp_replace(p, '^[^/]*/', '') AS rest FROM p")
def strip_common_parent(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "^[^/]*/", "").alias("rest"))


@query(f"WITH {DOCS} SELECT path FROM docs WHERE source NOT IN ('src0', 'src7') AND NOT (source = 'src3' AND lang = 'en') AND doc_id <> 5")
def filter_exclude_prefix(spark, d):
    out = spark.createDataFrame([("src0",), ("src7",), ("src3/en",)], "path string")
    one = _items(spark, d).filter("doc_id = 5").select("path")
    return filters.exclude(_items(spark, d).select("path"), out.unionByName(one))


@query("SELECT CASE role WHEN 'system' THEN 'dir' WHEN 'user' THEN 'file' ELSE 'symlink' END AS type, count(*) AS n FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY 1")
def filter_type_route(spark, d):
    typed = table(spark, d, "conversations").select(F.when(F.col("role") == "system", "dir").when(F.col("role") == "user", "file").when(F.col("role") == "assistant", "symlink").otherwise("socket").alias("type"))
    return filters.route_types(typed).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DOCS} SELECT path, n AS size FROM docs WHERE n < 2000 AND lang NOT IN ('de', 'es')")
def filter_script_size_ext(spark, d):
    items = filters.predicate_columns(_items(spark, d, "lang").drop("name", "ext"))
    return filters.where(items, "size < 2000 AND NOT lang IN ('de', 'es') AND ext = 'txt'").select("path", "size")


@query("SELECT event_id FROM events WHERE year(ts) = 2024 AND month(ts) IN (1, 2, 6) AND day(ts) <= 15 AND hour(ts) >= 8 OR minute(ts) = 30 AND dayofweek(ts) = 0")
def filter_script_date_parts(spark, d):
    e = table(spark, d, "events").withColumns({"path": F.lit("e"), "size": F.lit(0)})
    return filters.where(filters.predicate_columns(e, time="ts"), "year = 2024 AND month IN (1, 2, 6) AND day <= 15 AND hour >= 8 OR min = 30 AND dow = 0").select("event_id")


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'de')")
def filter_contains(spark, d):
    return _docs(spark, d).filter(X.contains(F.col("lang"), ["fr", "de"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE length(text) % 2 = 0")
def filter_callable(spark, d):
    return filters.where(_docs(spark, d).select("doc_id", "text"), lambda rows: rows["text"].str.len() % 2 == 0).select("doc_id")


# ---------------------------------------------------------------- text functions


@query("SELECT doc_id, length(text) AS len, substring(text, 3, 8) AS sub, right(text, 5) AS tail, reverse(substring(text, 1, 20)) AS rev FROM documents")
def str_utf8_len_sub_reverse(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", X.length(t).cast("long").alias("len"), X.sub(t, 3, 10).alias("sub"), X.sub(t, -5).alias("tail"), X.reverse(X.sub(t, 1, 20)).alias("rev"))


@query("SELECT doc_id, unicode(text) AS first_code, unicode(substring(text, 2, 1)) AS second_code FROM documents")
def str_codepoints(spark, d):
    c, none = X.codepoints(F.col("text"), 1, 2), F.when(F.col("text").isNotNull(), -1)  # -1: the text has no such place
    return _docs(spark, d).select("doc_id", F.coalesce(F.get(c, F.lit(0)), none).alias("first_code"), F.coalesce(F.get(c, F.lit(1)), none).alias("second_code"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CAST(instr(url, '://') AS INTEGER) AS at FROM pages")
def str_find_match(spark, d):
    return table(spark, d, "pages").select("page_id", X.match(F.col("url"), "^https?://([^/]+)").alias("host"), X.find(F.col("url"), "%:%/+").alias("at"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+')) AS INTEGER) AS words FROM documents")
def str_gmatch_count(spark, d):
    return _docs(spark, d).select("doc_id", F.size(X.gmatch(F.col("text"), "%a+")).alias("words"))


@query("SELECT doc_id, md5(regexp_replace(text, '[0-9]', '#', 'g')) AS replaced, CAST(len(regexp_extract_all(text, '[0-9]')) AS INTEGER) AS n FROM documents")
def str_gsub(spark, d):
    out, n = X.gsub(F.col("text"), "%d", "#")
    return _docs(spark, d).select("doc_id", F.md5(out).alias("replaced"), n.alias("n"))


@query("SELECT doc_id, len(text) // 7 AS n, substring(text, 8, 7) AS second FROM documents WHERE len(text) >= 14")
def str_gensub(spark, d):
    p = X.pieces(F.col("text"), 7)
    return _docs(spark, d).filter(F.length("text") >= 14).select("doc_id", F.size(p).cast("long").alias("n"), p[1].alias("second"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(f"SELECT doc_id, md5(translate(text, '{_UP}', '{_LOW}')) AS low, md5(translate(text, '{_LOW}', '{_UP}')) AS up, md5(text || '-' || text) AS twice FROM documents")
def str_case_rep(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.md5(X.lower(t)).alias("low"), F.md5(X.upper(t)).alias("up"), F.md5(X.repeat(t, 2, "-")).alias("twice"))


@query("SELECT doc_id, printf('%07d|%-4s|%x', doc_id, lang, doc_id) AS line FROM documents")
def str_format(spark, d):
    return _docs(spark, d).select("doc_id", X.formatted("%07d|%-4s|%x", F.col("doc_id"), F.col("lang"), F.col("doc_id")).alias("line"))


@query("WITH f AS (SELECT doc_id, text, regexp_extract(text, '[0-9]+') AS m FROM documents) SELECT doc_id, CAST(instr(text, m) AS INTEGER) AS first, CAST(instr(text, m) + length(m) - 1 AS INTEGER) AS last FROM f WHERE m <> ''")
def str_find_span(spark, d):
    span = X.find_span(F.col("text"), "%d+")
    return _docs(spark, d).select("doc_id", span.alias("s")).filter("s is not null").select("doc_id", F.col("s.start").alias("first"), F.col("s.end").alias("last"))


@query("SELECT page_id, regexp_replace(url, '[<>:\"|?*]', chr(65533), 'g') AS clean FROM pages")
def invalid_char_replace(spark, d):
    return table(spark, d, "pages").select("page_id", X.valid_chars(X.printable(F.col("url"))).alias("clean"))


_H = "n * 100 // {u}"
_SIZE = " ".join(f"WHEN n >= {1000 * 1024 ** (p - 1)} THEN (CASE WHEN n // {1024**p} >= 100 THEN CAST(n // {1024**p} AS VARCHAR) WHEN n // {1024**p} >= 10 THEN CAST(n // {1024**p} AS VARCHAR) || '.' || substring(lpad(CAST(n * 100 // {1024**p} % 100 AS VARCHAR), 2, '0'), 1, 1) ELSE CAST(n // {1024**p} AS VARCHAR) || '.' || lpad(CAST(n * 100 // {1024**p} % 100 AS VARCHAR), 2, '0') END) || ' {u}'" for p, u in ((3, "G"), (2, "M"), (1, "K")))


@query(f"WITH s AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) * (doc_id % 4096 + 1) AS n FROM documents) SELECT doc_id, CASE {_SIZE} ELSE CAST(n AS VARCHAR) || ' ' END AS human, lpad(format('{{:,}}', n), 15, ' ') AS padded FROM s")
def human_size(spark, d):
    n = F.octet_length(F.encode("text", "UTF-8")).cast("long") * (F.col("doc_id") % 4096 + 1)
    return _docs(spark, d).select("doc_id", X.human_size(n).alias("human"), X.thousands(n, 15).alias("padded"))


# ---------------------------------------------------------------- whole-item dedup


@query(f"WITH {DOCS}, h AS (SELECT doc_id, n AS size, md5(b) AS hash FROM docs) SELECT doc_id, size, hash, min(doc_id) OVER (PARTITION BY hash, size) AS canonical, doc_id <> min(doc_id) OVER (PARTITION BY hash, size) AS is_duplicate FROM h")
def file_dedup_exact(spark, d):
    return filededup.exact(_items(spark, d))


@query(f"WITH {DOCS} SELECT doc_id, n AS size, min(doc_id) OVER (PARTITION BY md5(b), n) AS canonical FROM docs")
def file_dedup_progressive(spark, d):
    return filededup.progressive(_items(spark, d))


@query(f"WITH {DOCS}, m AS (SELECT *, doc_id <> min(doc_id) OVER (PARTITION BY md5(b), n) AS dup FROM docs) SELECT source, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes, count(*) FILTER (dup) AS duplicate_files, CAST(coalesce(sum(n) FILTER (dup), 0) AS BIGINT) AS duplicate_bytes FROM m GROUP BY source")
def file_dedup_savings(spark, d):
    return filededup.savings(_items(spark, d, "source"), "source")


@query("SELECT l_partkey, l_suppkey, min(l_orderkey * 8 + l_linenumber) AS owner, count(*) AS members FROM lineitem GROUP BY 1, 2")
def hardlink_groups(spark, d):
    rows = table(spark, d, "lineitem").withColumn("ord", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return filededup.hard_links(rows, "l_partkey", "l_suppkey", ["ord"]).select("l_partkey", "l_suppkey", F.col("owner.ord").alias("owner"), "members")


@query("WITH s AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), o AS (SELECT o_custkey AS g, min(CASE WHEN o_orderkey = own THEN o_orderkey END) AS a, min(o_orderkey) AS b FROM s JOIN (SELECT o_custkey AS c, min(o_orderkey) AS own FROM orders GROUP BY 1) ON c = o_custkey GROUP BY 1) SELECT o_orderkey, coalesce(a, b) AS restored_owner FROM s JOIN o ON g = o_custkey")
def hardlink_relink(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    owned = o.join(o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("own")), "o_custkey").filter("o_orderkey % 3 <> 0")
    return filededup.relink(owned, "o_orderkey", "o_custkey", "own").select("o_orderkey", "restored_owner")


# ---------------------------------------------------------------- snapshots

_BEFORE = "a AS (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderkey % 10 <> 1), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS o_orderdate, o_totalprice FROM orders WHERE o_orderkey % 10 <> 2)"


def _two_sets(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    later = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate") + F.expr("interval 1 day")).otherwise(F.col("o_orderdate"))
    return o.filter("o_orderkey % 10 <> 1"), o.filter("o_orderkey % 10 <> 2").withColumn("o_orderdate", later)


@query(f"WITH {_BEFORE} SELECT b.o_orderkey FROM b JOIN a USING (o_orderkey, o_orderdate, o_totalprice)")
def snapshot_unchanged(spark, d):
    before, now = _two_sets(spark, d)
    return snapshots.unchanged(now, before, ["o_orderkey", "o_orderdate", "o_totalprice"]).select("o_orderkey")


@query(f"WITH {_BEFORE} SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'deleted' WHEN a.o_orderdate = b.o_orderdate AND a.o_totalprice = b.o_totalprice THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def snapshot_changed_new_deleted(spark, d):
    before, now = _two_sets(spark, d)
    return snapshots.status(now, before, "o_orderkey", ["o_orderdate", "o_totalprice"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_version(spark, d):
    return snapshots.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("WITH s AS (SELECT CAST(ts AS DATE) AS day, count(*) AS files, CAST(sum(octet_length(encode(props))) AS BIGINT) AS size FROM events GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS set_no, day, files, size, size - lag(size) OVER (ORDER BY day) AS size_change FROM s")
def snapshot_list(spark, d):
    s = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("props")).cast("long").alias("size"))
    w = W.orderBy("day")  # one row for each snapshot
    return s.select(F.row_number().over(w).alias("set_no"), "day", "files", "size", (F.col("size") - F.lag("size").over(w)).alias("size_change"))


@query("WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), n AS (SELECT day, row_number() OVER (ORDER BY day) AS set_no FROM s) SELECT event_id, event_type FROM events JOIN n ON CAST(ts AS DATE) = day WHERE set_no = 3")
def snapshot_contents(spark, d):
    e = table(spark, d, "events")
    days = e.select(F.to_date("ts").alias("day")).distinct().withColumn("set_no", F.row_number().over(W.orderBy("day")))
    return e.withColumn("day", F.to_date("ts")).join(days.filter("set_no = 3"), "day").select("event_id", "event_type")


# ---------------------------------------------------------------- payload space and blocks


@query(f"WITH {PAY} SELECT doc_id, n AS size, payload FROM pay")
def payload_offsets(spark, d):
    return _payload(spark, d).select("doc_id", "size", "payload")


@query(f"WITH {PAY} SELECT doc_id, payload // {CHUNK} AS first_chunk, (payload + greatest(n - 1, 0)) // {CHUNK} AS last_chunk, payload // {CHUNK} <> (payload + greatest(n - 1, 0)) // {CHUNK} AS straddles FROM pay")
def chunk_assignment(spark, d):
    return blocks.chunk_assignment(_payload(spark, d), CHUNK).select("doc_id", "first_chunk", "last_chunk", "straddles")


@query("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS current FROM conversations")
def dir_forward_fill(spark, d):
    c = table(spark, d, "conversations").withColumn("dir", F.when(F.col("role") == "user", F.col("text")))
    return lookups.forward_fill(c, ["conv_id"], "turn", "dir", "current").select("conv_id", "turn", "role", "current")


@query("SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def changes_only(spark, d):
    return lookups.changes_only(table(spark, d, "events"), ["user_id"], "event_id", "event_type").select("user_id", "event_id")


@query(f"WITH {BLK} SELECT hash, min(off) AS min_offset, count(*) AS n FROM blk GROUP BY hash")
def block_index_small(spark, d):
    return blocks.block_index(_blocks(spark, d))


@query(f"WITH {BLK} SELECT doc_id, CAST(block_no // {L // B} AS INTEGER) AS large_no, min(off) AS \"offset\", md5(string_agg(hash, '' ORDER BY block_no)) AS hash FROM blk GROUP BY 1, 2 HAVING count(*) = {L // B}")
def block_index_large(spark, d):
    return blocks.large_blocks(_blocks(spark, d), L // B)


@query(f"WITH {MATCH} SELECT doc_id, block_no, off AS \"offset\", ref FROM mat")
def block_matches_prior_chunk(spark, d):
    return blocks.prior_matches(_blocks(spark, d), B, CHUNK).select("doc_id", "block_no", "offset", "ref")


@query(f"WITH {MATCH}, g AS (SELECT *, off - row_number() OVER (PARTITION BY doc_id ORDER BY off) * {B} AS island FROM mat) SELECT doc_id, min(off) AS \"offset\", min(ref) AS ref, count(*) * {B} AS length FROM g GROUP BY doc_id, island, ref - off")
def block_match_runs(spark, d):
    return blocks.match_runs(blocks.prior_matches(_blocks(spark, d), B, CHUNK), B)


@query(f"WITH {MATCH}, m AS (SELECT doc_id, count(*) * {B} AS matched FROM mat GROUP BY 1) SELECT lang, CAST(sum(n) AS BIGINT) AS bytes, CAST(coalesce(sum(matched), 0) AS BIGINT) AS matched_bytes, CAST(sum(n) - coalesce(sum(matched), 0) AS BIGINT) AS literal_bytes FROM docs LEFT JOIN m USING (doc_id) GROUP BY lang")
def block_dedup_ratio(spark, d):
    m = blocks.prior_matches(_blocks(spark, d), B, CHUNK).groupBy("doc_id").agg((F.count(F.lit(1)) * B).alias("matched"))
    all_ = _items(spark, d, "lang").select("doc_id", "lang", "size").join(m, "doc_id", "left")
    matched = F.coalesce(F.sum("matched"), F.lit(0))
    return all_.groupBy("lang").agg(F.sum("size").alias("bytes"), matched.alias("matched_bytes"), (F.sum("size") - matched).alias("literal_bytes"))


@query(f"WITH {DOCS}, pg AS (SELECT page_id, encode(html) AS b FROM pages), x AS (SELECT md5(b[CAST(i * {B} + 1 AS BIGINT):CAST(i * {B} + {B} AS BIGINT)]) AS hash, count(*) AS n_a FROM pg, unnest(range(octet_length(b) // {B})) AS t(i) GROUP BY 1), y AS (SELECT md5(b[CAST(i * {B} + 1 AS BIGINT):CAST(i * {B} + {B} AS BIGINT)]) AS hash, count(*) AS n_b FROM docs, unnest(range(n // {B})) AS t(i) GROUP BY 1) SELECT hash, n_a, n_b FROM x JOIN y USING (hash)")
def cross_archive_aligned(spark, d):
    html = F.encode("html", "UTF-8")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), html.alias("content"), F.octet_length(html).cast("long").alias("size"), F.lit(0).cast("long").alias("payload"))
    return blocks.shared_blocks(blocks.blocks(pages, B), _blocks(spark, d))


@query(f"WITH {DOCS}, bb AS (SELECT item_id, CAST(i AS INTEGER) AS block_no, encode(text)[CAST(i * {B} + 1 AS BIGINT):CAST(i * {B} + {B} AS BIGINT)] AS bytes FROM benchmark, unnest(range(octet_length(encode(text)) // {B})) AS t(i)), pos AS (SELECT doc_id, CAST(p AS INTEGER) AS position, b[CAST(p + 1 AS BIGINT):CAST(p + {B} AS BIGINT)] AS bytes FROM docs, unnest(range(n - {B - 1})) AS t(p)) SELECT doc_id, position, item_id, block_no FROM pos JOIN bb USING (bytes)")
def sliding_block_match(spark, d):
    bench = table(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("content"))
    return anchors.sliding_matches(bench, _items(spark, d), B, "item_id", "doc_id")


@query(f"WITH {BLK}, n AS (SELECT CAST('0x' || substring(hash, 1, 8) AS BIGINT) % 4096 AS bucket, count(DISTINCT hash) AS n FROM blk GROUP BY 1) SELECT count(*) AS buckets, count(*) FILTER (n > 8) AS overfull, round(avg(CASE WHEN n > 8 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM n")
def index_fill_ratio(spark, d):
    return blocks.fill_ratio(_blocks(spark, d), 4096)


# ---------------------------------------------------------------- entropy

_NIB = " + ".join(f"CASE WHEN strpos(h, '{c}') > 0 THEN -((length(h) - length(replace(h, '{c}', ''))) / length(h)) * log2((length(h) - length(replace(h, '{c}', ''))) / length(h)) ELSE 0 END" for c in "0123456789ABCDEF")


@query(f"WITH {DOCS}, x AS (SELECT doc_id, regexp_replace(upper(hex(b)), '(.).', '\\1', 'g') AS h FROM docs) SELECT doc_id, round({_NIB}, 6) AS entropy FROM x")
def entropy_nibble(spark, d):
    return _items(spark, d).select("doc_id", F.round(entropy.nibble_entropy(F.col("content")), 6).alias("entropy"))


@query(f"WITH p AS (SELECT page_id, encode(html) AS b, octet_length(encode(html)) AS n FROM pages), w AS (SELECT page_id, n, i, regexp_replace(upper(hex(b[CAST(((n - 512) // 8) * i + 257 AS BIGINT):CAST(((n - 512) // 8) * i + 512 AS BIGINT)])), '(.).', '\\1', 'g') AS h FROM p, unnest(range(8)) AS t(i)), e AS (SELECT page_id, n, CASE WHEN n < 1024 THEN 0 ELSE {_NIB} END AS e FROM w) SELECT page_id, bool_or(n < 1024 OR e < 2.4) AS compressible FROM e GROUP BY 1")
def entropy_sampled_policy(spark, d):
    out = entropy.compressible(F.encode("html", "UTF-8"), 1024, 256, limit=2.4)  # text never reaches the library's limit
    return table(spark, d, "pages").select("page_id", out.alias("compressible"))


@query("SELECT page_id, regexp_matches(regexp_replace(url, '[?#].*$', ''), '\\.(jpg|mp4|mpeg|wmv|jpeg|png|avi|mov|flv|aac|ogg|mp3|webp|mkv|html)$') AS stored FROM pages")
def entropy_extension_policy(spark, d):
    path = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", filters.high_entropy_name(path, ("html",)).alias("stored"))


@query("WITH g AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) SELECT user_id, event_type, min(event_id) AS run_start, max(event_id) AS run_end, count(*) AS run_length FROM g GROUP BY user_id, event_type, g")
def zero_runs(spark, d):
    return blocks.zero_runs(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query(f"WITH {DOCS}, w AS (SELECT doc_id, i, list_transform(range(8), lambda j: CAST('0x' || substring(hex(b[CAST(i * 8 + 1 AS BIGINT):CAST(i * 8 + 8 AS BIGINT)]), 2 * j + 1, 2) AS HUGEINT) * CAST(256 ** j AS HUGEINT)) AS y FROM docs, unnest(range(n // 8)) AS t(i)), v AS (SELECT doc_id, i, CAST(y[1] + y[2] + y[3] + y[4] + y[5] + y[6] + y[7] + y[8] AS HUGEINT) AS w FROM w), h AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id, ((w * {wordlz.MULTIPLIER}) % {2**64}) // {2**48} ORDER BY i) AS before FROM v), c AS (SELECT doc_id, count(*) AS words, count(*) FILTER (before = w) AS hits FROM h GROUP BY 1) SELECT docs.doc_id AS doc_id, coalesce(words, 0) AS words, coalesce(hits, 0) AS hits FROM docs LEFT JOIN c ON c.doc_id = docs.doc_id")
def word_lz_hits(spark, d):
    """Words that the word codec writes as the hash of the last one like it."""
    return _items(spark, d).select("doc_id", wordlz.hit_counts(F.col("content")).alias("c")).select("doc_id", "c.words", "c.hits")


# ---------------------------------------------------------------- lookups


def _points(spark, d):
    return _docs(spark, d).select((F.col("doc_id") * 1777).alias("place"))


@query(f"WITH {PAY}, pts AS (SELECT doc_id * 1777 AS place FROM documents) SELECT place, doc_id FROM pts JOIN pay ON place >= payload AND place < payload + n")
def range_lookup_chunk(spark, d):
    ranges = _payload(spark, d).select("doc_id", "payload", "size")
    return lookups.containing(_points(spark, d), ranges, "place", "payload", "size", CHUNK).select("place", "doc_id")


@query(f"WITH {PAY}, pts AS (SELECT doc_id * 1777 AS place FROM documents), big AS (SELECT * FROM pay WHERE n > 0) SELECT place, big.doc_id AS doc_id FROM pts ASOF LEFT JOIN big ON place >= payload")
def asof_lookup_file(spark, d):
    marks = _payload(spark, d).filter("size > 0").select("payload", "doc_id")
    return lookups.as_of(_points(spark, d), marks, "place", "payload", "doc_id").select("place", "doc_id")


@query("WITH RECURSIVE l AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey - 1 END AS ref FROM customer WHERE c_custkey >= 1), r AS (SELECT node, node AS root FROM l WHERE ref IS NULL OR ref NOT IN (SELECT node FROM l) UNION ALL SELECT l.node, r.root FROM l JOIN r ON l.ref = r.node) SELECT node, root FROM r")
def resolve_references(spark, d):
    c = table(spark, d, "customer").filter("c_custkey >= 1").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") - 1).alias("ref"))
    present = c.join(c.select(F.col("node").alias("ref")), "ref", "left_semi").select("node", "ref")
    roots = c.join(present.select("node"), "node", "left_anti").select("node", F.lit(None).cast("long").alias("ref"))
    return lookups.resolve_roots(present.unionByName(roots.select("node", F.col("ref").cast(present.schema["ref"].dataType))))


# ---------------------------------------------------------------- archive


def _archive_items(spark, d):
    return _items(spark, d).select("path", "size", F.lit(datetime(2024, 1, 1)).alias("mtime"), "content")


def _archive(spark, d) -> Archive:
    a = Archive(spark, new_folder(spark, "archive"), block=1024)
    a.backup(_archive_items(spark, d), datetime(2024, 1, 1), ["documents"])
    return a


@query(f"WITH {DOCS} SELECT path, n AS size, md5(b) AS hash FROM docs")
def restore_roundtrip(spark, d):
    return _archive(spark, d).restore(1).select("path", "size", F.md5("content").alias("hash"))


@query(f"WITH {DOCS} SELECT path, n AS size, md5(b) AS hash FROM docs WHERE source = 'src1' OR (source = 'src2' AND lang = 'fr')")
def restore_selected_paths(spark, d):
    wanted = _archive_items(spark, d).select(F.regexp_extract("path", r"^(src1|src2/fr)/", 1).alias("path")).filter("path <> ''").distinct()
    return _archive(spark, d).restore(1, wanted).select("path", "size", F.md5("content").alias("hash"))


@query(f"WITH {DOCS}, f AS (SELECT *, doc_id % 5 = 0 AS touched FROM docs) SELECT CAST(1 AS INTEGER) AS set_no, count(*) AS files, count(*) AS added_files, CAST(0 AS BIGINT) AS unchanged_files FROM f UNION ALL SELECT 2, count(*) FILTER (doc_id % 7 <> 0), count(*) FILTER (touched AND doc_id % 7 <> 0), count(*) FILTER (NOT touched AND doc_id % 7 <> 0) FROM f")
def archive_incremental(spark, d):
    a = _archive(spark, d)
    items = _items(spark, d).filter("doc_id % 7 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 5 == 0, F.lit(datetime(2024, 2, 1))).otherwise(F.lit(datetime(2024, 1, 1))))
    a.backup(items.select("path", "size", "mtime", "content"), datetime(2024, 2, 2), ["documents"])
    return a.snapshots().select("set_no", "files", "added_files", "unchanged_files")


@query(f"WITH {DOCS}, m AS (SELECT *, doc_id <> min(doc_id) OVER (PARTITION BY md5(b), n) AS dup FROM docs), u AS (SELECT DISTINCT md5(b[CAST(i * 1024 + 1 AS BIGINT):CAST(least(i * 1024 + 1024, n) AS BIGINT)]) AS hash, least(1024, n - i * 1024) AS len FROM docs, unnest(range((n + 1023) // 1024)) AS t(i)) SELECT 1 AS sets, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS unchanged_files, CAST(count(*) FILTER (dup) AS BIGINT) AS duplicate_files, CAST((SELECT sum(len) FROM u) AS BIGINT) AS stored_bytes FROM m")
def stats_report(spark, d):
    return _archive(spark, d).statistics()


# ---------------------------------------------------------------- anchors

_ANCH = "blk AS (SELECT doc_id, CAST(i AS INTEGER) AS block_no, b[CAST(i * 256 + 1 AS BIGINT):CAST(i * 256 + 256 AS BIGINT)] AS x FROM docs, unnest(range(n // 256)) AS t(i)), byt AS (SELECT doc_id, block_no, list_transform(range(256), lambda j: CAST('0x' || substring(h, 2 * j + 1, 2) AS BIGINT)) AS y FROM (SELECT doc_id, block_no, hex(x) AS h FROM blk)), pos AS (SELECT doc_id, block_no, p, (y[p + 1] + 256 * y[p + 2] + y[p + 96] + 256 * y[p + 97]) AS s FROM byt, unnest(range(128)) AS t(p)), sq AS (SELECT doc_id, block_no, p, (s * s) % 65536 AS q FROM pos), hit AS (SELECT doc_id, block_no, min(p) AS a FROM sq WHERE q < 32768 AND q > 32511 GROUP BY 1, 2)"


@query(f"WITH {DOCS}, {_ANCH} SELECT doc_id, block_no, CAST(a AS INTEGER) AS anchor FROM blk LEFT JOIN hit USING (doc_id, block_no)")
def anchor_positions(spark, d):
    return anchors.anchors(_items(spark, d), 256).select("doc_id", "block_no", "anchor")


def _word64(at: str) -> str:
    """SQL of the little-endian 64-bit word at a place (0-based) of the bytes y."""
    return "(" + " + ".join(f"CAST(y[({at}) + {i + 1}] AS HUGEINT) * {256**i}" for i in range(8)) + ")"


_SUM = "(" + " + ".join(_word64(f"a + {p}") for p in (0, 39, 78, 109)) + f") % {2**64}"


@query(f"WITH {DOCS}, {_ANCH}, t AS (SELECT {_SUM} AS s FROM byt JOIN hit USING (doc_id, block_no)), f AS (SELECT CAST((s % {2**32} + s // {2**32}) % {2**32} + 1 AS BIGINT) AS fingerprint FROM t) SELECT fingerprint, count(*) AS n FROM f GROUP BY 1")
def anchor_fingerprint(spark, d):
    return anchors.anchors(_items(spark, d), 256).filter("anchor is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


A = 128
_NEEDLES = f"bb AS (SELECT item_id, CAST(i AS INTEGER) AS block_no, encode(text)[CAST(i * {A} + 1 AS BIGINT):CAST(i * {A} + {A} AS BIGINT)] AS bytes FROM benchmark, unnest(range(octet_length(encode(text)) // {A})) AS t(i)), by_ AS (SELECT item_id, block_no, bytes, list_transform(range({A}), lambda j: CAST('0x' || substring(hex(bytes), 2 * j + 1, 2) AS BIGINT)) AS y FROM bb), sq AS (SELECT item_id, block_no, bytes, ((y[p + 1] + 256 * y[p + 2] + y[p + 32] + 256 * y[p + 33]) * (y[p + 1] + 256 * y[p + 2] + y[p + 32] + 256 * y[p + 33])) % 65536 AS q FROM by_, unnest(range(64)) AS t(p)), ok AS (SELECT DISTINCT item_id, block_no, bytes FROM sq WHERE q < 32768 AND q > 32511)"


@query(f"WITH {DOCS}, {_NEEDLES}, pos AS (SELECT doc_id, p AS position, b[CAST(p + 1 AS BIGINT):CAST(p + {A} AS BIGINT)] AS bytes FROM docs, unnest(range(n - {A - 1})) AS t(p)) SELECT doc_id, position, item_id, block_no FROM pos JOIN ok USING (bytes)")
def anchored_block_match(spark, d):
    bench = table(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("content"))
    return anchors.anchored_matches(anchors.anchored_blocks(bench, A, ("item_id",)), _items(spark, d), A, "doc_id").select("doc_id", "position", "item_id", "block_no")


@query(f"WITH {PAY}, blk AS (SELECT doc_id, CAST(i AS INTEGER) AS block_no, b[CAST(i * 256 + 1 AS BIGINT):CAST(i * 256 + 256 AS BIGINT)] AS x, payload + i * 256 AS off FROM pay, unnest(range(n // 256)) AS t(i)), byt AS (SELECT doc_id, block_no, list_transform(range(256), lambda j: CAST('0x' || substring(h, 2 * j + 1, 2) AS BIGINT)) AS y FROM (SELECT doc_id, block_no, hex(x) AS h FROM blk)), sq AS (SELECT doc_id, block_no, ((y[p + 1] + 256 * y[p + 2] + y[p + 96] + 256 * y[p + 97]) * (y[p + 1] + 256 * y[p + 2] + y[p + 96] + 256 * y[p + 97])) % 65536 AS q FROM byt, unnest(range(128)) AS t(p)), ok AS (SELECT DISTINCT doc_id, block_no FROM sq WHERE q < 32768 AND q > 32511), idx AS (SELECT x, CAST(min(off) AS BIGINT) AS ref FROM blk JOIN ok USING (doc_id, block_no) GROUP BY x), pos AS (SELECT doc_id, CAST(payload + p AS BIGINT) AS off, b[CAST(p + 1 AS BIGINT):CAST(p + 256 AS BIGINT)] AS x FROM pay, unnest(range(n - 255)) AS t(p)) SELECT doc_id AS chunk, off AS \"offset\", CAST(256 AS BIGINT) AS length, ref FROM pos JOIN idx USING (x) WHERE ref + 256 < (off // {CHUNK}) * {CHUNK}")
def anchored_self_matches(spark, d):
    return anchors.self_matches(*_chunks(spark, d), 256, CHUNK)


@query()
def anchor_dedup_cover(spark, d):
    contents, offsets = _chunks(spark, d)
    return anchors.cover_chunks(offsets, anchors.self_matches(contents, offsets, 256, CHUNK))


def _chunks(spark, d):
    items = _items(spark, d).withColumnRenamed("doc_id", "chunk")
    return items.select("chunk", "content"), _payload(spark, d).select(F.col("doc_id").alias("chunk"), "payload", "size")


# ---------------------------------------------------------------- streams


@query(f"WITH {DOCS} SELECT path, n AS size, md5(b) AS hash FROM docs")
def stream_archive_restore(spark, d):
    """An archive written out as packets, and restored from them in one pass of a stream."""
    folder = new_folder(spark, "packets")
    packet_stream(_archive(spark, d), 1).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    return stream_restore(file_stream(spark, folder, "*.parquet", schema, per_batch=4), spark).select("path", "size", F.md5("content").alias("hash"))


@query("WITH d AS (SELECT DISTINCT source, lang FROM documents) SELECT 'file' AS type, count(*) AS n FROM documents UNION ALL SELECT 'dir', count(*) FROM d UNION ALL SELECT 'symlink', count(*) FROM d")
def archive_item_types(spark, d):
    """Files with their directories and a link beside each directory, through a backup."""
    files = _items(spark, d, "source", "lang").withColumn("type", F.lit("file"))
    dirs = files.select(F.concat_ws("/", "source", "lang").alias("path")).distinct().withColumn("type", F.lit("dir"))
    links = dirs.select(F.concat(F.col("path"), F.lit(".link")).alias("path"), F.lit("symlink").alias("type"), F.col("path").alias("link"))
    rows = files.select("path", "type", "size", "content").unionByName(dirs, allowMissingColumns=True).unionByName(links, allowMissingColumns=True)
    rows = rows.withColumn("size", F.coalesce("size", F.lit(0))).withColumn("mtime", F.lit(datetime(2024, 1, 1)))
    a = Archive(spark, new_folder(spark, "archive"), block=1024)
    a.backup(rows, datetime(2024, 1, 1), ["documents"])
    return a.contents(1).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DOCS}, u AS (SELECT DISTINCT md5(b[CAST(i * 1024 + 1 AS BIGINT):CAST(least(i * 1024 + 1024, n) AS BIGINT)]) AS hash, least(1024, n - i * 1024) AS len FROM docs, unnest(range((n + 1023) // 1024)) AS t(i)), c AS (SELECT CAST(CAST('0x' || substring(hash, 1, 2) AS BIGINT) AS INTEGER) AS chunk_id, CAST(sum(len) AS BIGINT) AS payload_length FROM u GROUP BY 1) SELECT chunk_id, payload_length, CAST(coalesce(sum(payload_length) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS payload FROM c")
def archive_chunks(spark, d):
    return _archive(spark, d).chunks().select("chunk_id", "payload_length", "payload")


@query(f"WITH {DOCS}, u AS (SELECT DISTINCT md5(b[CAST(i * 1024 + 1 AS BIGINT):CAST(least(i * 1024 + 1024, n) AS BIGINT)]) AS hash, CAST(least(1024, n - i * 1024) AS INTEGER) AS length FROM docs, unnest(range((n + 1023) // 1024)) AS t(i)) SELECT hash, length, CAST(coalesce(sum(length) OVER (ORDER BY substring(hash, 1, 2), hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS payload FROM u")
def archive_block_index(spark, d):
    return _archive(spark, d).index().select("hash", "length", "payload")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_restore_equivalence(spark, d):
    schema = table(spark, d, "events").schema
    back = stream_copy(file_stream(spark, d, "events.parquet", schema), spark)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def common_parent(spark: SparkSession, paths: list[str]) -> str:
    return P.common_parent(spark.createDataFrame([(p,) for p in paths], "path string"), "path").first()[0]
