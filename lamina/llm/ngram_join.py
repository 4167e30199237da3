"""Operator 6. N-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds the hashes of its distinct 5-word shingles. Sets R and S with Jaccard similarity of 0.75
or more differ in H = floor((|R| + |S|) / 7) tokens at most. The universe of tokens is hashed into segments, their
number set for each size band [2^k, 2^(k+1)); H differences leave one of any H + 1 segments equal, so a set of
which H + 1 or more segments are not empty meets every partner in an equal, non-empty segment. Allocation:

* empty segments are skipped; each other one is indexed by the hash of its subset. The number of segments of a band
  is the smallest, hence cheapest, with which sets of the band's top size have enough segments that are not empty;
* a set with too few takes one-deletion neighbourhoods too: a segment of two tokens or more then allows one
  difference, so it counts twice. A set that still has too few is indexed by each of its tokens;
* subsets held by more than HOT sets are skipped by all sets that can afford it, those with H + 1 other segments;
  such sets meet their partners there. Only sets that cannot (all but copies of each other) are compared by them, and
  of its hot keys such a set needs just the rarest that bring it to H + 1: of two sets that miss H of each other's
  keys at most, the first H + 1 in any common order share one.

A set is indexed in its own band's scheme, which also serves partners one band up, and in the scheme below if it
can have partners there. Sets that share a key are compared star-wise: with one hub of the key first, and only what
is not yet connected after two hubs goes on, so large groups of near copies cost a comparison each and no link between
components is left out: keys that are not hot then give all their pairs, and the classes that hot keys tie together
are compared by bitmaps in blocks, which gives out only the pairs that may be linked. Each comparison is exact on the sets; before that, sizes and parity bitmaps (a bit for each
token of a set, so the bits in which two differ are no more than the tokens in which the sets do) rule out most pairs.

Texts: a-z for A-Z, words [^ \\x09-\\x0D]+. A null or empty text has an empty set, is linked with nothing and is its
own component. Equal sets are one class. Rows with a null doc_id take part, but never name a component unless the
component has no other id. Repeated rows and ties are classes like others; an empty table gives an empty result;
other columns are not read. Tokens and classes are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _ODD, mix, save, shingles, shuffle_partitions, small_batches, word_hashes, words_of
from .components import components

WORDS = 5
PERCENT = 75
HOT = 40
FLUSH = 750_000
SEEN = 200_000  # classes that a task remembers so as to skip copies
FAMILY_BLOCK = 512
SALTS = 32
BROADCAST_ROWS = 200_000
PLAIN, DEEP, SINGLE = 0, 1, 2  # key spaces
_U = np.uint64


def differences(a: int, b: int) -> int:
    """The most tokens in which sets of a and b tokens can differ and still be linked."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


_SEGMENTS: dict[int, int] = {}  # what segments() has found; a plain dict, so that it travels to workers by value


def segments(band: int) -> int:
    """Segments of a band's scheme; 0: every token is a segment of its own."""
    if band not in _SEGMENTS:
        _SEGMENTS[band] = _fewest(band)
    return _SEGMENTS[band]


def _fewest(band: int) -> int:
    top = 2 ** (band + 1) - 1
    if top < 32:
        return 0
    need = differences(top, top * 100 // PERCENT) + 1
    m = need
    while True:
        load = top / m
        e = math.exp(-load)
        if m * (1 - e) - 2 * math.sqrt(max(0.0, m * e * (1 - (1 + load) * e))) >= need:
            return m
        m += max(1, m // 100)


def schemes(size: int) -> list[tuple[int, int]]:
    """(band, H + 1) of the schemes in which a set is indexed."""
    band = size.bit_length() - 1
    out = [(band, differences(size, size * 100 // PERCENT) + 1)]
    below = 2**band - 1
    if below > 0 and below * 100 >= PERCENT * size:
        out.append((band - 1, differences(size, below) + 1))
    return out


def _tag(keys: np.ndarray, band: int, space: int) -> np.ndarray:
    """Scrambled keys whose lowest 8 bits tell band and space."""
    return (mix(keys + _U(int(_ODD[3]) * (band * 4 + space + 1) % 2**64)) << _U(8)) | _U(band * 4 + space)


def keys_of(tokens: np.ndarray, band: int, need: int) -> tuple[np.ndarray, int]:
    """The keys of a set in a scheme, and how many plain ones it can spare."""
    m = segments(band)
    if m == 0:
        return _tag(tokens, band, PLAIN), len(tokens) - need
    z = mix(tokens ^ _ODD[band % 8])
    seg = z % _U(m)
    order = np.argsort(seg, kind="stable")
    seg, w = seg[order], mix(z[order])
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    sums = np.add.reduceat(w, starts)
    which = seg[starts]
    plain = sums + which * _ODD[1]
    spare = len(starts) - need
    out = [_tag(plain, band, PLAIN)]
    if spare < 0:
        sizes = np.diff(np.r_[starts, len(seg)])
        own = np.repeat(np.arange(len(starts)), sizes)
        rest = (sums[own] - w + which[own] * _ODD[1])[sizes[own] > 1]
        out += [_tag(plain, band, DEEP), _tag(rest, band, DEEP)]
        if len(starts) + int((sizes > 1).sum()) < need:
            out.append(_tag(tokens, band, SINGLE))
    return np.concatenate(out), spare


def tokens_of(text: str | None) -> np.ndarray:
    return shingles(word_hashes(words_of(text)), WORDS)


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


# ---------------------------------------------------------------- passes over the texts


def parity(tokens: np.ndarray) -> np.ndarray:
    """Parity bitmap of 64, 128, ... bits, as many as tokens at least: int64 words; half of them folds onto the other half."""
    words = max(1, 1 << max(0, (len(tokens) - 1).bit_length() - 6))
    at = (mix(tokens + _ODD[6]) & _U(words * 64 - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=words * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        sets = [tokens_of(t) for t in b.column(1).to_pylist()]
        columns = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "bits"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        sets = [tokens_of(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["class", "tokens"])


def _index(parts: int):
    """Rows (part, low, high, row, classes, spare): keys of a part in 48 bits, each with its row in the list of classes."""

    def flush(keys: list, rows: list, classes: list, spares: list) -> pa.RecordBatch:
        k = np.concatenate([*keys, np.empty(0, _U)])
        r = np.repeat(np.array(rows, np.int64), [len(x) for x in keys])
        c, s = np.array(classes, np.int64), np.array(spares, np.uint8)
        part = (k >> _U(32)) % _U(parts)
        order = np.argsort(part.astype(np.uint16 if parts < 65536 else np.uint32), kind="stable")
        k, r, part = k[order], r[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        cols: list[list] = [[] for _ in range(6)]
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a == b:
                continue
            own, at = np.unique(r[a:b], return_inverse=True)
            low = (k[a:b] & _U(0xFFFFFFFF)).astype("<u4")
            high = ((k[a:b] >> _U(32)) & _U(0xFFFF)).astype("<u2")
            small = "<u2" if len(own) < 65536 else "<u4"
            for col, x in zip(cols, (p, low.tobytes(), high.tobytes(), at.astype(small).tobytes(), c[own].tobytes(), s[own].tobytes()), strict=True):
                col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(x, pa.binary()) for x in cols[1:]]], ["part", "low", "high", "row", "classes", "spare"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, classes, spares, held, seen = [], [], [], [], 0, set()
        for b in it:
            for text in b.column(0).to_pylist():
                tokens = tokens_of(text)
                if not len(tokens):
                    continue
                c = class_of(tokens)
                if c in seen:  # a copy in the same task adds nothing
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(c)
                for band, need in schemes(len(tokens)):
                    k, spare = keys_of(tokens, band, need)
                    keys.append(k)
                    rows.append(len(classes))
                    classes.append(c)
                    spares.append(min(max(spare, 0), 255))
                    held += len(k)
                if held >= FLUSH:
                    yield flush(keys, rows, classes, spares)
                    keys, rows, classes, spares, held = [], [], [], [], 0
        if held:
            yield flush(keys, rows, classes, spares)

    return run


def _gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of a part that several classes share: rows (bucket, class, hot, spare, key's band and space, classes of the key).

    Keys with the same few classes give one bucket. Of hot keys all rows are given.
    """
    ks, cs, ss = [], [], []
    for b in it:
        for low, high, row, classes, spare in zip(*[b.column(i).to_pylist() for i in range(1, 6)], strict=True):
            k = np.frombuffer(low, "<u4").astype(_U) | (np.frombuffer(high, "<u2").astype(_U) << _U(32))
            own = np.frombuffer(classes, np.int64)
            at = np.frombuffer(row, "<u2" if len(own) < 65536 else "<u4")
            ks.append(k)
            cs.append(own[at])
            ss.append(np.frombuffer(spare, np.uint8)[at])
    if not ks:
        return
    k, c, s = np.concatenate(ks), np.concatenate(cs), np.concatenate(ss)
    del ks, cs, ss
    order = np.argsort(k)
    k = k[order]
    new = np.r_[True, k[1:] != k[:-1]]
    shared = ~(new & np.r_[new[1:], True])
    order, k = order[shared], k[shared]
    c, s = c[order], s[order]
    order = np.lexsort((c, k))
    k, c, s = k[order], c[order], s[order]
    keep = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.empty(0, bool)  # copies of other tasks
    k, c, s = k[keep], c[keep], s[keep]
    if not len(k):
        return
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    sizes = np.diff(np.r_[starts, len(k)])
    group = np.repeat(np.arange(len(starts)), sizes)
    members = np.add.reduceat(mix(c.view(_U)), starts)
    hot = sizes > HOT
    first = np.zeros(len(starts), bool)
    first[np.unique(members, return_index=True)[1]] = True
    keep = ((sizes > 1) & (first | hot))[group]
    bucket = np.where(hot, mix(k[starts]), mix(members))[group][keep].view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(c[keep]), pa.array(hot[group][keep]), pa.array(s[keep].astype(np.int32)), pa.array((k[keep] & _U(255)).astype(np.int32)), pa.array(sizes[group][keep].astype(np.int64))], ["bucket", "class", "hot", "spare", "scheme", "n"])


# ---------------------------------------------------------------- the join


def _buckets(docs: DataFrame) -> DataFrame:
    """(bucket, class, hot): every pair of linked classes shares a bucket."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    index = docs.select("text").mapInArrow(_index(parts), "part int, low binary, high binary, row binary, classes binary, spare binary")
    shared = index.repartitionById(parts, F.col("part")).mapInArrow(_gather, "bucket long, class long, hot boolean, spare int, scheme int, n long")
    shared = save(shared, "join-shared")
    plain = F.col("scheme") % 4 == PLAIN
    hot = shared.filter("hot")
    # classes that cannot spare their hot keys, by the rarest of these; keys of the other spaces are never skipped
    own = W.partitionBy("class", "scheme")
    rank, held, least = F.row_number().over(own.orderBy("n", "bucket")), F.count(F.lit(1)).over(own), F.min("spare").over(own)
    ranked = hot.filter(plain).select("bucket", "class", "hot", rank.alias("rank"), (held - least).alias("needed"))
    kept = ranked.filter("rank <= needed").select("bucket", "class", "hot").unionByName(hot.filter(~plain).select("bucket", "class", "hot"))
    few = shared.filter("not hot").select("bucket", "class", "hot")
    return save(few.unionByName(kept).distinct(), "join-buckets")


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that sizes and parity bitmaps do not rule out."""
    side = classes.select("class", "n_shingles", "bits")
    right = side.select(F.col("class").alias("b"), F.col("bits").alias("xb"), F.col("n_shingles").alias("nb"))
    left = side.select(F.col("class").alias("a"), F.col("bits").alias("xa"), F.col("n_shingles").alias("na"))
    both = pairs.join(right, "b").join(left, "a").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    longer, shorter = F.when(F.size("xa") >= F.size("xb"), F.col("xa")).otherwise(F.col("xb")), F.when(F.size("xa") >= F.size("xb"), F.col("xb")).otherwise(F.col("xa"))
    both = both.select("a", "b", "na", "nb", longer.alias("x"), shorter.alias("y"))
    half = (F.size("x") / 2).cast("int")
    folded = F.when(F.size("x") > F.size("y"), F.zip_with(F.slice("x", F.lit(1), half), F.slice("x", half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col("x"))
    both = both.withColumn("x", folded)
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, n: acc + n)
    return both.filter(apart * (100 + PERCENT) <= (F.col("na") + F.col("nb")) * (100 - PERCENT)).select("a", "b")


def _sets_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, tokens) of the classes of pairs, from the text of one row each."""
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    chosen = wanted.join(classes, "class").select("first")
    named = chosen.filter("first is not null").distinct()
    side = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    texts = docs.select(F.col("doc_id").alias("first"), "text").join(side, "first", "left_semi").select("text")
    if chosen.filter("first is null").limit(1).count():  # classes that only rows without a doc_id hold
        texts = texts.unionByName(docs.filter("doc_id is null").select("text"))
    return texts.mapInArrow(_sets, "class long, tokens array<long>").join(wanted, "class", "left_semi")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, compared exactly."""
    pairs = save(_possible(pairs, classes), "join-possible")
    sets = save(_sets_of(pairs, classes, docs), "join-sets")
    right = sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb"), F.size("tokens").alias("nb"))
    left = sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta"), F.size("tokens").alias("na"))
    common = F.size(F.array_intersect("ta", "tb"))
    both = pairs.join(right, "b").join(left, "a")
    return both.filter(common * 100 >= (F.col("na") + F.col("nb") - common) * PERCENT).select("a", "b").distinct()


def _cross(buckets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """buckets with comp, only those that hold several components."""
    if comps is None:
        with_comp = buckets.withColumn("comp", F.col("class"))
    else:
        with_comp = buckets.join(comps.select(F.col("node").alias("class"), "component"), "class", "left").select("bucket", "class", "hot", F.coalesce("component", "class").alias("comp"))
    mixed = with_comp.groupBy("bucket", "hot").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo <> _hi").select("bucket", "hot")
    return _salted(with_comp, mixed, ["bucket", "class", "hot", "comp"])


def _salted(rows: DataFrame, by_bucket: DataFrame, columns: list) -> DataFrame:
    """rows joined with the one row of their bucket; the rows of a hot bucket are dealt over SALTS tasks."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_salt", salt).join(by_bucket.withColumn("_salt", salts).drop("hot"), ["bucket", "_salt"]).select(*columns)


def _star_pairs(rows: DataFrame, salt: int) -> DataFrame:
    """Each class of a bucket with the bucket's hub, unless they are connected."""
    order = F.col("class") if salt == 0 else F.xxhash64(F.lit(salt), "class")
    hubs = rows.groupBy("bucket", "hot").agg(F.min_by(F.struct("class", "comp"), order).alias("hub"))
    pairs = _salted(rows, hubs, ["class", "comp", "hub"]).filter(F.col("comp") != F.col("hub.comp"))
    return pairs.select(F.col("hub.class").alias("a"), F.col("class").alias("b")).distinct()


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of one bucket's classes that are not connected. Only for buckets of HOT classes at most."""
    x, y = rows.select("bucket", F.col("class").alias("a"), F.col("comp").alias("ca")), rows.select("bucket", F.col("class").alias("b"), F.col("comp").alias("cb"))
    return x.join(y, "bucket").filter("a < b and ca <> cb").select("a", "b").distinct()


def _near(a: tuple, b: tuple) -> np.ndarray:
    """Which pairs (rows of a, rows of b) sizes and parity bitmaps leave possible. a, b: (bitmaps of one length, sizes)."""
    (xa, na), (xb, nb) = a, b
    if xa.shape[1] > xb.shape[1]:
        xa = xa[:, : xb.shape[1]] ^ xa[:, xb.shape[1] :]
    elif xb.shape[1] > xa.shape[1]:
        xb = xb[:, : xa.shape[1]] ^ xb[:, xa.shape[1] :]
    out = np.zeros((len(xa), len(xb)), bool)
    step = max(1, 2_000_000 // max(1, xb.size))
    for i in range(0, len(xa), step):
        apart = np.bitwise_count(xa[i : i + step, None, :] ^ xb[None, :, :]).sum(axis=2, dtype=np.int64)
        both = na[i : i + step, None] + nb[None, :]
        out[i : i + step] = apart * (100 + PERCENT) <= both * (100 - PERCENT)
    return out


def _compare_blocks(rows: pa.Table) -> pa.Table:
    """Pairs of two blocks of a family (left: rows of the first) that are in different components and may be linked."""
    left, right = [rows.filter(rows.column(c)) for c in ("left", "right")]
    same = rows.column("same")[0].as_py() if rows.num_rows else False
    out_a, out_b = [], []

    def by_length(t: pa.Table) -> dict[int, tuple]:
        got: dict[int, list] = {}
        for i, bits in enumerate(t.column("bits").to_pylist()):
            got.setdefault(len(bits), []).append((i, bits))
        c, n, k = (t.column(x).to_numpy() for x in ("class", "n_shingles", "comp"))
        return {w: (np.array([x for _, x in v], np.int64).view(_U).reshape(len(v), w), n[at], c[at], k[at]) for w, v in got.items() if (at := np.array([i for i, _ in v])) is not None}

    a, b = by_length(left), by_length(right)
    for wa, (xa, na, ca, ka) in a.items():
        for wb, (xb, nb, cb, kb) in b.items():
            if wa in (wb, 2 * wb) or wb == 2 * wa:
                ok = _near((xa, na), (xb, nb)) & (ka[:, None] != kb[None, :])
                if same:
                    ok &= ca[:, None] < cb[None, :]
                i, j = np.nonzero(ok)
                out_a.append(ca[i])
                out_b.append(cb[j])
    none = np.empty(0, np.int64)
    return pa.table({"a": pa.array(np.concatenate([none, *out_a])), "b": pa.array(np.concatenate([none, *out_b]))})


def _family_pairs(mixed: DataFrame, classes: DataFrame) -> DataFrame:
    """Possible pairs among the classes that hot keys tie together. A class goes to one task for each block of its family."""
    hubs = mixed.groupBy("bucket", "hot").agg(F.min("class").alias("a"))
    ties = _salted(mixed, hubs, ["a", "class"]).select("a", F.col("class").alias("b")).filter("a <> b").distinct()
    family = components(ties).select(F.col("node").alias("class"), F.col("component").alias("family"))
    size = family.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    comp = mixed.select("class", "comp").distinct()
    rows = family.join(size, "family").join(comp, "class").join(classes.select("class", "n_shingles", "bits"), "class")
    blocks = F.ceil(F.col("n") / FAMILY_BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    first = F.least("own", "other")
    rows = rows.select("family", first.alias("i"), F.greatest("own", "other").alias("j"), "class", "n_shingles", "bits", "comp", (F.col("own") == first).alias("left"), (F.col("own") == F.greatest("own", "other")).alias("right"), (F.col("own") == F.col("other")).alias("same"))
    return rows.groupBy("family", "i", "j").applyInArrow(_compare_blocks, "a long, b long")


def _named_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, class, ..) of the documents; class, first (its least doc_id) and component of the classes."""
    small_batches(docs.sparkSession)
    rows = save(docs.select("doc_id", "text").mapInArrow(_digests, "doc_id long, n_shingles long, class long, bits array<long>"), "join-docs")
    classes = rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bits").alias("bits"))
    classes = save(classes, "join-classes")
    buckets = _buckets(docs)
    edges = comps = None

    def compare(pairs: DataFrame) -> int:
        nonlocal edges, comps
        found = save(_verify(pairs, classes, docs), "join-links")
        n = found.count()
        edges = found if edges is None else edges.unionByName(found)
        if n:
            comps = save(components(edges), "join-components")
        return n

    few, hot = buckets.filter("not hot"), buckets.filter("hot")
    compare(_star_pairs(_cross(buckets, None), 0))
    compare(_all_pairs(_cross(few, comps)).unionByName(_star_pairs(_cross(hot, comps), 1)).distinct())
    mixed = save(_cross(hot, comps), "join-mixed")
    if mixed.limit(1).count():
        compare(_family_pairs(mixed, classes))
    if comps is None:
        comps = docs.sparkSession.createDataFrame([], "node long, component long")
    comps = comps.select(F.col("node").alias("class"), "component")
    return rows, classes.select("class", "first").join(comps, "class", "left").withColumn("component", F.coalesce("component", "class"))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    rows, named = _named_classes(docs)
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "component").select("class", "component_id")
    out = rows.select("doc_id", "n_shingles", "class").join(ids, "class", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def _marked(class_name: str, words_name: str):
    """Rows with two more columns: the class of their text and whether it has words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [tokens_of(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            more = [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) > 0 for s in sets], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, class_name, words_name])

    return run


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, and every row whose text has no words.

    The row is of the class that holds the component's least doc_id (null if it has none), of several the least class.
    Where no doc_id occurs twice, doc_id alone tells that row; else the classes of the rows are computed again, as rows
    of one doc_id may be of different components.
    """
    rows, named = _named_classes(docs)
    best = named.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "class")).alias("best"))
    keep = save(best.select(F.col("best.first").alias("_id"), F.col("best.class").alias("_class")), "join-keep")
    side = F.broadcast(keep) if keep.count() <= BROADCAST_ROWS else keep
    empty = rows.filter("n_shingles = 0")
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() == 0:
        ids = side.select("_id").unionByName(empty.select(F.col("doc_id").alias("_id")))
        return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    spare = (f"_{x}{i}" for i in range(999) for x in ("class", "words"))
    class_name, words_name = [n for n in spare if n not in docs.columns][:2]
    schema = T.StructType([*docs.schema.fields, T.StructField(class_name, T.LongType()), T.StructField(words_name, T.BooleanType())])
    marked = docs.mapInArrow(_marked(class_name, words_name), schema)
    full = marked.filter(F.col(words_name))
    full = full.join(side, (full[class_name] == side["_class"]) & full["doc_id"].eqNullSafe(side["_id"]), "left_semi")
    full = full.dropDuplicates([class_name])  # the same row twice, or the same words under one doc_id
    return full.unionByName(marked.filter(~F.col(words_name))).select(*docs.columns)
