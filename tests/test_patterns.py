import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import patterns as P
from lamina.functions import text as X
from lamina.operators import anchors, blocks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_matcher_equals_regexes():
    r = random.Random(2)
    for pattern in ("%a+", "^%w-x", "(%d+)%s*=%s*(%w*)", "[^%s,]+$", "a?b*c+", "(a.)%1", "[a-c%d]-z", "%u%l*"):
        for _ in range(150):
            s = "".join(r.choice("aabbcxyz09 =,Z") for _ in range(r.randrange(14)))
            want = re.search(X.to_regex(pattern).replace(r"\z", r"\Z"), s)
            got = P.Pattern(pattern).find(s)
            assert (None if want is None else (want.start() + 1, want.end(), list(want.groups()))) == got, (pattern, s)


def test_what_regexes_lack(spark):
    assert P.Pattern("%b()").find("f(a(b)c)d)") == (2, 8, [])
    assert P.Pattern("()ll()").find("hello") == (3, 4, ["3", "5"])
    assert P.Pattern("l+").find("hello", -2) == (4, 4, [])
    assert P.Pattern("o").find("hello", 99) is None
    for bad in ("(a", "a)", "%", "[a", "%f[a]", "%b("):
        with pytest.raises(ValueError):
            P.Pattern(bad)
    assert [c for _, _, c in P.Pattern("^a", anchored=False).all("^a b^a")] == [["^a"], ["^a"]]
    t = F.lit("x=1, y=22")
    assert one(spark, P.gmatch(t, "(%w)=(%d+)")) == [["x", "1"], ["y", "22"]]
    assert tuple(one(spark, P.find(t, "%d%d()"))) == (8, 9, ["10"])
    assert one(spark, P.find(t, "q")) is None
    assert tuple(one(spark, P.gsub(t, "%d+", "<%0>", 1))) == ("x=<1>, y=22", 1)
    assert tuple(one(spark, P.gsub(t, "%w+", {"x": "a", "22": "b"}))) == ("a=, =b", 4)
    assert tuple(one(spark, P.gsub(t, "(%w)=(%d+)", lambda k, v: k * len(v) if k == "y" else None))) == (", yy", 2)


def test_string_functions(spark):
    t = F.lit("aÄbC")
    assert [one(spark, f(t)) for f in (X.lower, X.upper)] == ["aÄbc", "AÄBC"]
    assert [one(spark, X.repeat(F.lit("ab"), n, "-")) for n in (0, 1, 3)] == ["", "ab", "ab-ab-ab"]
    assert one(spark, X.formatted("%5.2f|%-4d|%s|%x|%%", F.lit(3.14159), F.lit(7), F.lit("q"), F.lit(255))) == " 3.14|7   |q|ff|%"
    assert one(spark, X.formatted("%q", F.lit('a"b\\'))) == '"a\\"b\\\\"'
    for bad in ("%", "%d %d", "%y"):
        with pytest.raises(ValueError):
            X.formatted(bad, F.lit(1))
    s = F.lit("key = value; k2 = v2")
    assert one(spark, X.matches(s, "(%w+) = (%w+)")) == ["key", "value"] and one(spark, X.matches(s, "(%w+) = (%w+)", 6)) == ["k2", "v2"]
    assert tuple(one(spark, X.find_span(s, "(%w+) =", 4))) == (14, 17, ["k2"]) and one(spark, X.find_span(s, "%^")) is None
    assert [tuple(x) for x in one(spark, X.gensub_spans(F.lit("añb€c"), 2))] == [("añ", 1, 3), ("b€", 4, 7)]
    assert [one(spark, X.date_text(F.lit(v).cast("timestamp"))) for v in ("2024-02-03 04:05:06", None)] == ["2024-02-03 04:05:06", " " * 19]


def test_places_of_anchors_equal_those_of_blocks():
    r = np.random.default_rng(5)
    data = r.integers(0, 256, 30_000, dtype=np.uint8)
    places = set(anchors.anchor_places(data, 256).tolist())
    seen = 0
    for i in range(len(data) // 256):
        part = data[i * 256 : (i + 1) * 256]
        if (a := anchors.first_anchor(part)) is not None:
            seen += 1
            assert i * 256 + a in places
            assert anchors.fingerprints(data, np.array([i * 256 + a]), 256)[0] == anchors.fingerprint(part, a)
    assert seen > 20


def test_shifted_blocks_are_found_and_covered(spark):
    r = random.Random(6)
    base = r.randbytes(20_000)
    texts = [base, b"#" + base, r.randbytes(300) + base[5000:9000] + r.randbytes(77), b"", b"\0" * 5000]
    starts = np.cumsum([0, *(len(t) for t in texts)]).tolist()
    rows = spark.createDataFrame([(i, starts[i], len(t), bytearray(t)) for i, t in enumerate(texts)], "chunk long, payload long, size long, content binary")
    found = anchors.self_matches(rows.select("chunk", "content"), rows.select("chunk", "payload"), 256, 1024)
    whole = b"".join(texts)
    got = {(x["offset"], x["ref"]) for x in found.collect()}
    index = {}
    for i, t in enumerate(texts):
        for k in range(len(t) // 256):
            part = t[k * 256 : (k + 1) * 256]
            if anchors.first_anchor(np.frombuffer(part, np.uint8)) is not None:
                index.setdefault(part, starts[i] + k * 256)
    want = {(starts[i] + p, ref) for i, t in enumerate(texts) for p in range(len(t) - 255) if (ref := index.get(t[p : p + 256])) is not None and ref + 256 < (starts[i] + p) // 1024 * 1024}
    assert got == want and any((o - q) % 256 for o, q in got)
    out = bytearray()
    for x in sorted(anchors.cover_chunks(rows.select("chunk", "payload", "size"), found).collect(), key=lambda x: x["start"]):
        assert x["start"] == len(out)
        out += whole[x["start"] : x["start"] + x["length"]] if x["ref"] is None else bytes(out[x["ref"] : x["ref"] + x["length"]])
    assert bytes(out) == whole


def test_capped_index(spark):
    rows = spark.createDataFrame([(f"h{i % 40}", i) for i in range(100)], "hash string, offset long")
    got = blocks.capped_index(rows, slots=3, buckets=4).collect()
    assert max(x["slot"] for x in got) <= 3 and len({(x["bucket"], x["slot"]) for x in got}) == len(got)


def test_failing_predicates(spark):
    from lamina.operators import filters

    rows = spark.range(10).select("id")

    def odd(r):
        if (r["id"] == 4).any():
            raise ValueError("four")
        return r["id"] % 2 == 1

    assert sorted(x[0] for x in filters.where(rows, odd, "drop").collect()) == [1, 3, 5, 7, 9]
    assert sorted(x[0] for x in filters.where(rows, odd, "keep").collect()) == [1, 3, 4, 5, 7, 9]
    with pytest.raises(Exception, match="four"):
        filters.where(rows, odd).collect()


def test_more_paths(spark):
    from lamina import build_info
    from lamina.functions import paths as Q

    assert one(spark, Q.absolute(F.lit("./a//b/"), "/x")) == "/x/a/b" and one(spark, Q.absolute(F.lit("/a"), "/x")) == "/a"
    assert one(spark, Q.same(F.lit("a/./b".replace("./", "")), F.lit("./a//b"), "/r")) is True
    assert [one(spark, Q.without_delimiter(F.lit("//a/b/"), w)) for w in ("start", "end", "both")] == ["a/b/", "//a/b", "a/b"]
    assert one(spark, Q.identity_case(F.lit("Ab"), False)) == "ab"
    assert {"lamina", "pyspark"} <= set(build_info())
