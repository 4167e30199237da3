import pytest
from pyspark.sql import functions as F

from lamina.catalogue import common_parent
from lamina.functions import paths as P
from lamina.functions import text as X
from lamina.operators import anchors, filters, lookups


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("n, text", [(0, "0 "), (999, "999 "), (1000, "0.97 K"), (1023, "0.99 K"), (1024, "1.00 K"), (999_999, "976 K"), (1_000_001, "976 K"), (1024 * 1024 - 1, "0.99 M"), (1024**2 + 1, "1.00 M"), (1024**3, "1.00 G"), (1024**4, "1.00 T"), (1024**5, "1.00 P")])
def test_human_size(spark, n, text):
    assert one(spark, X.human_size(F.lit(n).cast("long"))) == text


def test_patterns(spark):
    t = F.lit("key = value; k2 = v2")
    assert one(spark, X.match(t, "(%w+)%s*=")) == "key"
    assert one(spark, X.gmatch(t, "%w+ = (%w+)")) == ["value", "v2"]
    assert one(spark, X.find(t, "%d")) == 15
    assert one(spark, X.find(t, "nothing")) == 0
    text, n = X.gsub(t, "(%w+) = (%w+)", "%2=%1")
    assert one(spark, text) == "value=key; v2=k2" and one(spark, n) == 2
    assert one(spark, X.match(F.lit("aXbXc"), "^(.-)X")) == "a"
    assert one(spark, X.match(F.lit("abab"), "(ab)%1")) == "ab"
    assert one(spark, X.gmatch(F.lit("a]b-c"), "[]b-]")) == ["]", "b", "-"]
    for bad in ("%b()", "()", "[a", "a%"):
        with pytest.raises(ValueError):
            X.to_regex(bad)


def test_sub_and_codepoints(spark):
    t = F.lit("añb€c")
    assert [one(spark, X.sub(t, *a)) for a in ((2, 4), (-2, -1), (0, 2), (4, 2), (-99, 1))] == ["ñb€", "€c", "añ", "", "a"]
    assert one(spark, X.codepoints(t, 1, -1)) == [97, 241, 98, 8364, 99]
    assert one(spark, X.char(8364)) == "€"
    with pytest.raises(ValueError):
        X.char(0x110000)


def test_paths(spark):
    assert one(spark, P.tidy(F.lit("./a\\b//c/"))) == "a/b/c"
    assert [one(spark, P.extension(F.lit(p))) for p in ("a/b.tar.gz", "a.d/b", "none")] == ["gz", "", ""]
    assert common_parent(spark, ["a/b/c", "a/b/d/e", "a/bc"]) == "a"
    assert common_parent(spark, ["x/y", "z"]) == ""
    with pytest.raises(Exception, match="absolute"):
        one(spark, P.relative(F.lit("/etc")))


def test_exclusion_is_by_whole_parts(spark):
    items = spark.createDataFrame([("a/b",), ("a/bc",), ("a/b/c",), ("d",)], "path string")
    got = filters.exclude(items, spark.createDataFrame([("a/b",)], "path string"))
    assert sorted(r[0] for r in got.collect()) == ["a/bc", "d"]
    assert sorted(r[0] for r in filters.exclude_few(items, ["a/b"]).collect()) == ["a/bc", "d"]
    hit, missing = filters.select_paths(items, spark.createDataFrame([("a/b",), ("zzz",)], "path string"))
    assert sorted(r[0] for r in hit.collect()) == ["a/b", "a/b/c"] and [r[0] for r in missing.collect()] == ["zzz"]


def test_reference_chains(spark):
    links = spark.createDataFrame([(i, i - 1 if i else None) for i in range(50)], "node long, ref long")
    assert {r["root"] for r in lookups.resolve_roots(links).collect()} == {0}


def test_cover_takes_long_matches_first():
    assert anchors.cover([(0, 4, 100), (2, 8, 200), (10, 4, 208)], 16) == [("L", 0, 2, None), ("R", 2, 12, 200), ("L", 14, 2, None)]
