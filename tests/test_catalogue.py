from collections import Counter

import pytest

from lamina import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    have = [x[0] for x in cur.description]
    assert sorted(have) == cols
    want = Counter(repr(tuple(r[have.index(c)] for c in cols)) for r in cur.fetchall())
    assert Counter(repr(tuple(r)) for r in df.select(*cols).collect()) == want


def test_cover_tiles_chunks_and_points_back(spark, data):
    rows = catalogue.QUERIES["anchor_dedup_cover"](spark, data).collect()
    by = {}
    for r in rows:
        by.setdefault(r["chunk"], []).append(r)
    for packets in by.values():
        packets.sort(key=lambda r: r["ord"])
        for a, b in zip(packets, packets[1:]):
            assert a["start"] + a["length"] == b["start"]
        assert all(r["ref"] is None or r["ref"] + r["length"] <= r["start"] for r in packets)


def test_fingerprints_follow_anchors(spark, data):
    n = sum(r["n"] for r in catalogue.QUERIES["anchor_fingerprint"](spark, data).collect())
    assert n == catalogue.QUERIES["anchor_positions"](spark, data).filter("anchor is not null").count()


def test_codepoints_of_short_texts(spark, tmp_path):
    import duckdb

    rows = [(1, "a"), (2, ""), (3, None), (4, "\U0001d4b3b"), (5, "\n\u0301")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalogue.QUERIES["str_codepoints"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(catalogue.ORACLE_SQL["str_codepoints"]).fetchall())
