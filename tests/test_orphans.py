import datetime as dt

from pyspark.sql import functions as F

from loamdex.operators import orphans as o

U = "0123abcd-0000-4000-8000-00000000000{}".format


def test_spellings(spark):
    values = [U(1), U(1).upper(), "{" + U(1) + "}", " urn:uuid:" + U(1) + "\t", U(1).replace("-", ""), "x", " ", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    key = U(1).replace("-", "")
    assert [r.y for r in df.select(o.uuid_key(F.col("v")).alias("y"), "k").orderBy("k").collect()] == [key] * 5 + ["?x", None, None]
    values = ["5", " 005\t", "+5", "-3", "-0", "0", "00", "5.0", "x5", "", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    assert [r.y for r in df.select(o.integer_key(F.col("v")).alias("y"), "k").orderBy("k").collect()] == ["5", "5", "5", "-3", "0", "0", "0", "?5.0", "?x5", None, None]
    values = ["2025-01-01T00:30:00+01:00", "2024-12-31T23:00:00-05:00", "2025-01-26T22:53:55.391843530+00:00", "2025-02-03T04:05:06Z", "2025-02-03 04:05:06", "2025-02-03", "2025-13-01T00:00:00Z", "pending", "", None, "2025-01-31t23:59:59z"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    want = ["2024-12", "2025-01", "2025-01", "2025-02", "2025-02", "2025-02", "unknown", "unknown", "unknown", "unknown", "2025-01"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert [r.y for r in df.select(o.month_of_text(F.col("v")).alias("y"), "k").orderBy("k").collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_cascade(spark):
    """A chain of ten, a cycle, and repeated rows."""
    rows = [(f"n{k}", f"n{k}", f"n{k - 1}" if k else "gone", "2025-01") for k in range(10)] + [("c1", "c1", "c2", "m"), ("c2", "c2", "c1", "m"), ("top", "top", None, "m"), ("n3", "n3", "n2", "2025-01")]
    df = spark.createDataFrame(rows, "record_key string, self_key string, parent string, ref_month string")
    got = o.orphan_cascade({"t": o.Relation(df, df.select(F.col("self_key").alias("key")).distinct())}, [o.ForeignKey("t", "parent", "t")])
    assert {(r.record_key, r.kind, r.depth) for r in got.collect()} == {("n0", "direct", 0)} | {(f"n{k}", "inherited", k) for k in range(1, 10)}
    report = o.orphan_report(got).collect()
    assert [(r.direct_orphans, r.inherited_orphans) for r in report] == [(1, 9)]


def test_index_cases(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    sites = spark.createDataFrame([(1, "x"), (None, "y")], "id long, key string")
    queue = spark.createDataFrame([(1, 1, t(1)), (2, 9, t(1)), (2, 9, t(1)), (3, None, t(1))], "id long, site_id long, created_date timestamp_ntz")
    chunks = spark.createDataFrame([(1, 1, U(1), t(3)), (2, 1, U(2), t(3)), (3, 1, U(2), t(6)), (4, 1, U(3), t(3)), (5, 8, U(4), t(3))], "id long, site_id long, vector_id string, indexed_date timestamp_ntz")
    deletions = spark.createDataFrame([(U(2).upper(), t(5)), (U(3), t(2)), (U(3), t(4)), (U(9), t(1))], "vector_id string, deleted_at timestamp_ntz")
    records = spark.createDataFrame([("a", U(1), "1", "2025-02-01T00:00:00Z"), ("b", U(2), "01", "x"), ("c", U(3), "one", "2025-02-01T00:00:00Z"), ("d", U(9), None, None), ("e", " ", "2", "2025-02-01T00:00:00Z"), ("f", U(4), "1", "2025-03-01T00:00:00Z")], "id string, chunk_id string, site_id string, created_at string")
    got = {(r.src_table, r.src_field, r.record_key, r.ref_month, r.kind) for r in o.index_orphans(sites, queue, chunks, deletions, records).collect()}
    e = "embedding_records"
    assert got == {
        (e, "chunk_id", "c", "2025-02", "direct"), (e, "chunk_id", "d", "unknown", "direct"), (e, "chunk_id", "f", "2025-03", "inherited"), (e, "site_id", "c", "2025-02", "direct"), (e, "site_id", "e", "2025-02", "direct"),
        ("crawl_queue", "site_id", "2", "2025-01", "direct"), ("indexed_chunks", "site_id", "5", "2025-01", "direct"),
    }
    empty = o.index_orphans(sites.limit(0), queue, chunks.limit(0), deletions.limit(0), records.limit(0)).collect()
    assert {r.record_key for r in empty} == {"1", "2"}
