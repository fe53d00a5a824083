import datetime as dt

import pytest
from pyspark.sql import functions as F

from loamdex import schemas
from loamdex.operators import catalog as c
from loamdex.operators import changes as ch
from loamdex.operators import reconcile as rc

T = lambda d: dt.datetime(2025, 1, d)


@pytest.fixture(scope="module")
def sites(spark):
    row = lambda i, name, version, status, day, percent=0, beat=None: (i, f"https://{name}/{version}/", f"https://{name}/", name, version, T(day) if status == "completed" else None, status, percent, 5, 3, None, T(day), beat)
    return spark.createDataFrame([row(1, "Alpha", "1", "completed", 1, 100), row(2, "Alpha", "2", "indexing", 2, 100), row(3, "beta", "1", "failed", 3), row(4, "gamma alpha", "1", "pending", 4, 0, T(5))], schemas.SITES)


@pytest.fixture(scope="module")
def queue(spark):
    rows = [(1, 1, "a", "completed", 0), (2, 1, "b", "failed", 2), (3, 1, "c", "failed", 3), (4, 2, "d", "processing", 0), (5, 2, "e", "pending", 0), (6, 2, "f", "completed", 0), (7, None, "g", "pending", 0)]
    return spark.createDataFrame([(i, s, u, st, r, None, T(1 + i)) for i, s, u, st, r in rows], "id long, site_id long, url string, status string, retry_count long, error_message string, created_date timestamp_ntz")


def ids(df):
    return [r.id for r in df.collect()]


def test_lookups(sites):
    assert ids(c.site_by_name_version(sites, "Alpha", "2")) == [2] and ids(c.site_by_index_url(sites, "https://beta/1/")) == [3]
    assert ids(c.resolve_site(sites, "ALPHA")) == [4] and ids(c.resolve_site(sites, " 2 ")) == [2] and ids(c.resolve_site(sites, "none")) == []
    assert ids(c.matching_sites(sites, "Alpha")) == [1, 2] and ids(c.matching_sites(sites, "^(beta|gamma)", "regex")) == [3, 4]
    assert ids(c.latest_sites(sites)) == [4, 3, 2, 1] and ids(c.display_sites(sites)) == [1, 2, 3, 4] and ids(c.sites_by_status(sites, "failed")) == [3]
    assert ids(c.latest_per_name(sites).orderBy("id")) == [2, 3, 4] and ids(c.completed_sites(sites)) == [1]
    assert [tuple(r) for r in c.status_flags(sites).orderBy("id").collect()] == [(1, True, False, False, True), (2, False, True, False, True), (3, False, False, True, False), (4, False, True, False, False)]


def test_heartbeats(sites):
    at = lambda seconds: F.lit(str(T(5) + dt.timedelta(seconds=seconds))).cast("timestamp_ntz")
    got = lambda s: {r.id: (r.seconds_since, r.is_active) for r in c.heartbeat_activity(sites, at(s)).collect()}
    assert got(119)[4] == (119, True) and got(120)[4] == (120, False) and got(0)[1] == (None, False)


def test_queue(queue):
    assert sorted((r.site_id, r.id) for r in c.next_items(queue).collect()) == [(1, 2), (2, 5)]
    assert ids(c.next_item(queue, 1)) == [2] and ids(c.next_item(queue, 1, 2)) == [] and ids(c.completed_items(queue, 2)) == [6]
    assert tuple(c.queue_stats(queue, 99).first()) == (0, 0, 0, 0, 0)
    assert {r.site_id: (r.total_pages, r.progress_percent) for r in c.crawl_progress(queue).collect()} == {1: (3, 33), 2: (3, 33)}
    again = queue.unionByName(queue.where("id = 5").withColumn("status", F.lit("completed")))
    assert {r.id: r.status for r in c.current_queue(again).collect()}[5] == "completed" and c.current_queue(again).count() == 7


def test_outcomes(spark):
    rows = [(1, "successful"), (1, "failed"), (2, "failed"), (3, "successful"), (3, "robots_blocked")]
    got = c.crawl_outcome(c.crawl_counters(spark.createDataFrame(rows, "site_id long, outcome string")))
    assert {r.site_id: (r.total_crawled, r.status, r.message) for r in got.collect()} == {1: (2, "indexing", "1 of 2 crawl attempts failed"), 2: (1, "failed", "All 1 crawl attempts failed"), 3: (2, "indexing", None)}


def test_indexing(spark, queue):
    chunks = spark.createDataFrame([(1, 1, "a"), (2, 9, "f")], "id long, site_id long, url string")
    assert ids(c.pages_to_index(queue, chunks)) == [6]
    assert {r.site_id: (r.pages_left, r.is_complete) for r in c.indexing_complete(queue, chunks).collect()} == {1: (0, True), 2: (1, False)}


def test_sparse_update(spark, sites):
    new = spark.createDataFrame([(3, "completed", None), (9, "failed", 1)], "id long, status string, total_pages long")
    got = {r.id: r for r in ch.sparse_update(sites.withColumn("error_message", F.lit("e")), new, clear=["error_message"]).collect()}
    assert (got[3].status, got[3].total_pages, got[3].error_message) == ("completed", 5, None) and got[1].error_message == "e" and len(got) == 4


def test_reconciliation(spark, sites):
    chunks = spark.createDataFrame([(1, "v1"), (1, "v2"), (2, "v3"), (1, None)], "site_id long, vector_id string")
    vectors = spark.createDataFrame([("v1", 1), ("v9", 4), ("v9", 4)], "id string, site_id long")
    state = rc.compared(sites, chunks, vectors)
    assert {(r.vector_id, r.site_id, r.state) for r in state.collect()} == {("v1", "1", "present"), ("v2", "1", "missing"), ("v9", "4", "orphaned")}
    totals = rc.consistency_totals(state)
    assert tuple(totals.first()) == (2, 2, 1, 1, 2, False) and rc.summary(totals).first()[0].startswith("2 issues")
    assert {r.site_id: (r.missing, r.orphaned) for r in rc.consistency_by_site(state).collect()} == {"1": (1, 0), "4": (0, 1)}
    empty = rc.consistency_totals(rc.compared(sites, chunks.limit(0), vectors.limit(0)))
    assert empty.first().is_consistent and rc.summary(empty).first()[0].startswith("consistent")


def test_row_rules(spark, sites):
    bad = sites.withColumn("progress_percent", F.when(F.col("id") == 1, 101).otherwise(F.col("progress_percent"))).withColumn("status", F.when(F.col("id") == 2, "odd").otherwise(F.col("status")))
    got = ch.integrity({"sites": bad.unionByName(bad.where("id = 4"))}, {"sites": schemas.site_problem()}, {"sites": ["id"]})
    assert {(r.problem, r.rows) for r in got.collect()} == {("progress out of range", 1), ("unknown status", 1), ("repeated id", 2)}
